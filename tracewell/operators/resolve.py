"""Reference resolution as prioritised equi joins: imports, names, members, dispatch and bindings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.skew import top_n
from tracewell.session import pin

# How a module specifier is completed, and what compiled names stand for.
JS_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
JS_INDEXES = ("/index.ts", "/index.js", "/index.tsx", "/index.jsx")
TS_SUBSTITUTES = {".js": (".ts", ".tsx", ".js", ".jsx"), ".jsx": (".tsx", ".jsx"), ".mjs": (".mts", ".mjs"), ".cjs": (".cts", ".cjs")}


def normalise_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    return F.array_join(F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    ), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def prefixes(path: Column) -> Column:
    """All leading parts of a path, from the empty prefix to the whole path, with their depth."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("prefix")))


def nearest_candidate(lookups: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Per lookup (id, key, from_path) the candidate (key, path) with the longest common prefix, then the shallower path.

    Candidates are pre-aggregated to the best one per (key, prefix); a lookup meets only its own
    prefixes, so a key with many candidates never forms pairs.
    """
    return _nearest(lookups, candidates, key).drop(key)


def _nearest(lookups: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """``nearest_candidate`` with the key of each lookup.

    A candidate becomes one row per prefix. Size estimates do not see that, so that the table could be
    broadcast for being small before it grows; hence the merge join.
    """
    best = (
        candidates.select(key, "path", F.explode(prefixes(F.col("path"))).alias("_p")).groupBy(key, F.col("_p.prefix").alias("_prefix"), F.col("_p.depth").alias("_depth"))
        .agg(F.min(F.struct(F.size(F.split("path", "/")).alias("n"), F.col("path").alias("path"))).alias("_best"))
    )
    asked = lookups.select("id", key, F.explode(prefixes(F.col("from_path"))).alias("_p")).select("id", key, F.col("_p.prefix").alias("_prefix"), F.col("_p.depth").alias("_depth"))
    met = asked.join(best.hint("merge"), [key, "_prefix", "_depth"])
    return met.groupBy("id").agg(F.max_by(key, "_depth").alias(key), F.max_by("_best.path", "_depth").alias("path"), F.max("_depth").alias("common"))


def module_suffixes(files: DataFrame) -> DataFrame:
    """(module, path): every dotted suffix of a module path names the file."""
    stem = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", "")
    parts = F.filter(F.split(stem, "/"), lambda p: p != "")
    return files.withColumn("_parts", parts).select("path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("_parts")), lambda i: F.array_join(F.slice("_parts", i, F.size("_parts")), "."))).alias("module"))


def resolve_modules(lookups: DataFrame, files: DataFrame) -> DataFrame:
    """Per lookup (id, module, from_path) the file: leading components are dropped until a suffix is known, then the nearest file wins."""
    index = module_suffixes(files)
    known = index.select(F.col("module").alias("suffix")).distinct()
    parts = F.split("module", r"\.")
    tried = lookups.select("id", "from_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        i.alias("dropped"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("suffix")))).alias("_s")).select("id", "from_path", "_s.*")
    hit = tried.join(known.hint("merge"), "suffix").groupBy("id").agg(F.min(F.struct("dropped", "suffix", "from_path")).alias("m")).select("id", "m.suffix", "m.from_path")
    return _nearest(hit, index.select(F.col("module").alias("suffix"), "path"), "suffix").select("id", "path", "common", "suffix")


def first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Per id the candidate path of the smallest priority that exists."""
    return candidates.join(files.select("path").distinct(), "path").groupBy("id").agg(F.min(F.struct("priority", "path")).alias("m")).select("id", "m.path")


def resolve_relative(lookups: DataFrame, files: DataFrame) -> DataFrame:
    """Per lookup (id, from_path, spec, is_typescript) the file a relative specifier names."""
    joined = normalise_path(F.concat_ws("/", folder(F.col("from_path")), F.col("spec")))
    work = lookups.filter(F.col("spec").startswith(".")).withColumn("_j", joined).withColumn("_ext", F.regexp_extract("_j", r"(\.[^./]*)$", 1))
    stem = F.regexp_replace("_j", r"\.[^./]*$", "")
    plain = F.transform(F.array(*[F.lit(s) for s in JS_SUFFIXES + JS_INDEXES]), lambda s, i: F.struct(F.concat(F.col("_j"), s).alias("path"), i.alias("priority")))
    options = plain
    for ext, subs in TS_SUBSTITUTES.items():
        swapped = F.transform(F.array(*[F.lit(s) for s in subs]), lambda s, i: F.struct(F.concat(stem, s).alias("path"), i.alias("priority")))
        options = F.when(F.col("is_typescript") & (F.col("_ext") == ext), swapped).otherwise(options)
    return first_existing(work.select("id", F.explode(options).alias("_c")).select("id", "_c.*"), files)


def resolve_include(lookups: DataFrame, files: DataFrame) -> DataFrame:
    """Per lookup (id, from_path, header): relative path, exact path, any path that ends with it, then the base name.

    Files are indexed once by every path suffix with the first file of each, so each step is one equi join.
    """
    parts = F.split("path", "/")
    suffixes = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    index = suffixes.groupBy("suffix").agg(F.min("path").alias("_first"))
    exact = files.select(F.col("path").alias("suffix"), F.col("path").alias("_exact")).distinct()
    relative = normalise_path(F.concat_ws("/", folder(F.col("from_path")), F.col("header")))
    base = F.element_at(F.split("header", "/"), -1)
    tries = lookups.select("id", F.explode(F.array(
        F.struct(F.lit(0).alias("priority"), relative.alias("suffix")), F.struct(F.lit(1).alias("priority"), F.col("header").alias("suffix")),
        F.struct(F.lit(2).alias("priority"), F.col("header").alias("suffix")), F.struct(F.lit(3).alias("priority"), base.alias("suffix")))).alias("_t")).select("id", "_t.*")
    met = tries.join(index, "suffix").join(exact, "suffix", "left")
    path = F.when(F.col("priority") < 2, F.col("_exact")).otherwise(F.col("_first"))
    return met.withColumn("path", path).filter("path is not null").groupBy("id").agg(F.min(F.struct("priority", "path")).alias("m")).select("id", "m.path", F.col("m.priority").alias("rung"))


def resolve_imports(imports: DataFrame, modules: DataFrame, definitions: DataFrame, stdlib: DataFrame) -> DataFrame:
    """Binding of each import (id, file, module, symbol, kind): module, symbol, wildcard, or external / stdlib.

    ``modules``: module, path. ``definitions``: file, name, fqn. ``stdlib``: module.
    """
    joined = (
        imports.join(modules.select("module", F.col("path").alias("target_file")), "module", "left")
        .join(definitions.select(F.col("file").alias("target_file"), F.col("name").alias("symbol"), "fqn"), ["target_file", "symbol"], "left")
        .join(stdlib.select("module", F.lit(True).alias("_std")).distinct(), "module", "left")
    )
    std = F.coalesce("_std", F.lit(False)) | (F.col("kind") == "system")
    wants_symbol = (F.col("kind") == "symbol") & (F.coalesce("symbol", F.lit("")) != "")
    binding = (
        F.when(F.col("kind") == "wildcard", "wildcard").when(wants_symbol & F.col("fqn").isNotNull(), "symbol")
        .when(wants_symbol, F.when(std, "stdlib_symbol").otherwise("external_symbol")).when(F.col("target_file").isNotNull(), "module")
        .otherwise(F.when(std, "stdlib_module").otherwise("external_module"))
    )
    payload = F.when(binding == "symbol", F.col("fqn")).when(binding.isin("module", "wildcard"), F.col("target_file")).otherwise(F.col("module"))
    return joined.select("id", "file", "module", "symbol", "target_file", binding.alias("binding"), payload.alias("payload"))


def import_edges(bindings: DataFrame) -> DataFrame:
    return bindings.filter("target_file is not null").select(F.col("file").alias("source"), F.col("target_file").alias("target"), F.lit("imports").alias("relation")).distinct()


class Rung:
    """One step of the resolution ladder: a lookup table, the join keys and what a hit means."""

    def __init__(self, method: str, table: DataFrame, on: Sequence[str], when: Column | None = None, confidence: str = "high", certainty: str = "must", scope: str = "project"):
        self.method, self.table, self.on, self.when = method, table, list(on), when
        self.confidence, self.certainty, self.scope = confidence, certainty, scope


def resolve_references(references: DataFrame, ladder: Sequence[Rung], no_hit: Column, key: Sequence[str] = ("id",)) -> DataFrame:
    """First rung that knows a target wins; every rung is one equi join on its own keys.

    A rung joins only the references that its condition admits, and only their keys, so a reference is
    shuffled for the rungs it can use and not for all of them. The hits meet in one pre-aggregated
    minimum per reference. Rung tables have the join keys and ``target``, with at most one row per
    key; ``key`` identifies a reference. ``no_hit`` gives the reason of one that no rung resolves.
    """
    key, hits = list(key), []
    for number, rung in enumerate(ladder):
        admitted = references if rung.when is None else references.filter(rung.when)
        columns = list(dict.fromkeys([*key, *rung.on]))
        met = admitted.select(*columns).join(rung.table.select(*rung.on, "target").filter("target is not null"), rung.on)
        hits.append(met.select(*key, F.struct(
            F.lit(number).alias("rung"), F.col("target"), F.lit(rung.method).alias("method"), F.lit(rung.certainty).alias("certainty"),
            F.lit(rung.confidence).alias("confidence"), F.lit(rung.scope).alias("scope")).alias("_r")))
    best = reduce(DataFrame.unionByName, hits).groupBy(*key).agg(F.min("_r").alias("_r"))
    picked = references.join(best, key, "left")
    miss = F.col("_r").isNull()
    return picked.select(
        *references.columns, "_r.target", F.coalesce("_r.method", F.lit("unresolved")).alias("method"), F.coalesce("_r.certainty", F.lit("unresolved")).alias("certainty"),
        F.coalesce("_r.confidence", F.lit("low")).alias("confidence"), "_r.scope", F.when(miss, no_hit).alias("unresolved_reason"))


def resolution_stats(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("method").agg(F.count("*").alias("references"), F.count_if(F.col("target").isNull()).alias("unresolved"))


def fallback_unique_name(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Simple-name match: one symbol is taken, among several the nearest file, none is ``symbol_not_found``.

    ``references``: id, name, from_path, is_member. ``symbols``: name, fqn, path, is_member. Members
    with several matches are ``ambiguous_member``.
    """
    counts = symbols.groupBy("name", "is_member").agg(F.countDistinct("fqn").alias("n"), F.min("fqn").alias("_only"))
    work = references.join(counts, ["name", "is_member"], "left")
    several = work.filter((F.col("n") > 1) & ~F.col("is_member")).select("id", "name", "from_path")
    plain = symbols.filter("not is_member")
    near = nearest_candidate(several, plain.select("name", "path"), "name")
    in_file = plain.groupBy("name", "path").agg(F.min("fqn").alias("_near"))
    nearest = near.join(several.select("id", "name"), "id").join(in_file, ["name", "path"]).select("id", "_near")
    out = work.join(nearest, "id", "left")
    target = F.when(F.col("n") == 1, F.col("_only")).otherwise(F.col("_near"))
    method = (
        F.when(F.col("n") == 1, F.when(F.col("is_member"), "unique_member_heuristic").otherwise("unique_name_heuristic"))
        .when(F.col("_near").isNotNull(), "nearest_module_heuristic").otherwise("unresolved")
    )
    reason = F.when(method == "unresolved", F.when(F.col("n").isNull(), F.when(F.col("is_member"), "unknown_receiver_type").otherwise("symbol_not_found"))
                    .otherwise(F.when(F.col("is_member"), "ambiguous_member").otherwise("ambiguous_symbol")))
    return out.select("id", "name", target.alias("target"), method.alias("method"), reason.alias("unresolved_reason"))


def containment_edges(definitions: DataFrame) -> DataFrame:
    """``contains`` from the parent (else the file), ``declares`` when the member lives in another file."""
    parents = definitions.select(F.col("id").alias("parent_id"), F.col("file").alias("_parent_file"))
    joined = definitions.join(parents, "parent_id", "left")
    owner = F.when(F.col("_parent_file").isNotNull(), F.col("parent_id")).otherwise(F.col("file"))
    contains = joined.select(owner.alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation")).filter("source <> target")
    declares = joined.filter(F.col("_parent_file") != F.col("file")).select(F.col("file").alias("source"), F.col("id").alias("target"), F.lit("declares").alias("relation"))
    return contains.unionByName(declares)


def inheritance_edges(bases: DataFrame, types: DataFrame) -> DataFrame:
    """Base names (type, lang, base_name) resolved to types; the relation follows the kind of the base."""
    joined = bases.join(types.select(F.col("name").alias("base_name"), F.col("id").alias("target"), F.col("kind").alias("base_kind")), "base_name").filter(F.col("type") != F.col("target"))
    relation = (
        F.when((F.col("lang") == "go") & F.col("base_kind").isin("struct", "type"), "embeds").when(F.col("base_kind").isin("interface", "trait"), "implements").otherwise("inherits")
    )
    return joined.select(F.col("type").alias("source"), "target", relation.alias("relation"))


def override_edges(members: DataFrame, order: DataFrame) -> DataFrame:
    """Per member (type, name, id) the member of the first base in linearised order that has its name."""
    above = order.join(members.select(F.col("type").alias("base"), "name", F.col("id").alias("target")), "base")
    joined = members.join(above.select("type", "name", "depth", "target"), ["type", "name"])
    return joined.groupBy("id").agg(F.min(F.struct("depth", "target")).alias("m")).select(F.col("id").alias("source"), F.col("m.target").alias("target")).filter("source <> target")


def expand_dispatch(calls: DataFrame, members: DataFrame, subclasses: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(extra may-edges of calls, targets beyond the cap per method).

    A call (call_id, target) to a member also reaches the overriding members of direct subclasses.
    Overrides are ranked once per base member, so a hot call target does not repeat that work; what
    the cap leaves out is listed in full in the second table.
    """
    base = members.select("type", "name", F.col("id").alias("target"))
    over = (
        base.join(subclasses.select(F.col("base").alias("type"), F.col("type").alias("_sub")), "type")
        .join(members.select(F.col("type").alias("_sub"), "name", F.col("id").alias("override")), ["_sub", "name"])
        .filter(F.col("target") != F.col("override")).select("target", "override").distinct()
    )
    totals = over.groupBy("target").agg(F.count("*").alias("available"))
    kept = top_n(over, ["target"], ["override"], cap).drop("rn").join(totals, "target").withColumn("truncated", F.col("available") > cap)
    beyond = over.join(kept.select("target", "override"), ["target", "override"], "left_anti")
    edges = calls.join(kept, "target").select("call_id", F.col("override").alias("target"), F.lit("may").alias("certainty"), F.lit("medium").alias("confidence"), "truncated")
    return edges, beyond


def declaration_to_implementation(declarations: DataFrame, implementations: DataFrame) -> DataFrame:
    """Prototype -> implementation: the only one, else the one with the same file stem, else the first."""
    by_name = implementations.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("_first"))
    by_stem = implementations.groupBy("name", "stem").agg(F.min("id").alias("_same"))
    joined = declarations.join(by_name, "name").join(by_stem, ["name", "stem"], "left")
    return joined.select("id", F.when(F.col("n") == 1, F.col("_first")).otherwise(F.coalesce("_same", "_first")).alias("implementation"))


def attach_members(members: DataFrame, types: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(member placement, aliases). Members declared elsewhere (id, name, owner_name, line) join the real owner;

    where the owner already has the name, the definition's place replaces the declaration's and the id becomes an alias.
    """
    owned = members.join(types.select(F.col("name").alias("owner_name"), F.col("id").alias("owner")), "owner_name")
    known = existing.select("owner", "name", F.col("id").alias("_canonical"), F.col("is_declaration").alias("_declared"), F.col("line").alias("_line"))
    joined = owned.join(known, ["owner", "name"], "left")
    placed = joined.select(
        F.coalesce("_canonical", "id").alias("id"), "owner", "name", F.when(F.col("_declared") | F.col("_canonical").isNull(), F.col("line")).otherwise(F.col("_line")).alias("line"))
    return placed, joined.filter("_canonical is not null and _canonical <> id").select(F.col("id").alias("alias"), F.col("_canonical").alias("canonical"))


def variable_references(references: DataFrame, declarations: DataFrame) -> DataFrame:
    """(reference, declaration) pairs by declaration id, all matches, no guess by name."""
    wanted = references.select("reference_id", F.explode("declaration_ids").alias("declaration_id"))
    return wanted.join(declarations, "declaration_id")


def symbol_to_node(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outline symbol (key, file, fqn, name, line) -> node: exact id, same file, name and line, only one of the name in the file, the file."""
    exact = F.concat("file", F.lit("::"), F.replace("fqn", F.lit("."), F.lit("::")))
    by_id = nodes.select(F.col("id").alias("_id")).distinct()
    by_line = nodes.groupBy("file", "name", "line").agg(F.min("id").alias("_by_line"))
    by_name = nodes.groupBy("file", "name").agg(F.count("*").alias("_n"), F.min("id").alias("_by_name"))
    joined = (
        symbols.withColumn("_exact", exact).join(by_id.withColumnRenamed("_id", "_exact").withColumn("_e", F.lit(True)), "_exact", "left")
        .join(by_line, ["file", "name", "line"], "left").join(by_name, ["file", "name"], "left")
        .join(by_id.withColumnRenamed("_id", "file").withColumn("_f", F.lit(True)), "file", "left")
    )
    node = (
        F.when(F.col("_e"), F.col("_exact")).when((F.col("line") > 0) & F.col("_by_line").isNotNull(), F.col("_by_line"))
        .when(F.col("_n") == 1, F.col("_by_name")).when(F.col("_f"), F.col("file"))
    )
    return joined.select("key", node.alias("node"))


def prefer_exact_bindings(references: DataFrame, bindings: DataFrame, backend_ok: bool = True) -> DataFrame:
    """Exact bindings (ref_id, target, reason) where they resolve; else the heuristic result, lowered, with the reason."""
    missing = {"ref_id", "target", "reason"} - set(bindings.columns)
    if missing:
        raise ValueError(f"binding table lacks {sorted(missing)}")
    exact = bindings.select("ref_id", F.col("target").alias("_exact"), F.col("reason").alias("_why"), F.lit(True).alias("_mapped"))
    joined = references.join(exact, "ref_id", "left")
    bound = F.col("_exact").isNotNull() & F.col("_why").isNull()
    why = F.when(F.lit(not backend_ok), "compiler_unavailable").when(F.col("_mapped").isNull(), "compiler_callsite_not_mapped").otherwise(
        F.coalesce("_why", F.lit("compiler_declaration_not_mapped")))
    return joined.select(
        "ref_id", F.when(bound, F.col("_exact")).otherwise(F.col("target")).alias("target"), F.when(bound, "declaration_binding").otherwise(F.col("method")).alias("method"),
        F.when(bound | F.col("target").isNotNull(), "may").otherwise("unresolved").alias("certainty"), F.when(bound, "high").otherwise(F.col("confidence")).alias("confidence"),
        F.when(~bound, why).alias("fallback_reason"))


def dependency_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unresolved) from scanned code facts (path, line, position, fact, name), by the phases of the resolver.

    Files and definitions are nodes; files contain definitions and import modules; a call goes to the
    definition of its file, else to the only definition of that name, else it stays unresolved. The
    facts are used by every phase, so the scan that makes them is run once and pinned.
    """
    facts = pin(facts)
    definitions = facts.filter("fact = 'definition'").select(F.concat("path", F.lit("::"), "name").alias("id"), "path", "name", "line")
    defs = definitions.groupBy("id", "path", "name").agg(F.min("line").alias("line"))
    modules = facts.filter("fact = 'import'").select("path", "name").distinct()
    calls = facts.filter("fact = 'call'").select(F.col("path").alias("file"), "line", "position", "name")
    local = defs.select(F.col("path").alias("file"), "name", F.col("id").alias("target"))
    single = defs.groupBy("name").agg(F.count("*").alias("_n"), F.min("id").alias("target")).filter("_n = 1").select("name", "target")
    resolved = resolve_references(calls, [Rung("local_scope", local, ["file", "name"]), Rung("unique_name_heuristic", single, ["name"], confidence="low", certainty="may")], F.lit("symbol_not_found"), ["file", "line", "position"])
    external = F.concat(F.lit("<external>::"), "name")
    nodes = reduce(DataFrame.unionByName, [
        facts.select(F.col("path").alias("id"), F.lit("module").alias("level")).distinct(), defs.select("id", F.lit("function").alias("level")),
        modules.select(external.alias("id"), F.lit("external_module").alias("level")).distinct()])
    edges = reduce(DataFrame.unionByName, [
        defs.select(F.col("path").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation"), F.lit("declared").alias("method")),
        modules.select(F.col("path").alias("source"), external.alias("target"), F.lit("imports").alias("relation"), F.lit("external_binding").alias("method")),
        resolved.filter("target is not null").select(F.col("file").alias("source"), "target", F.lit("calls").alias("relation"), "method")])
    return nodes, edges, resolved.filter("target is null").select("file", "line", "position", "name", "unresolved_reason")
