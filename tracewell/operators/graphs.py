"""Property graphs as node and edge tables: checks, normalisation, statistics, filters and closures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.fixpoint import walk
from tracewell.operators.skew import top_n
from tracewell.session import pin, stored

STRUCTURAL_LEVELS = ("module", "external_module", "stdlib_module")
# Levels, relations and the degree threshold above 200 nodes of each preset view.
VIEW_PRESETS = {
    "core": (("module", "class", "function", "method", "external_module"),
             ("contains", "declares", "imports", "calls", "instantiates", "inherits", "implements", "embeds", "overrides"), 2),
    "architecture": (("module", "class", "external_module"), ("contains", "declares", "imports", "inherits", "implements", "embeds"), 0),
    "calls": (("class", "function", "method", "external_module", "external"), ("calls", "instantiates", "overrides"), 1),
    "all": (None, None, 0),
}


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The contract of a graph view: any table with these columns may be validated."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"graph view lacks columns {missing}")
    return df


def validate_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Issue rows (code, node_id, edge_id, occurrences) of any graph view."""
    require_columns(nodes, "id"), require_columns(edges, "id", "source", "target")
    none = F.lit(None).cast("string")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    node_counts = nodes.groupBy("id").agg(F.count("*").alias("n"))
    edge_counts = edges.groupBy("id").agg(F.count("*").alias("n"))
    rows = lambda df, code, node, edge, n: df.select(F.lit(code).alias("code"), node.alias("node_id"), edge.alias("edge_id"), n.alias("occurrences"))
    repeats = F.col("n") - 1
    known = node_counts.filter(~empty("id")).select(F.col("id").alias("known"))
    ends = edges.select("id", F.explode(F.array("source", "target")).alias("end"))
    missing = (
        ends.join(known, ends.end == known.known, "left_anti").groupBy("id").agg(F.count("*").alias("n"))
    )
    return (
        rows(node_counts.filter(empty("id")), "empty_identity", none, none, F.col("n"))
        .unionByName(rows(edge_counts.filter(empty("id")), "empty_identity", none, none, F.col("n")))
        .unionByName(rows(node_counts.filter(~empty("id") & (repeats > 0)), "duplicate_node", F.col("id"), none, repeats))
        .unionByName(rows(edge_counts.filter(~empty("id") & (repeats > 0)), "duplicate_edge", none, F.col("id"), repeats))
        .unionByName(rows(missing, "dangling_edge", none, F.when(~empty("id"), F.col("id")), F.col("n")))
    )


def edge_reason(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with why each is rejected (null for a kept one); node ids are joined once per endpoint."""
    known = nodes.select(F.col("id").alias("_id")).filter("_id <> ''").distinct()
    has = lambda df, end: df.join(
        known.select(F.col("_id").alias(end), F.lit(True).alias(f"_has_{end}")), end, "left")
    reason = (
        F.when((F.coalesce("source", F.lit("")) == "") | (F.coalesce("target", F.lit("")) == ""), "invalid")
        .when(F.col("source") == F.col("target"), "self_loop")
        .when(F.col("_has_source").isNull() | F.col("_has_target").isNull(), "dangling")
    )
    marked = has(has(edges, "source"), "target")
    return marked.withColumn("reason", reason).select(*edges.columns, "reason")


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept edges, counts per rejection reason)."""
    marked = edge_reason(edges, nodes)
    kept = marked.filter("reason is null").drop("reason")
    return kept, marked.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("edges"))


def merge_parallel_edges(edges: DataFrame, order: str = "id") -> DataFrame:
    """One edge per (source, target, relation, dispatch): the first id and how many it stands for."""
    return edges.groupBy("source", "target", "relation", "dispatch").agg(
        F.min_by("id", order).alias("id"), F.count("*").alias("occurrence_count")
    )


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and total degree of every endpoint, in one pass over the edges."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit(True).alias("out")), F.struct(F.col("target").alias("id"), F.lit(False).alias("out")),
    )).alias("e")).select("e.*")
    return ends.groupBy("id").agg(
        F.count_if(~F.col("out")).alias("in_degree"), F.count_if(F.col("out")).alias("out_degree"), F.count("*").alias("degree")
    )


def central_nodes(edges: DataFrame, k: int = 20) -> DataFrame:
    return degrees(edges).filter("id <> ''").select("id", "degree").orderBy(F.desc("degree"), "id").limit(k)


def graph_summary(nodes: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """Counts, relation histogram and the most central nodes as (section, key, value) rows."""
    rows = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.alias("key"), value.alias("value"))
    relation = F.coalesce("relation", F.lit("unknown"))
    histogram = edges.groupBy(relation.alias("key")).agg(F.count("*").alias("n"))
    return (
        rows(nodes.agg(F.count("*").alias("n")), "count", F.lit("nodes"), F.col("n"))
        .unionByName(rows(edges.agg(F.count("*").alias("n")), "count", F.lit("edges"), F.col("n")))
        .unionByName(rows(histogram, "relation", F.col("key"), F.col("n")))
        .unionByName(rows(central_nodes(edges, k), "central", F.col("id"), F.col("degree")))
    )


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with its degrees, zero where no edge touches it."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.join(degrees(edges), "id", "left").select(*nodes.columns, *[zero(c) for c in ("in_degree", "out_degree", "degree")])


def exchange_summary(nodes: DataFrame, edges: DataFrame, scope: Column, truncated: bool = False) -> DataFrame:
    """Node and edge counts per level, scope and relation, and the degree range, as rows."""
    full = node_degrees(nodes, edges).withColumn("scope", scope)
    count = F.count("*").alias("value")
    part = lambda df, section: df.select(F.lit(section).alias("section"), F.col("key"), F.col("value"))
    overall = full.agg(
        F.count("*").alias("node_count"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.coalesce(F.min("degree"), F.lit(0)).alias("min_degree"),
    ).withColumn("truncated", F.lit(int(truncated)).cast("long"))
    return (
        part(full.groupBy(F.col("level").alias("key")).agg(count), "level")
        .unionByName(part(full.groupBy(F.col("scope").alias("key")).agg(count), "scope"))
        .unionByName(part(edges.groupBy(F.col("relation").alias("key")).agg(count), "relation"))
        .unionByName(part(edges.agg(count).withColumn("key", F.lit("edge_count")), "summary"))
        .unionByName(part(overall.unpivot([], ["node_count", "max_degree", "min_degree", "truncated"], "key", "value"), "summary"))
    )


def filter_graph(
    nodes: DataFrame, edges: DataFrame, levels: Sequence[str] | None, relations: Sequence[str] | None, min_degree: int = 0,
    hidden: Sequence[str] = (), selected: str | None = None, focus: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(visible nodes, visible edges). Degrees count after the level and relation filter; structural levels ignore them.

    Candidates and the edges between them are worked out once; degrees decide on these two tables.
    """
    is_selected = F.col("id") == F.lit(selected) if selected is not None else F.lit(False)
    in_level = F.col("level").isin(*levels) if levels is not None else F.lit(True)
    candidates = nodes.filter(is_selected | (in_level & ~F.col("id").isin(*hidden)))
    if focus and selected is not None:
        touching = edges.filter((F.col("source") == selected) | (F.col("target") == selected))
        near = touching.select(F.explode(F.array("source", "target")).alias("id")).unionByName(candidates.filter(is_selected).select("id")).distinct()
        candidates = candidates.join(near, "id", "left_semi")
    candidates = pin(candidates)
    kept = edges.filter(F.col("relation").isin(*relations)) if relations is not None else edges
    between = lambda rows, ids: rows.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    inner = between(kept, candidates)
    if min_degree > 0:
        inner = pin(inner)
        counted = candidates.join(degrees(inner).select("id", "degree"), "id", "left")
        exempt = F.col("level").isin(*STRUCTURAL_LEVELS) | is_selected
        candidates = pin(counted.filter(exempt | (F.col("degree") >= min_degree)).drop("degree"))
        inner = between(inner, candidates)
    return candidates, inner.select(*edges.columns)


def neighbours(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, direction: str = "both") -> DataFrame:
    """Outgoing and incoming neighbours of the ``wanted`` node ids, with the neighbour's attributes."""
    sides = []
    for name, here, there in (("outgoing", "source", "target"), ("incoming", "target", "source")):
        if direction in ("both", name):
            sides.append(
                edges.join(wanted.select(F.col("id").alias(here)), here, "left_semi")
                .select(F.col(here).alias("node"), F.lit(name).alias("direction"), "relation", F.col("id").alias("edge_id"), F.col(there).alias("id"))
            )
    return reduce(DataFrame.unionByName, sides).join(nodes, "id", "left").withColumnRenamed("id", "neighbour")


def cap_with_flag(rows: DataFrame, order: Sequence[Column | str], maximum: int) -> DataFrame:
    """First ``maximum`` rows in a total order; every row says how many were left out."""
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(*order).limit(maximum).withColumn("omitted", F.greatest(F.lit(0), total - maximum)).withColumn("truncated", F.col("omitted") > 0)


def restore_edges(routes: DataFrame, calls: DataFrame) -> DataFrame:
    """Edge rows for the ids a route names, by id only; missing ones are flagged."""
    wanted = routes.select("route_id", F.posexplode("edge_ids").alias("position", "id"))
    found = calls.withColumn("_found", F.lit(True))
    return wanted.join(found, "id", "left").withColumn("missing", F.col("_found").isNull()).drop("_found")


def remap_aggregated_edges(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """(original id -> retained id) after parallel edges were merged."""
    keys = ["source", "target", "relation", "dispatch"]
    return edges.select("id", *keys).join(merged.select(*keys, F.col("id").alias("retained_id")), keys).select("id", "retained_id")


def reachable(edges: DataFrame, seeds: DataFrame, direction: str = "forward", level: str | None = None) -> DataFrame:
    """All (seed, node) pairs with a path from (or to) the seed, the seed itself included; cycles end by themselves."""
    here, there = ("source", "target") if direction == "forward" else ("target", "source")
    return walk(seeds.select("seed", F.col("seed").alias("node")), edges.select(F.col(here).alias("node"), F.col(there).alias("next")), level=level)


def shortest_paths(edges: DataFrame, sources: DataFrame, max_depth: int = 6) -> DataFrame:
    """Fewest-edge path per (source, node) within ``max_depth``; ties go to the smaller (target, edge id) steps."""
    hops = pin(edges.select(F.col("source").alias("node"), F.col("target").alias("_t"), F.col("id").alias("_e")))
    step = F.struct(F.col("_t").alias("node"), F.col("_e").alias("edge"))
    none = F.array().cast("array<struct<node:string,edge:string>>")
    level = pin(sources.select("s", F.col("s").alias("node"), none.alias("steps")))
    levels = [level]
    for _ in range(max_depth):
        seen = reduce(DataFrame.unionByName, [x.select("s", "node") for x in levels])
        level = pin(
            level.join(hops, "node").select("s", F.col("_t").alias("node"), F.array_append("steps", step).alias("steps"))
            .groupBy("s", "node").agg(F.min("steps").alias("steps")).join(seen, ["s", "node"], "left_anti")
        )
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels[1:]) if len(levels) > 1 else levels[0].limit(0)


def path_variants(
    edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int = 6, max_variants: int | None = 8, max_states: int | None = 2048
) -> DataFrame:
    """Simple paths from ``sources`` (s) to ``targets`` (t), shortest first; parallel edges are different paths.

    Regions that cannot reach a target are dropped first. ``max_states`` bounds the open paths per
    source and level, ``max_variants`` the kept paths per pair; either cut, or a path that met the
    depth bound or a cycle, sets ``truncated`` for the whole source.
    """
    # a node is relevant when it reaches any target: one marker closure backward, whatever the number of targets
    hops = stored(edges.select(F.col("source").alias("node"), F.col("target").alias("_t"), F.col("id").alias("_e")))
    marked = stored(walk(targets.select(F.col("t").alias("node")), hops.select(F.col("_t").alias("node"), F.col("node").alias("next"))))
    hops = stored(hops.join(marked.select(F.col("node").alias("_t")), "_t", "left_semi"))
    open_paths = stored(sources.select("s").distinct().join(marked.select(F.col("node").alias("s")), "s", "left_semi").select(
        "s", F.col("s").alias("t"), F.array("s").alias("nodes"), F.array().cast("array<string>").alias("edge_ids")))
    levels, cuts = [open_paths], []
    for depth in range(max_depth + 1):
        grown = open_paths.join(hops, F.col("t") == F.col("node"))
        cyclic = F.array_contains("nodes", F.col("_t"))
        if depth == max_depth:
            cuts.append(grown.select("s").distinct())
            break
        grown = stored(grown.select(
            "s", F.col("_t").alias("t"), F.array_append("nodes", F.col("_t")).alias("nodes"), F.array_append("edge_ids", F.col("_e")).alias("edge_ids"), cyclic.alias("_cyclic")))
        cuts.append(grown.filter("_cyclic").select("s").distinct())
        open_paths = grown.filter("not _cyclic").drop("_cyclic")
        if max_states is not None:
            ranked = stored(top_n(open_paths, ["s"], ["edge_ids"], max_states + 1))
            cuts.append(ranked.filter(F.col("rn") > max_states).select("s"))
            open_paths = ranked.filter(F.col("rn") <= max_states).drop("rn")
        if open_paths.isEmpty():
            break
        levels.append(open_paths)
    found = reduce(DataFrame.unionByName, levels).join(targets.select("t").distinct(), "t", "left_semi").withColumn("hops", F.size("edge_ids"))
    if max_variants is not None:
        ranked = top_n(found, ["s", "t"], ["hops", "edge_ids"], max_variants + 1)
        found = stored(ranked)
        cuts.append(found.filter(F.col("rn") > max_variants).select("s"))
        found = found.filter(F.col("rn") <= max_variants).drop("rn")
    flags = reduce(DataFrame.unionByName, cuts).distinct().withColumn("truncated", F.lit(True))
    return found.join(flags, "s", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def fair_neighbours(edges: DataFrame, target: str, order: Sequence[str], per_target: int = 8, max_edges: int | None = None) -> DataFrame:
    """Every target gets its first incoming edge before any gets a second; a cap per target and, if given, one for all, both flagged."""
    ranked = top_n(edges, [target], order, per_target, "turn")
    totals = edges.groupBy(target).agg(F.count("*").alias("_available"))
    kept = ranked if max_edges is None else ranked.orderBy("turn", target, *order).limit(max_edges)
    over = F.lit(False) if max_edges is None else ranked.agg(F.count("*") > max_edges).scalar()
    flagged = kept.join(totals, target).withColumn("omitted_for_target", F.greatest(F.lit(0), F.col("_available") - per_target))
    return flagged.withColumn("budget_reached", over).drop("_available")


def incoming_context(edges: DataFrame, targets: DataFrame, depth: int = 2, per_target: int = 8, max_edges: int | None = None) -> DataFrame:
    """Callers of the targets, round by round, under the fair caps; a node is expanded once."""
    calls = stored(edges.filter("source <> target"))
    frontier, seen, rounds = targets.select(F.col("id").alias("target")).distinct(), None, []
    for number in range(1, depth + 1):
        part = stored(fair_neighbours(calls.join(frontier, "target", "left_semi"), "target", ["id"], per_target, max_edges))
        rounds.append(part.withColumn("round", F.lit(number)))
        seen = frontier if seen is None else seen.unionByName(frontier)
        frontier = part.select(F.col("source").alias("target")).distinct().join(seen, "target", "left_anti")
    return reduce(DataFrame.unionByName, rounds)


def canonical(aliases: DataFrame, hops: int = 8) -> DataFrame:
    """(id, canonical): follow alias links at most ``hops`` times by pointer jumping; the link count doubles each round."""
    links = pin(aliases.select("id", F.col("alias").alias("to"), F.lit(1).alias("steps")))
    # jump[k] moves 2**k links, or to the end of a shorter chain
    jump, done = links, 1
    while done * 2 <= hops:
        nxt = jump.select(F.col("id").alias("to"), F.col("to").alias("_far"), F.col("steps").alias("_more"))
        jump = pin(jump.join(nxt, "to", "left").select(
            "id", F.coalesce("_far", "to").alias("to"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps")))
        done *= 2
    if done != hops:
        raise ValueError("hops must be a power of two")
    return jump.select("id", F.col("to").alias("canonical"))


def ancestors(bases: DataFrame) -> DataFrame:
    """(type, ancestor, level) for every type with a base, at any depth; level is the shortest distance, cycles end by themselves."""
    hops = pin(bases.select(F.col("type").alias("node"), F.col("base").alias("next")).distinct())
    found = walk(hops.select(F.col("node").alias("type"), "node").distinct(), hops, level="level")
    return found.filter("type <> node").select("type", F.col("node").alias("ancestor"), "level")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of the undirected links (a, b): the smallest node it hangs together with.

    Alternating stars: larger neighbours, then smaller ones, are hung on the smallest neighbour, until
    nothing moves. Smallest neighbours are partial aggregates, so a hub is never gathered, and rounds
    grow with the logarithm of the longest chain.
    """
    nodes = stored(links.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("_m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("_m"))
        hung = large.join(lower, "a")
        small = hung.filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(lower.select("a", F.col("_m").alias("b")))
        after = stored(small.distinct())
        if edges.count() == after.count() and after.join(edges, ["a", "b"], "left_anti").isEmpty():
            break
        edges = after
    return nodes.join(edges.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("b", "id").alias("component"))


def nearest_declaring_ancestor(lookups: DataFrame, members: DataFrame, up: DataFrame, kinds: DataFrame) -> DataFrame:
    """Owner of each looked-up member (type, member): the type itself, else its most derived declaring ancestors.

    A class beats an interface; more than one remaining owner is ambiguous. ``up`` comes from ``ancestors``.
    """
    own = lookups.join(members, ["type", "member"], "left_semi").select("type", "member", F.col("type").alias("owner"), F.lit(0).alias("level"))
    rest = lookups.join(members, ["type", "member"], "left_anti")
    above = (
        rest.join(up, "type").join(members.select(F.col("type").alias("ancestor"), "member"), ["ancestor", "member"])
        .join(kinds.select(F.col("type").alias("ancestor"), "kind"), "ancestor")
    )
    best = above.groupBy("type", "member").agg(F.max(F.col("kind") != "interface").alias("_class"))
    above = above.join(best, ["type", "member"]).filter(~F.col("_class") | (F.col("kind") != "interface")).select("type", "member", F.col("ancestor").alias("owner"), "level")
    covered = (
        above.select("type", "member", F.col("owner").alias("_lower"))
        .join(up.select(F.col("type").alias("_lower"), F.col("ancestor").alias("owner")), "_lower").select("type", "member", "owner").distinct()
    )
    chosen = own.unionByName(above.join(covered, ["type", "member", "owner"], "left_anti"))
    owners = chosen.groupBy("type", "member").agg(F.count("*").alias("owners"))
    return chosen.join(owners, ["type", "member"]).withColumn("ambiguous", F.col("owners") > 1)
