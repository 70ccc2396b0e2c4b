"""Declarative rules matched against calls, accesses and functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def call_shape(
    first_text: Column, first_is_literal: Column, arguments: Column, shell_keyword: Column, parameter_present: Column, mode_literal: Column
) -> Column:
    """Shape of a call: shell flag, how the query is built, whether parameters are bound, file mode."""
    return F.struct(
        F.when(first_is_literal, "literal").when(first_text.startswith("f"), "formatted").otherwise("dynamic").alias("query_shape"),
        F.when(shell_keyword == "true", True).when(shell_keyword == "false", False).alias("shell"),
        parameter_present.alias("parameter_present"), F.coalesce(mode_literal, F.lit("r")).alias("file_mode"),
        F.size(arguments).cast("long").alias("argument_count"),
    )


def load_rules(rules, language: str):
    """Rules of the packs that apply to a language; rules are rows, so packs are added by ``unionByName``."""
    return rules.filter(F.array_contains("languages", language))


def rule_coverage(rules):
    """Per pack and language: rules of each type and the categories they bring, as counts over flat rows."""
    flat = rules.select("pack", F.explode("languages").alias("language"), "rule_type", "fact_kind", "category")
    return flat.groupBy("pack", "language").agg(
        *[F.count_if(F.col("rule_type") == t).alias(f"{t}_rules") for t in ("call", "access", "entrypoint")],
        *[F.countDistinct(F.when(F.col("fact_kind") == k, F.col("category"))).alias(f"{k}_categories") for k in ("source", "sink")],
    )


def dotted_suffixes(name: Column) -> Column:
    """``a.b.c`` gives (a.b.c, whole), (b.c, not whole), (c, not whole)."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("suffix"), (i == 1).alias("whole")))


def match_call_rules(calls, rules):
    """(rule hits, typed failures). A call meets a rule by an equi join on language and name suffix.

    ``calls``: callsite_id, language, name, symbol, receiver_type, headers, project_defined, shadowed,
    conditions_state ('true', 'false', 'unknown' per call). ``rules``: rule_id, language, name,
    match_suffix, receiver_types, required_headers, conditional, fact_kind, category.
    """
    shadowed = calls.filter("shadowed").select("callsite_id", F.lit("api_name_shadowed").alias("reason"), F.lit(None).cast("string").alias("rule_id"))
    named = calls.filter("not shadowed").withColumn("_s", F.explode(dotted_suffixes(F.col("name"))))
    met = named.select("*", F.col("_s.suffix").alias("rule_name"), F.col("_s.whole").alias("_whole")).drop("_s").join(
        rules.withColumnRenamed("name", "rule_name"), ["language", "rule_name"]).filter("_whole or match_suffix")
    met = met.filter((F.size("receiver_types") == 0) | F.array_contains("receiver_types", F.col("receiver_type")))
    guarded = F.size("required_headers") > 0
    met = met.filter(~(guarded & F.col("project_defined")))
    outcome = (
        F.when(guarded & ~F.arrays_overlap("required_headers", "headers"), "api_header_not_visible")
        .when(F.col("conditional") & (F.col("conditions_state") == "unknown"), "rule_condition_unresolved")
        .when(F.col("conditional") & (F.col("conditions_state") == "false"), "no_match").otherwise("match")
    )
    met = met.withColumn("_outcome", outcome)
    hits = met.filter("_outcome = 'match'").select("callsite_id", "rule_id", "fact_kind", "category", "symbol", "name",
                                                   F.when(F.col("_whole"), "exact_name").otherwise("name_suffix").alias("basis")).distinct()
    header = met.filter("_outcome = 'api_header_not_visible'").select("callsite_id", F.col("_outcome").alias("reason"), "rule_id")
    open_conditions = met.filter("_outcome = 'rule_condition_unresolved'").select("callsite_id", F.col("_outcome").alias("reason"), F.lit(None).cast("string").alias("rule_id")).distinct()
    return hits, shadowed.unionByName(header).unionByName(open_conditions)


def header_guard(calls, headers: list[str]):
    """Per call: whether a required header is visible, which ones, and whether the rule applies."""
    required = F.array(*[F.lit(h) for h in headers])
    return calls.withColumn("visible_headers", F.array_sort(F.array_intersect(required, "headers"))).withColumn(
        "verdict",
        F.when(F.col("project_defined"), "project_defined").when(F.size("visible_headers") == 0, "api_header_not_visible").otherwise("applies"),
    )


def match_access_rules(accesses, rules):
    """Exact name, access kind and language."""
    return accesses.join(rules.withColumnRenamed("name", "rule_name"), (F.col("qualified_name") == F.col("rule_name")) & (accesses["language"] == rules["language"])).filter(
        F.array_contains("access_kinds", F.col("access_kind"))).select("access_id", "rule_id", "fact_kind", "category")


def match_entrypoints(functions, decorators, registrations, factories, rule: dict):
    """Routes of functions for one framework rule: decorator first, then owned method, then registration.

    ``functions``: symbol, name, file, owner_type. ``decorators``: symbol, position, qualified_name,
    literal. ``registrations``: name, handler, literal, prefix, file. ``factories``: file, target.
    """
    receiver, method = F.regexp_extract("qualified_name", r"^(.*)\.[^.]*$", 1), F.element_at(F.split("qualified_name", r"\."), -1)
    route = F.coalesce("literal", F.lit("<dynamic>"))
    direct = decorators.join(functions.select("symbol", "file"), "symbol").withColumn("receiver", F.split(receiver, r"\.")[0]).withColumn("method", method)
    decorated = direct.filter(F.col("method").isin(*rule["decorator_methods"])).join(
        factories.select("file", F.col("target").alias("receiver")).distinct(), ["file", "receiver"], "left_semi")
    decorated = decorated.groupBy("symbol").agg(F.min(F.struct("position", "method", route.alias("route"))).alias("d")).select("symbol", "d.method", "d.route", F.lit(1).alias("rung"))
    mapping = F.create_map(*[F.lit(x) for pair in rule["owner_methods"].items() for x in pair])
    suffix = F.element_at(F.split("owner_type", r"\."), -1)
    owned = functions.filter(suffix.isin(*rule["owner_suffixes"])).select("symbol", F.element_at(mapping, F.col("name")).alias("method"), F.lit("<container-mapped>").alias("route"), F.lit(2).alias("rung")).filter("method is not null")
    verbs = F.create_map(*[F.lit(x) for pair in rule["registration_methods"].items() for x in pair])
    joined = F.when(F.col("literal").isNull(), "<dynamic>").when(F.col("prefix") == "", F.col("literal")).otherwise(
        F.concat(F.regexp_replace("prefix", "/+$", ""), F.lit("/"), F.regexp_replace("literal", "^/+", "")))
    registered = registrations.withColumn("method", F.element_at(verbs, F.element_at(F.split("name", r"\."), -1))).filter("method is not null").join(
        functions.select("symbol", F.col("name").alias("handler"), "file"), ["file", "handler"]).select("symbol", "method", joined.alias("route"), F.lit(3).alias("rung")).distinct()
    every = decorated.unionByName(owned).unionByName(registered)
    best = every.groupBy("symbol").agg(F.min("rung").alias("rung"))
    return every.join(best, ["symbol", "rung"]).withColumn(
        "basis", F.element_at(F.array(F.lit("decorator"), F.lit("owned_method"), F.lit("registration")), F.col("rung"))).drop("rung")


def entrypoint_parameters(routes, parameters, rule: dict):
    """Parameters of entry points as facts: dependencies become guards, the rest become sources with a category."""
    entry = routes.select("symbol", "method").dropDuplicates(["symbol"])
    rows = parameters.join(entry, "symbol").filter(~F.col("name").isin("self", "cls") & ~F.col("annotation").isin(*rule["excluded_annotations"]))
    guard = F.lit(False)
    for end in rule["dependency_suffixes"]:
        guard = guard | F.col("default_call").endswith(end)
    category = F.lit(rule["default_category"])
    for fragment, name in reversed(rule["annotation_categories"]):
        category = F.when(F.contains("annotation", F.lit(fragment)), name).otherwise(category)
    category = F.when(F.col("method").isin(*rule["websocket_methods"]) & (category == rule["default_category"]), "websocket_input").otherwise(category)
    return rows.select("symbol", "name", F.when(guard, "guard").otherwise("source").alias("fact_kind"), F.when(guard, "framework_dependency").otherwise(category).alias("category"))


def check_slot_proposals(effects, signatures):
    """Violations of proposed return effects (call, component, member, argument) against known signatures."""
    rows = effects.join(signatures, "call")
    bad = lambda df, reason: df.select("call", F.lit(reason).alias("reason")).distinct()
    repeated = effects.groupBy("call", "component", "member").agg(F.count("*").alias("n")).filter("n > 1")
    return (
        bad(repeated, "duplicate_slot")
        .unionByName(bad(rows.filter(F.col("return_count").isNotNull() & (F.col("component") >= F.col("return_count"))), "component_out_of_range"))
        .unionByName(bad(rows.filter((F.col("argument") < 0) | (F.col("argument") >= F.col("argument_count"))), "argument_out_of_range"))
        .unionByName(bad(rows.filter((F.col("condition_index") >= F.col("argument_count"))), "condition_slot_out_of_range"))
    )
