"""Small decisions on evidence: certainty, conditions, status and priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.ids import _col

SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2, "informational": 3}


def normalise_certainty(value: Column | str) -> Column:
    value = _col(value)
    return F.when(value.isin("must", "may"), value).otherwise("unresolved")


def normalise_confidence(value: Column | str) -> Column:
    value = _col(value)
    return F.when(value.isin("high", "medium"), value).otherwise("low")


def connection_status(certainty, confidence, truncated=False, unresolved_reason=None, fallback_reason=None) -> Column:
    """``modelled`` only for a certain, confident and complete binding."""
    clean = ~F.lit(truncated) if isinstance(truncated, bool) else ~truncated
    for reason in (unresolved_reason, fallback_reason):
        if reason is not None:
            clean = clean & (F.coalesce(_col(reason), F.lit("")) == "")
    certainty, confidence = _col(certainty), _col(confidence)
    return (
        F.when(certainty == "unresolved", "unresolved")
        .when((certainty == "must") & (confidence == "high") & clean, "modelled")
        .otherwise("possible")
    )


def is_speculative(dispatch: Column | str, method: Column | str) -> Column:
    return _col(dispatch).isin("dynamic", "virtual") | _col(method).endswith("_heuristic")


def graph_scope(node: Column | str, level: Column | str) -> Column:
    node, level = F.lower(_col(node)), F.lower(_col(level))
    return (
        F.when((level == "builtin") | node.startswith("<builtin>"), "builtin")
        .when(level.isin("stdlib", "stdlib_module") | node.startswith("<stdlib>"), "stdlib")
        .when(level.isin("external", "external_module") | node.startswith("<external>"), "external")
        .otherwise("project")
    )


def severity_rank(severity: Column | str) -> Column:
    severity = _col(severity)
    out = F.lit(None).cast("int")
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def certainty_rank(certainty: Column | str) -> Column:
    """must < may < unresolved: a route is as certain as its weakest step."""
    certainty = _col(certainty)
    return F.when(certainty == "must", 0).when(certainty == "may", 1).otherwise(2)


def conditions_match(arguments: Column, keywords: Column, open_keywords: Column, conditions: Column) -> Column:
    """Three-valued match: true, false, or null where a value cannot be known.

    ``arguments``: array<struct<literal string, is_literal boolean>>; ``keywords``: the same as a map.
    ``conditions``: array<struct<position int, keyword string, operator string, values array<string>,
    has_default boolean, default string>>. The first false or unknown condition decides.
    """

    def one(cond: Column) -> Column:
        by_position = F.when(
            cond["position"].isNotNull() & (F.size(arguments) > cond["position"]), F.get(arguments, cond["position"])
        )
        found = F.coalesce(by_position, F.when(cond["keyword"].isNotNull(), F.element_at(keywords, cond["keyword"])))
        value = F.when(found.isNull(), cond["default"]).otherwise(found["literal"])
        hit = F.exists(cond["values"], lambda v: F.contains(value, v))
        failed = (
            F.when(cond["operator"] == "equals", ~F.coalesce(F.array_contains(cond["values"], value), F.lit(False)))
            .when(cond["operator"] == "contains_any", ~F.coalesce(hit, F.lit(False)))
            .otherwise(value.isNull() | F.coalesce(hit, F.lit(False)))
        )
        return (
            F.when(found.isNull() & cond["keyword"].isNotNull() & open_keywords, "unknown")
            .when(found.isNull() & ~cond["has_default"], "false")
            .when(found.isNotNull() & ~found["is_literal"], "unknown")
            .when(failed, "false")
            .otherwise("true")
        )

    state = F.aggregate(conditions, F.lit("true"), lambda acc, cond: F.when(acc != "true", acc).otherwise(one(cond)))
    return F.when(state == "true", True).when(state == "false", False)


def preconditions(trust, source_category, sink_category, verified, extra: Column) -> Column:
    """Ordered conditions that a reader must still check, without repeats."""
    trust, source_category, sink_category = _col(trust), _col(source_category), _col(sink_category)
    fixed = F.array_compact(F.array(
        F.when(~_col(verified), "verify_value_reaches_sink"),
        F.when(trust == "external_configuration", "attacker_controls_configuration")
        .when(trust == "external_file", "attacker_controls_file")
        .when(source_category == "standard_input", "attacker_controls_standard_input"),
        F.when(sink_category == "network_request", "attacker_controls_remote_target")
        .when(sink_category == "security_sensitive_random", "random_value_is_security_sensitive")
        .when(sink_category == "file_write", "attacker_controls_write_path_or_content")
        .when(sink_category == "file_path", "attacker_controls_file_path")
        .when(sink_category == "format_string", "untrusted_data_is_the_format_string"),
    ))
    return F.concat(fixed, F.array_distinct(extra))
