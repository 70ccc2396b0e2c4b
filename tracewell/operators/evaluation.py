"""Citation checks, scores and paired statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.ids import _tidy
from tracewell.operators.skew import running_sums

# A bracketed reference, a citation, and what merely looks like one.
_BRACKET = r"\[([^\]\n]+)\]"
_CITATION = r"^([^:\]\n]+):(?:L)?(\d+)(?:\s*-\s*(?:L)?(\d+))?$"
_LOOKS_LIKE = r":\s*(?:L)?\d|\bL\d|同文件|同上"


def parse_citations(answers: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct citations per answer; references that only look like one are marked malformed."""
    raw = answers.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(_BRACKET), F.lit(1)))).alias("raw"))
    body = F.trim("raw")
    path = F.trim(F.replace(F.regexp_extract(body, _CITATION, 1), F.lit("\\"), F.lit("/")))
    good = body.rlike(_CITATION) & ~path.isin("同文件", "同上")
    start = F.regexp_extract(body, _CITATION, 2).try_cast("bigint")
    end = F.coalesce(F.regexp_extract(body, _CITATION, 3).try_cast("bigint"), start)
    return (
        raw.filter(good | F.col("raw").rlike(_LOOKS_LIKE))
        .select(
            key, F.when(good, _tidy(path)).otherwise(F.col("raw")).alias("cited_path"), F.when(good, start).alias("start_line"),
            F.when(good, end).alias("end_line"), (~good).alias("malformed"),
        )
        .distinct()
    )


def check_citations(citations: DataFrame, manifest: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """Mechanical verdict per citation (key, cited_path, start_line, end_line).

    ``manifest``: path, lines. ``shown``: path, line, final (true for the last request). Abbreviated paths
    resolve when exactly one manifest path ends with them; only ranges inside the file are spread out
    to lines.
    """
    outside = F.col("cited_path").startswith("/") | F.col("cited_path").rlike(r"(^|/)\.\.(/|$)") | F.contains("cited_path", F.lit(":"))
    parts = F.split("path", "/")
    suffixes = manifest.select("path", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("cited_path")).filter("cited_path <> ''")
    short = suffixes.groupBy("cited_path").agg(F.count("*").alias("_n"), F.min("path").alias("_only"))
    exact = manifest.select(F.col("path").alias("cited_path"), F.lit(True).alias("_exact"))
    work = citations.join(exact, "cited_path", "left").join(short, "cited_path", "left")
    path = F.when(F.col("_exact"), F.col("cited_path")).when(F.col("_n") == 1, F.col("_only"))
    early = F.when(outside, "path_outside_snapshot").when(path.isNull(), F.when(F.col("_n") > 1, "path_ambiguous").otherwise("path_not_in_snapshot"))
    work = work.withColumn("path", F.when(early.isNull(), path)).withColumn("_early", early).drop("_only").join(manifest.select("path", "lines"), "path", "left")
    reason = F.coalesce("_early", F.when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "invalid_line_range").when(F.col("lines").isNull(), "line_count_unavailable")
                        .when(F.col("end_line") > F.col("lines"), "line_out_of_range"))
    work = work.withColumn("_reason", reason).withColumn("abbreviated", F.coalesce(F.col("_early").isNull() & F.col("_exact").isNull(), F.lit(False)))
    ident = [key, "cited_path", "start_line", "end_line"]
    cited = work.filter("_reason is null").select(*ident, "path", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    lines = shown.groupBy("path", "line").agg(F.max("final").alias("final"))
    seen = cited.join(lines, ["path", "line"]).groupBy(*ident).agg(F.count("*").alias("_seen"), F.count_if("final").alias("_final"))
    joined = work.join(seen, ident, "left")
    span = F.col("end_line") - F.col("start_line") + 1
    final = F.coalesce("_reason", F.when(F.coalesce("_seen", F.lit(0)) < span, "source_not_shown"))
    exposure = F.when(final.isNull(), F.when(F.col("_final") == span, "final_request").otherwise("earlier_request"))
    return joined.select(*ident, "path", "abbreviated", final.alias("reason"), exposure.alias("exposure"))


def citation_receipts(checked: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """Requests that showed some line of an accepted citation (key, cited_path, start_line, end_line, request_id, notice).

    ``checked`` comes from ``check_citations``. ``shown``: path, line, request_id. ``notice`` marks
    citations whose lines were all shown, but not all in the last request. One flat row per request.
    """
    ident = [key, "cited_path", "start_line", "end_line"]
    lines = checked.filter("reason is null").select(*ident, "path", (F.col("exposure") == "earlier_request").alias("notice"), F.explode(F.sequence("start_line", "end_line")).alias("line"))
    return lines.join(shown.select("path", "line", "request_id"), ["path", "line"]).select(*ident, "request_id", "notice").distinct()


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b)


def precision_and_recall(facts: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Factual precision: mean of 1, 0.5 and 0. Required recall: weighted coverage with weights 2 and 1."""
    precision = facts.groupBy(key).agg(F.avg("score").alias("factual_precision"))
    recall = points.groupBy(key).agg(ratio(F.sum(F.col("weight") * F.col("score")), F.sum("weight")).alias("required_recall"))
    return precision.join(recall, key, "full")


def f1(hit: Column, predicted: Column, gold: Column) -> Column:
    """2 * hits over both sizes: the harmonic mean of precision and recall."""
    return F.coalesce(ratio(2 * hit, predicted + gold), F.lit(0.0))


def _overlap(predicted: DataFrame, gold: DataFrame, columns: list[str], section: str) -> DataFrame:
    """One row: how many distinct items each side has and how many they share."""
    both = predicted.select(*columns).distinct().withColumn("_p", F.lit(1)).join(gold.select(*columns).distinct().withColumn("_g", F.lit(1)), columns, "full")
    return both.agg(F.count("_p").alias("predicted"), F.count("_g").alias("gold"), F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("hit")).withColumn("section", F.lit(section))


def relation_reasoning(predicted: DataFrame, gold: DataFrame, gold_steps: DataFrame, predicted_steps: DataFrame) -> DataFrame:
    """0.30 node F1 + 0.40 typed, directed edge F1 + 0.30 share of gold neighbour steps in the right order."""
    nodes = lambda df: df.select(F.explode(F.array("source", "target")).alias("node"))
    parts = (
        _overlap(nodes(predicted), nodes(gold), ["node"], "node").unionByName(_overlap(predicted, gold, ["source", "target", "relation"], "edge"))
        .unionByName(_overlap(predicted_steps, gold_steps, ["path", "before", "after"], "step"))
    )
    scored = parts.withColumn("score", F.when(F.col("section") == "step", F.coalesce(ratio(F.col("hit"), F.col("gold")), F.lit(0.0))).otherwise(f1(F.col("hit"), F.col("predicted"), F.col("gold"))))
    pick = lambda section, name: F.max(F.when(F.col("section") == section, F.col("score"))).alias(name)
    named = scored.agg(pick("node", "node_f1"), pick("edge", "edge_f1"), pick("step", "order_score"))
    return named.withColumn("relation_score", 0.30 * F.col("node_f1") + 0.40 * F.col("edge_f1") + 0.30 * F.col("order_score"))


def evidence_quality(citations: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """0.30 valid + 0.40 entailing + 0.30 covered claims, and the share of unsupported claims.

    ``citations``: valid, entails. ``claims``: is_key, correct, has_valid_citation, unsupported.
    """
    cited = citations.groupBy(key).agg(ratio(F.count_if("valid"), F.count("*")).alias("cp"), ratio(F.count_if("entails"), F.count("*")).alias("ce"))
    main = F.col("is_key") & F.col("correct")
    claimed = claims.groupBy(key).agg(ratio(F.count_if(main & F.col("has_valid_citation")), F.count_if(main)).alias("cc"), ratio(F.count_if("unsupported"), F.count("*")).alias("hallucination_rate"))
    return cited.join(claimed, key, "full").withColumn("evidence_quality", 0.30 * F.col("cp") + 0.40 * F.col("ce") + 0.30 * F.col("cc"))


def grounded_score(fp: Column, rr: Column, eqs: Column, ra: Column, severe: Column) -> Column:
    """100 (0.35 FP + 0.25 RR + 0.20 EQS + 0.20 RA), less 5 per severe error up to 20, within 0..100."""
    base = 100 * (0.35 * fp + 0.25 * rr + 0.20 * eqs + 0.20 * (ra - 1) / 4)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), base - F.least(F.lit(20.0), 5.0 * severe)))


def finding_confusion(findings: DataFrame, standard: DataFrame, kloc: float | Column) -> DataFrame:
    """TP / FP / FN per priority after root-cause matching; duplicates merged, plausible ones counted apart.

    ``findings``: root_cause, priority, verdict. ``standard``: root_cause, priority. A hit or a false
    alarm counts under the claimed priority, a miss under the expert's.
    """
    claimed = findings.groupBy("root_cause").agg(F.min("priority").alias("claimed"), F.min("verdict").alias("verdict"))
    true = standard.groupBy("root_cause").agg(F.min("priority").alias("expected"))
    both = claimed.join(true, "root_cause", "full")
    plausible = F.coalesce(F.col("verdict") == "plausible", F.lit(False))
    rows = both.select(
        F.coalesce(F.when(plausible & F.col("expected").isNotNull(), F.col("expected")), "claimed", "expected").alias("priority"), (F.col("claimed").isNotNull() & F.col("expected").isNotNull() & ~plausible).alias("tp"),
        (F.col("claimed").isNotNull() & F.col("expected").isNull() & ~plausible).alias("fp"), (F.col("expected").isNotNull() & (F.col("claimed").isNull() | plausible)).alias("fn"), plausible.alias("p"))
    out = rows.groupBy("priority").agg(F.count_if("tp").alias("tp"), F.count_if("fp").alias("fp"), F.count_if("fn").alias("fn"), F.count_if("p").alias("plausible"))
    return out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn(
        "f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("fp_per_kloc", F.col("fp") / kloc)


def severity_agreement(pairs: DataFrame, levels: int = 4) -> DataFrame:
    """Exact and within-one rates, mean absolute error and linearly weighted kappa of (a, b) levels, from the crosstab only."""
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = F.sum("n")
    distance = F.abs(F.col("a") - F.col("b"))
    seen = cells.agg(total.alias("pairs"), (F.sum(F.when(distance == 0, F.col("n")).otherwise(0)) / total).alias("exact_rate"), (F.sum(F.when(distance <= 1, F.col("n")).otherwise(0)) / total).alias("within_one_rate"),
                     (F.sum(distance * F.col("n")) / total).alias("mean_absolute_error"))
    # levels are few: marginals meet through their own small table, on an explicit list of partner levels
    left = cells.groupBy("a").agg(F.sum("n").alias("na")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    right = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    expected = left.join(right, "b").agg(F.sum(F.abs(F.col("a") - F.col("b")) * F.col("na") * F.col("nb")).alias("e"))
    return seen.withColumn("weighted_kappa", 1 - F.try_divide(F.col("mean_absolute_error"), expected.scalar() / (F.col("pairs") * F.col("pairs"))))


PRIORITY_WEIGHT = {0: 8, 1: 4, 2: 2, 3: 1}


def priority_weight(level: Column) -> Column:
    out = F.lit(1)
    for number, weight in PRIORITY_WEIGHT.items():
        out = F.when(level == number, weight).otherwise(out)
    return out


def discovery_score(findings: DataFrame) -> DataFrame:
    """Severity-weighted recall and false share, and the combined score with its penalties.

    ``findings``: claimed, expected (levels, null when absent), located (0..1), fabricated.
    """
    hit, false_alarm = F.col("claimed").isNotNull() & F.col("expected").isNotNull(), F.col("claimed").isNotNull() & F.col("expected").isNull()
    weight = lambda c: priority_weight(F.col(c))
    part = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0))
    totals = findings.agg(
        ratio(part(hit, weight("expected")), part(F.col("expected").isNotNull(), weight("expected"))).alias("swr"),
        ratio(part(false_alarm, weight("claimed")), part(F.col("claimed").isNotNull(), weight("claimed"))).alias("swf"),
        ratio(F.count_if(hit), F.count("claimed")).alias("sp"), ratio(F.count_if(hit), F.count("expected")).alias("sr"), ratio(F.count_if(hit & F.col("located")), F.count_if(hit)).alias("location"),
        ratio(F.count_if(hit & (F.abs(F.col("claimed") - F.col("expected")) <= 1)), F.count_if(hit)).alias("paa"),
        (10 * F.count_if(F.col("fabricated") & (F.col("claimed") <= 1)) + 3 * F.count_if(F.col("fabricated") & (F.col("claimed") > 1))).alias("penalty"))
    score = 100 * (0.30 * F.col("swr") + 0.25 * F.col("sp") + 0.15 * F.col("sr") + 0.15 * F.col("location") + 0.15 * F.col("paa")) - F.col("penalty")
    return totals.withColumn("discovery_score", F.greatest(F.lit(0.0), score))


def net_win_rate(pairs: DataFrame, key: str) -> DataFrame:
    """(wins + half the ties) over valid pairs."""
    count = lambda v: F.count_if(F.col("outcome") == v)
    return pairs.groupBy(key).agg(count("win").alias("wins"), count("tie").alias("ties"), count("loss").alias("losses"), ((count("win") + 0.5 * count("tie")) / F.count("*")).alias("net_win_rate"))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles from running counts of distinct values; no group is gathered."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    cum = running_sums(counts, keys, ["_v"], {"_c": F.col("_n")})
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    joined = cum.join(totals, keys) if keys else cum.withColumn("_t", totals.select("_t").scalar())
    aggs = []
    for name, q in wanted.items():
        place = (F.col("_t") - 1) * F.lit(q)
        low = F.min(F.when(F.col("_c") > F.floor(place), F.col("_v")))
        high = F.min(F.when(F.col("_c") > F.ceil(place), F.col("_v")))
        share = F.max(place - F.floor(place))
        aggs.append((low + (high - low) * share).alias(name))
    return joined.groupBy(*keys).agg(*aggs) if keys else joined.agg(*aggs)


def paired_summary(pairs: DataFrame, key: str) -> DataFrame:
    """Mean and quantiles of both lanes and of the paired difference, per ``key``. ``pairs``: a, b."""
    long = pairs.select(key, F.explode(F.array(F.struct(F.lit("a").alias("lane"), F.col("a").alias("v")), F.struct(F.lit("b").alias("lane"), F.col("b").alias("v")), F.struct(F.lit("difference").alias("lane"), (F.col("a") - F.col("b")).alias("v")))).alias("x")).select(key, "x.*")
    means = long.groupBy(key, "lane").agg(F.count("*").alias("pairs"), F.avg("v").alias("mean"))
    return means.join(exact_quantiles(long, [key, "lane"], "v", {"median": 0.5, "p90": 0.9, "p95": 0.95}), [key, "lane"])


def macro_average(pairs: DataFrame, key: str) -> DataFrame:
    """Mean over projects of their mean difference, so that a large project does not decide."""
    per = pairs.groupBy(key).agg(F.avg(F.col("a") - F.col("b")).alias("d"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("projects"), F.avg("d").alias("macro_difference"), (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("micro_difference"))


def wilcoxon_signed_rank(pairs: DataFrame) -> DataFrame:
    """Signed-rank sums with average ranks for ties, and the normal approximation. Zero differences are dropped."""
    signs = pairs.select((F.col("a") - F.col("b")).alias("d")).filter("d <> 0")
    sizes = signs.groupBy(F.abs("d").alias("m")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = running_sums(sizes, [], ["m"], {"c": F.col("n")}).withColumn("rank", F.col("c") - (F.col("n") - 1) / 2)
    out = ranked.agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("w_minus"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("_ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    return out.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / spread).drop("_ties")


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Discordant pairs of two binary outcomes and the continuity-corrected statistic."""
    out = pairs.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"))
    return out.withColumn("statistic", F.try_divide(F.pow(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(2)), F.col("only_a") + F.col("only_b")))


# Cumulative probabilities of a Poisson variable with mean 1.
POISSON_STEPS = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518)


def cluster_bootstrap(pairs: DataFrame, cluster: str, replicates: int = 200, seed: str = "s") -> DataFrame:
    """95 % interval of the mean paired difference, resampling whole clusters.

    Each cluster draws a Poisson weight per replicate from a hash, so the draw does not depend on the
    partitioning; clusters are summed first and replicates are pre-aggregated map-side.
    """
    sums = pairs.groupBy(cluster).agg(F.sum(F.col("a") - F.col("b")).alias("d"), F.count("*").alias("n"))
    drawn = sums.select(F.col(cluster).cast("string").alias("c"), "d", "n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "c", F.col("replicate").cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    weight = F.lit(0)
    for step in POISSON_STEPS:
        weight = weight + (u >= step).cast("int")
    means = drawn.withColumn("w", weight).groupBy("replicate").agg((F.sum(F.col("w") * F.col("d")) / F.sum(F.col("w") * F.col("n"))).alias("mean"))
    return exact_quantiles(means, [], "mean", {"low": 0.025, "high": 0.975})


# The seven pre-registered thresholds (rule, metric, comparison, bound).
DECISION_RULES = (
    ("graph_sensitive_gain", "gas_difference", ">=", 5.0), ("graph_sensitive_interval", "gas_difference_low", ">", 0.0), ("relation_gain", "rrs_difference", ">=", 0.08), ("net_wins", "net_win_rate", ">", 0.55),
    ("no_loss_elsewhere", "other_gas_difference_low", ">=", -3.0), ("hallucination_guard", "severe_rate_difference", "<=", 0.02), ("completion_guard", "completion_difference", ">=", -0.02),
    ("security_interval", "sds_difference_low", ">", 0.0), ("security_recall_interval", "swr_difference_low", ">", 0.0), ("precision_guard", "sp_difference", ">=", -0.03), ("fabrication_guard", "fabricated_difference", "<=", 0.0),
)


def decision_rule(metrics: DataFrame) -> DataFrame:
    """Threshold verdict per stratum; ``metrics``: stratum, metric, value. A missing metric fails its rule."""
    names = ("rule", "metric", "comparison", "bound")
    rules = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in DECISION_RULES])
    strata = metrics.select("stratum").distinct().withColumn("_rules", rules)
    wanted = strata.select("stratum", F.inline("_rules"))
    joined = wanted.join(metrics, ["stratum", "metric"], "left")
    ok = F.when(F.col("comparison") == ">=", F.col("value") >= F.col("bound")).when(F.col("comparison") == ">", F.col("value") > F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return joined.select("stratum", "rule", "metric", "value", "bound", F.coalesce(ok, F.lit(False)).alias("passed"))


def ledger_summary(findings: DataFrame, key: str) -> DataFrame:
    """Findings per status and closed chains per scope."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    return findings.groupBy(key).agg(
        *[count("status", s).alias(s) for s in ("source_supported_risk", "unclosed_candidate", "excluded")],
        *[F.count_if((F.col("chain_status") == "closed") & (F.col("chain_scope") == s)).alias(f"closed_{s}") for s in ("local_segment", "external_to_sink")])


LEDGER_SCHEMA = ("root_cause string, behavior_status string, chain struct<status:string,scope:string,start:struct<kind:string>,end:struct<kind:string>>, impact struct<status:string,scope:string>, "
                 "unresolved_conditions array<struct<kind:string>>, status string, exclusion_reason string")


def validate_ledger(findings: DataFrame, key: str, body: str) -> DataFrame:
    """Violations (key, category, rule) of finding documents: syntax first, then the state rules."""
    parsed = findings.select(key, F.from_json(body, LEDGER_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("f"))
    chain, impact = F.col("f.chain"), F.col("f.impact")
    kinds = F.coalesce(F.col("f.unresolved_conditions.kind"), F.array().cast("array<string>"))
    risk = F.col("f.status") == "source_supported_risk"
    endless = chain["start"].isNull() | chain["end"].isNull()
    unknown = F.coalesce(chain["start"]["kind"] == "unknown", F.lit(False)) | F.coalesce(chain["end"]["kind"] == "unknown", F.lit(False))
    rules = {
        "blank_root_cause": F.trim("f.root_cause") == "",
        "chain_gap_must_stay_open": F.array_contains(kinds, "chain_gap") & (chain["status"] != "open"),
        "external_impact_needs_closed_chain": (impact["scope"] == "external") & (impact["status"] != "not_established") & ~((chain["status"] == "closed") & (chain["scope"] == "external_to_sink")),
        "risk_with_open_conditions": risk & (F.size(F.array_except(kinds, F.array(F.lit("deployment")))) > 0),
        "risk_without_support": risk & ((F.col("f.behavior_status") != "observed") | (chain["status"] == "open") | (impact["status"] == "not_established") | (impact["scope"] == "unknown")),
        "exclusion_without_reason": (F.col("f.status") == "excluded") & (F.trim(F.coalesce("f.exclusion_reason", F.lit(""))) == ""),
        "conditional_without_conditions": (impact["status"] == "conditional") & (F.size(kinds) == 0),
        "not_applicable_with_endpoints": (chain["status"] == "not_applicable") & ((chain["scope"] != "not_applicable") | chain["start"].isNotNull() | chain["end"].isNotNull()),
        "chain_without_scope": (chain["status"] != "not_applicable") & (chain["scope"] == "not_applicable"),
        "closed_without_endpoints": (chain["status"] == "closed") & (chain["scope"] != "not_applicable") & (endless | unknown),
        "closed_with_wrong_endpoints": (chain["status"] == "closed") & (chain["scope"] == "external_to_sink") & ~endless & ~unknown & ((chain["start"]["kind"] != "external_input") | (chain["end"]["kind"] != "sensitive_operation")),
    }
    broken = F.col("f._bad").isNotNull()
    found = F.array_compact(F.array(
        F.when(broken, F.struct(F.lit("syntax").alias("category"), F.lit("not_valid_json").alias("rule"))),
        *[F.when(~broken & F.coalesce(cond, F.lit(False)), F.struct(F.lit("state").alias("category"), F.lit(name).alias("rule"))) for name, cond in rules.items()]))
    return parsed.select(key, F.explode(found).alias("v")).select(key, "v.*")


def progress_percent(done: Column, total: Column) -> Column:
    """Null without a positive total; halves round up, within 0..100."""
    return F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), F.floor(done * 100 / total + 0.5))))
