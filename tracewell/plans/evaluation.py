"""Evaluation queries: scores, agreement and paired statistics over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import evaluation
from tracewell.plans.registry import query
from tracewell.views import with_views


@query("agg20_ledger_summary", """SELECT source AS scope, count(*) FILTER (WHERE st = 'source_supported_risk') AS source_supported_risk, count(*) FILTER (WHERE st = 'unclosed_candidate') AS unclosed_candidate, count(*) FILTER (WHERE st = 'excluded') AS excluded, count(*) FILTER (WHERE st <> 'unclosed_candidate' AND lang = 'en') AS closed_local_segment,
 count(*) FILTER (WHERE st <> 'unclosed_candidate' AND lang <> 'en') AS closed_external_to_sink FROM (SELECT d.*, CASE WHEN toxic = 1 THEN 'source_supported_risk' WHEN quality = 1 THEN 'unclosed_candidate' ELSE 'excluded' END AS st FROM labels JOIN documents d USING (doc_id)) x GROUP BY source""")
def agg20(t):
    rows = t.labels.join(t.documents.select("doc_id", "source", "lang"), "doc_id")
    status = F.when(F.col("toxic") == 1, "source_supported_risk").when(F.col("quality") == 1, "unclosed_candidate").otherwise("excluded")
    findings = rows.select(F.col("source").alias("scope"), status.alias("status"), F.when(status == "unclosed_candidate", "open").otherwise("closed").alias("chain_status"),
                           F.when(F.col("lang") == "en", "local_segment").otherwise("external_to_sink").alias("chain_scope"))
    return evaluation.ledger_summary(findings, "scope")


@query("agg24_precision_and_recall", """WITH j AS (SELECT d.lang, CASE WHEN toxic = 1 THEN 0.5 WHEN quality = 1 THEN 1 ELSE 0 END AS s, CASE WHEN n_chars > 1000 THEN 2 ELSE 1 END AS w FROM labels JOIN documents d USING (doc_id)) SELECT lang, avg(s) AS factual_precision, CAST(sum(w * s) AS DOUBLE) / sum(w) AS required_recall FROM j GROUP BY lang""", rounded=("factual_precision", "required_recall"))
def agg24(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    scored = rows.select("lang", F.when(F.col("toxic") == 1, 0.5).when(F.col("quality") == 1, 1.0).otherwise(0.0).alias("score"), F.when(F.col("n_chars") > 1000, 2).otherwise(1).alias("weight"))
    return evaluation.precision_and_recall(scored, scored, "lang")


_REL = """p AS (SELECT DISTINCT concat('o', l_orderkey) AS s, concat('s', l_suppkey) AS t FROM lineitem WHERE l_returnflag <> 'N'), q AS (SELECT DISTINCT concat('o', l_orderkey) AS s, concat('s', l_suppkey) AS t FROM lineitem WHERE l_linestatus = 'O'),
 pn AS (SELECT s AS x FROM p UNION SELECT t FROM p), qn AS (SELECT s AS x FROM q UNION SELECT t FROM q),
 ps AS (SELECT DISTINCT l_orderkey, l_linenumber % 3 AS b, l_suppkey AS a FROM lineitem WHERE l_returnflag <> 'N'), qs AS (SELECT DISTINCT l_orderkey, l_linenumber % 3 AS b, l_suppkey AS a FROM lineitem WHERE l_linestatus = 'O'),
 r AS (SELECT 2.0 * (SELECT count(*) FROM pn JOIN qn USING (x)) / ((SELECT count(*) FROM pn) + (SELECT count(*) FROM qn)) AS n, 2.0 * (SELECT count(*) FROM p JOIN q USING (s, t)) / ((SELECT count(*) FROM p) + (SELECT count(*) FROM q)) AS e, 1.0 * (SELECT count(*) FROM ps JOIN qs USING (l_orderkey, b, a)) / (SELECT count(*) FROM qs) AS o)"""


@query("agg25_relation_reasoning", "WITH " + _REL + " SELECT CAST(n AS DOUBLE) AS node_f1, CAST(e AS DOUBLE) AS edge_f1, CAST(o AS DOUBLE) AS order_score, CAST(0.3 * n + 0.4 * e + 0.3 * o AS DOUBLE) AS relation_score FROM r", rounded=("node_f1", "edge_f1", "order_score", "relation_score"))
def agg25(t):
    edge = lambda df: df.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"), F.lit("calls").alias("relation"))
    step = lambda df: df.select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber") % 3).alias("before"), F.col("l_suppkey").alias("after"))
    predicted, gold = t.lineitem.filter("l_returnflag <> 'N'"), t.lineitem.filter("l_linestatus = 'O'")
    return evaluation.relation_reasoning(edge(predicted), edge(gold), step(gold), step(predicted))


_EQS = """c AS (SELECT l_linestatus AS lane, count(*) FILTER (WHERE l_discount < 0.075) * 1.0 / count(*) AS cp, count(*) FILTER (WHERE l_tax < 0.045) * 1.0 / count(*) AS ce FROM lineitem GROUP BY 1),
 k AS (SELECT l_linestatus AS lane, count(*) FILTER (WHERE l_linenumber <= 3 AND l_returnflag <> 'R' AND l_discount < 0.075) * 1.0 / count(*) FILTER (WHERE l_linenumber <= 3 AND l_returnflag <> 'R') AS cc, count(*) FILTER (WHERE l_partkey % 9 = 0) * 1.0 / count(*) AS hr FROM lineitem GROUP BY 1)"""


def _quality(t):
    line = t.lineitem
    citations = line.select(F.col("l_linestatus").alias("lane"), (F.col("l_discount") < 0.075).alias("valid"), (F.col("l_tax") < 0.045).alias("entails"))
    claims = line.select(F.col("l_linestatus").alias("lane"), (F.col("l_linenumber") <= 3).alias("is_key"), (F.col("l_returnflag") != "R").alias("correct"), (F.col("l_discount") < 0.075).alias("has_valid_citation"), (F.col("l_partkey") % 9 == 0).alias("unsupported"))
    return evaluation.evidence_quality(citations, claims, "lane")


@query("agg26_evidence_quality", "WITH " + _EQS + " SELECT lane, CAST(cp AS DOUBLE) AS cp, CAST(ce AS DOUBLE) AS ce, CAST(cc AS DOUBLE) AS cc, CAST(hr AS DOUBLE) AS hallucination_rate, CAST(0.3 * cp + 0.4 * ce + 0.3 * cc AS DOUBLE) AS evidence_quality FROM c JOIN k USING (lane)", rounded=("cp", "ce", "cc", "hallucination_rate", "evidence_quality"))
def agg26(t):
    return _quality(t)


@query("agg27_grounded_score", """SELECT o_orderkey, CAST(round(greatest(0.0, least(100.0, 100 * (0.35 * (o_orderkey % 11 / 10.0) + 0.25 * (o_custkey % 5 / 4.0) + 0.20 * (o_custkey % 3 / 2.0) + 0.20 * (o_orderkey % 5) / 4) - least(20, 5 * (o_orderkey % 7)))), 6) AS DOUBLE) AS grounded_score FROM orders""")
def agg27(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    score = evaluation.grounded_score(key % 11 / 10.0, cust % 5 / 4.0, cust % 3 / 2.0, key % 5 + 1, key % 7)
    return t.orders.select("o_orderkey", F.round(score, 6).alias("grounded_score"))


_CONF = """f AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'P0' WHEN 'fr' THEN 'P1' WHEN 'de' THEN 'P2' ELSE 'P3' END AS pr, n_chars % 7 = 0 AS pl FROM documents WHERE n_chars % 3 = 0), g AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'P1' ELSE 'P2' END AS pr FROM labels WHERE toxic = 0),
 b AS (SELECT f.pr AS claimed, g.pr AS expected, coalesce(pl, false) AS pl FROM f FULL JOIN g USING (doc_id)),
 r AS (SELECT coalesce(CASE WHEN pl AND expected IS NOT NULL THEN expected END, claimed, expected) AS priority, claimed IS NOT NULL AND expected IS NOT NULL AND NOT pl AS tp, claimed IS NOT NULL AND expected IS NULL AND NOT pl AS fp, expected IS NOT NULL AND (claimed IS NULL OR pl) AS fn, pl FROM b),
 s AS (SELECT priority, count(*) FILTER (WHERE tp) AS tp, count(*) FILTER (WHERE fp) AS fp, count(*) FILTER (WHERE fn) AS fn, count(*) FILTER (WHERE pl) AS plausible FROM r GROUP BY priority)"""


@query("agg28_finding_confusion", "WITH " + _CONF + " SELECT *, CASE WHEN tp + fp > 0 THEN tp * 1.0::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp * 1.0::DOUBLE / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1, fp / 2.5::DOUBLE AS fp_per_kloc FROM s", rounded=("precision", "recall", "f1", "fp_per_kloc"))
def agg28(t):
    lang = F.col("lang")
    priority = F.when(lang == "en", "P0").when(lang == "fr", "P1").when(lang == "de", "P2").otherwise("P3")
    findings = t.documents.filter("n_chars % 3 = 0").select(F.col("doc_id").alias("root_cause"), priority.alias("priority"), F.when(F.col("n_chars") % 7 == 0, "plausible").otherwise("confirmed").alias("verdict"))
    standard = t.labels.filter("toxic = 0").select(F.col("doc_id").alias("root_cause"), F.when(F.col("quality") == 1, "P1").otherwise("P2").alias("priority"))
    return evaluation.finding_confusion(findings.unionByName(findings), standard, 2.5)


@query("agg29_severity_agreement", """WITH p AS (SELECT CAST(least(3, CAST(o_orderpriority[1] AS INT) - 1) AS INT) AS a, CAST(o_custkey % 4 AS INT) AS b FROM orders), n AS (SELECT count(*) AS n FROM p), ma AS (SELECT a, count(*) AS na FROM p GROUP BY a), mb AS (SELECT b, count(*) AS nb FROM p GROUP BY b), e AS (SELECT sum(abs(a - b) * na * nb) AS e FROM ma, mb)
 SELECT n AS pairs, (SELECT count(*) FROM p WHERE a = b) * 1.0::DOUBLE / n AS exact_rate, (SELECT count(*) FROM p WHERE abs(a - b) <= 1) * 1.0::DOUBLE / n AS within_one_rate, (SELECT sum(abs(a - b)) FROM p) * 1.0::DOUBLE / n AS mean_absolute_error, 1 - ((SELECT sum(abs(a - b)) FROM p) * 1.0::DOUBLE / n) / (e * 1.0::DOUBLE / (n * n)) AS weighted_kappa FROM n, e""", rounded=("exact_rate", "within_one_rate", "mean_absolute_error", "weighted_kappa"))
def agg29(t):
    level = F.least(F.lit(3), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return evaluation.severity_agreement(t.orders.select(level.alias("a"), (F.col("o_custkey") % 4).cast("int").alias("b")))


_DISC = """x AS (SELECT CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey % 4 AS INT) END AS c, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 7 % 4 AS INT) END AS e, o_orderkey % 5 <> 0 AS loc, o_orderkey % 5003 = 0 AS fab FROM orders),
 w AS (SELECT *, CASE c WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 1 END AS wc, CASE e WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 1 END AS we, c IS NOT NULL AND e IS NOT NULL AS hit FROM x),
 m AS (SELECT sum(we) FILTER (WHERE hit) * 1.0::DOUBLE / sum(we) AS swr, sum(wc) FILTER (WHERE e IS NULL) * 1.0::DOUBLE / sum(wc) AS swf, count(*) FILTER (WHERE hit) * 1.0::DOUBLE / count(c) AS sp, count(*) FILTER (WHERE hit) * 1.0::DOUBLE / count(e) AS sr, count(*) FILTER (WHERE hit AND loc) * 1.0::DOUBLE / count(*) FILTER (WHERE hit) AS location,
  count(*) FILTER (WHERE hit AND abs(c - e) <= 1) * 1.0::DOUBLE / count(*) FILTER (WHERE hit) AS paa, 10 * count(*) FILTER (WHERE fab AND c <= 1) + 3 * count(*) FILTER (WHERE fab AND c > 1) AS penalty FROM w)"""


@query("agg30_discovery_score", "WITH " + _DISC + " SELECT *, greatest(0.0, 100 * (0.30::DOUBLE * swr + 0.25::DOUBLE * sp + 0.15::DOUBLE * sr + 0.15::DOUBLE * location + 0.15::DOUBLE * paa) - penalty) AS discovery_score FROM m", rounded=("swr", "swf", "sp", "sr", "location", "paa", "discovery_score"))
def agg30(t):
    key = F.col("o_orderkey")
    rows = t.orders.select(F.when(key % 3 != 0, (F.col("o_custkey") % 4).cast("int")).alias("claimed"), F.when(key % 4 != 0, (key % 7 % 4).cast("int")).alias("expected"), (key % 5 != 0).alias("located"), (key % 5003 == 0).alias("fabricated"))
    return evaluation.discovery_score(rows)


@query("agg31_net_win_rate", "SELECT user_id % 5 AS stratum, count(*) FILTER (WHERE o = 1) AS wins, count(*) FILTER (WHERE o = 0) AS ties, count(*) FILTER (WHERE o = -1) AS losses, (count(*) FILTER (WHERE o = 1) + 0.5::DOUBLE * count(*) FILTER (WHERE o = 0)) / count(*) AS net_win_rate FROM (SELECT user_id, sign(count(*) FILTER (WHERE event_type = 'click') - count(*) FILTER (WHERE event_type = 'view')) AS o FROM events GROUP BY user_id) x GROUP BY 1", rounded=("net_win_rate",))
def agg31(t):
    per = t.events.groupBy("user_id").agg((F.count_if(F.col("event_type") == "click") - F.count_if(F.col("event_type") == "view")).alias("d"))
    outcome = F.when(F.col("d") > 0, "win").when(F.col("d") == 0, "tie").otherwise("loss")
    return evaluation.net_win_rate(per.select((F.col("user_id") % 5).alias("stratum"), outcome.alias("outcome")), "stratum")


_PAIRS = """pr AS (SELECT user_id // 2 AS pair_id, user_id // 2 % 4 AS project, CAST(round(sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END)) AS BIGINT) AS a, CAST(round(sum(CASE WHEN user_id % 2 = 1 THEN value ELSE 0 END)) AS BIGINT) AS b FROM events GROUP BY 1, 2)"""


def _pairs(t):
    lane = lambda n: F.round(F.sum(F.when(F.col("user_id") % 2 == n, F.col("value")).otherwise(0))).cast("long")
    pair = F.floor(F.col("user_id") / 2)
    return t.events.groupBy(pair.alias("pair_id"), (pair % 4).alias("project")).agg(lane(0).alias("a"), lane(1).alias("b"))


@query("agg32_paired_summary", "WITH " + _PAIRS + ", l AS (SELECT project, unnest(['a', 'b', 'difference']) AS lane, unnest([a, b, a - b]) AS v FROM pr) SELECT project, lane, count(*) AS pairs, avg(v) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95 FROM l GROUP BY project, lane", rounded=("mean", "median", "p90", "p95"))
def agg32(t):
    return evaluation.paired_summary(_pairs(t), "project")


@query("agg32_macro_average", "WITH " + _PAIRS + ", d AS (SELECT project, avg(a - b) AS d, count(*) AS n FROM pr GROUP BY project) SELECT count(*) AS projects, avg(d) AS macro_difference, sum(d * n) / sum(n) AS micro_difference FROM d", rounded=("macro_difference", "micro_difference"))
def agg32_macro(t):
    return evaluation.macro_average(_pairs(t), "project")


@query("agg32_wilcoxon", "WITH " + _PAIRS + """, s AS (SELECT a - b AS d FROM pr WHERE a <> b), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS rk FROM s), ties AS (SELECT sum(n * n * n - n) AS t FROM (SELECT count(*) AS n FROM s GROUP BY abs(d)) x),
 w AS (SELECT count(*) AS n, sum(rk) FILTER (WHERE d > 0) AS w_plus, sum(rk) FILTER (WHERE d < 0) AS w_minus FROM r) SELECT n, w_plus, w_minus, (w_plus - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - t / 48.0::DOUBLE) AS z FROM w, ties""", rounded=("w_plus", "w_minus", "z"))
def agg32_wilcoxon(t):
    return evaluation.wilcoxon_signed_rank(_pairs(t))


@query("agg32_mcnemar", "WITH " + _PAIRS + ", m AS (SELECT count(*) FILTER (WHERE a > 3300 AND b <= 3300) AS only_a, count(*) FILTER (WHERE a <= 3300 AND b > 3300) AS only_b FROM pr) SELECT only_a, only_b, pow(abs(only_a - only_b) - 1, 2) / (only_a + only_b) AS statistic FROM m", rounded=("statistic",))
def agg32_mcnemar(t):
    return evaluation.mcnemar(_pairs(t).select((F.col("a") > 3300).alias("a"), (F.col("b") > 3300).alias("b")))


@query("agg32_cluster_bootstrap", "WITH " + _PAIRS + """, r AS (SELECT rep, ('0x' || substr(sha256(concat('s:', pair_id, ':', rep)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, a - b AS d FROM pr, (SELECT unnest(range(1, 201)) AS rep) q),
 m AS (SELECT rep, sum(w * d) * 1.0::DOUBLE / sum(w) AS mean FROM (SELECT rep, d, (u >= 0.36787944117::DOUBLE)::INT + (u >= 0.73575888234::DOUBLE)::INT + (u >= 0.91969860293::DOUBLE)::INT + (u >= 0.98101184312::DOUBLE)::INT + (u >= 0.99634015317::DOUBLE)::INT + (u >= 0.99940581518::DOUBLE)::INT AS w FROM r) x GROUP BY rep)
 SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM m""", rounded=("low", "high"))
def agg32_bootstrap(t):
    return evaluation.cluster_bootstrap(_pairs(t), "pair_id")


@query("agg33_decision_rule", "WITH " + _PAIRS + """, mt AS (SELECT project AS stratum, 'gas_difference' AS metric, avg(a - b) AS value FROM pr GROUP BY project UNION ALL SELECT project, 'net_win_rate', (count(*) FILTER (WHERE a > b) + 0.5::DOUBLE * count(*) FILTER (WHERE a = b)) / count(*) FROM pr GROUP BY project),
 rl AS (SELECT * FROM (VALUES ('graph_sensitive_gain', 'gas_difference', '>=', 5.0), ('graph_sensitive_interval', 'gas_difference_low', '>', 0.0), ('relation_gain', 'rrs_difference', '>=', 0.08), ('net_wins', 'net_win_rate', '>', 0.55), ('no_loss_elsewhere', 'other_gas_difference_low', '>=', -3.0), ('hallucination_guard', 'severe_rate_difference', '<=', 0.02),
 ('completion_guard', 'completion_difference', '>=', -0.02), ('security_interval', 'sds_difference_low', '>', 0.0), ('security_recall_interval', 'swr_difference_low', '>', 0.0), ('precision_guard', 'sp_difference', '>=', -0.03), ('fabrication_guard', 'fabricated_difference', '<=', 0.0)) v(rule, metric, cmp, bound))
 SELECT s.stratum, rule, rl.metric, value, CAST(bound AS DOUBLE) AS bound, coalesce(CASE cmp WHEN '>=' THEN value >= bound WHEN '>' THEN value > bound ELSE value <= bound END, false) AS passed FROM (SELECT DISTINCT stratum FROM mt) s CROSS JOIN rl LEFT JOIN mt ON mt.stratum = s.stratum AND mt.metric = rl.metric""", rounded=("value", "bound"))
def agg33(t):
    pairs = _pairs(t)
    gain = pairs.groupBy(F.col("project").alias("stratum")).agg(F.avg(F.col("a") - F.col("b")).alias("value")).select("stratum", F.lit("gas_difference").alias("metric"), "value")
    outcome = F.when(F.col("a") > F.col("b"), "win").when(F.col("a") == F.col("b"), "tie").otherwise("loss")
    wins = evaluation.net_win_rate(pairs.select(F.col("project").alias("stratum"), outcome.alias("outcome")), "stratum")
    return evaluation.decision_rule(gain.unionByName(wins.select("stratum", F.lit("net_win_rate").alias("metric"), F.col("net_win_rate").alias("value"))))


_LEDGER = """c AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'source_supported_risk' WHEN 'P' THEN 'excluded' ELSE 'unclosed_candidate' END AS st, CASE o_orderkey % 3 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' ELSE 'not_applicable' END AS ch, CASE o_orderkey % 4 WHEN 0 THEN 'external_to_sink' WHEN 1 THEN 'local_segment' ELSE 'not_applicable' END AS sc,
 CASE WHEN o_custkey % 2 = 0 THEN 'external_input' WHEN o_custkey % 3 = 0 THEN 'unknown' END AS sk, CASE WHEN o_custkey % 5 <> 0 THEN 'sensitive_operation' ELSE 'other' END AS ek, CASE o_custkey % 3 WHEN 0 THEN 'established' WHEN 1 THEN 'conditional' ELSE 'not_established' END AS im, CASE o_custkey % 4 WHEN 0 THEN 'external' WHEN 1 THEN 'unknown' ELSE 'local' END AS isc,
 CASE o_orderkey % 5 WHEN 0 THEN 'chain_gap' WHEN 1 THEN 'deployment' WHEN 2 THEN 'other' END AS cond, CASE WHEN o_custkey % 6 = 0 THEN 'not needed' ELSE '' END AS ex, o_orderkey % 101 = 0 AS broken, o_orderkey % 7 <> 0 AS observed FROM orders)"""


@query("fn27_validate_ledger", "WITH " + _LEDGER + """ SELECT id, 'syntax' AS category, 'not_valid_json' AS rule FROM c WHERE broken UNION ALL SELECT id, 'state', rule FROM (SELECT id, unnest(list_filter([CASE WHEN cond = 'chain_gap' AND ch <> 'open' THEN 'chain_gap_must_stay_open' END, CASE WHEN isc = 'external' AND im <> 'not_established' AND NOT (ch = 'closed' AND sc = 'external_to_sink') THEN 'external_impact_needs_closed_chain' END,
 CASE WHEN st = 'source_supported_risk' AND cond IS NOT NULL AND cond <> 'deployment' THEN 'risk_with_open_conditions' END, CASE WHEN st = 'source_supported_risk' AND (NOT observed OR ch = 'open' OR im = 'not_established' OR isc = 'unknown') THEN 'risk_without_support' END, CASE WHEN st = 'excluded' AND ex = '' THEN 'exclusion_without_reason' END,
 CASE WHEN im = 'conditional' AND cond IS NULL THEN 'conditional_without_conditions' END, CASE WHEN ch = 'not_applicable' AND (sc <> 'not_applicable' OR sk IS NOT NULL OR ek IS NOT NULL) THEN 'not_applicable_with_endpoints' END, CASE WHEN ch <> 'not_applicable' AND sc = 'not_applicable' THEN 'chain_without_scope' END,
 CASE WHEN ch = 'closed' AND sc <> 'not_applicable' AND (sk IS NULL OR sk = 'unknown') THEN 'closed_without_endpoints' END, CASE WHEN ch = 'closed' AND sc = 'external_to_sink' AND sk IS NOT NULL AND sk <> 'unknown' AND (sk <> 'external_input' OR ek <> 'sensitive_operation') THEN 'closed_with_wrong_endpoints' END], lambda x: x IS NOT NULL)) AS rule FROM c WHERE NOT broken) v""")
def fn27(t):
    key, cust, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    start = F.when(cust % 2 == 0, F.struct(F.lit("external_input").alias("kind"))).when(cust % 3 == 0, F.struct(F.lit("unknown").alias("kind")))
    end = F.struct(F.when(cust % 5 != 0, "sensitive_operation").otherwise("other").alias("kind"))
    chain = F.struct(F.when(key % 3 == 0, "closed").when(key % 3 == 1, "open").otherwise("not_applicable").alias("status"), F.when(key % 4 == 0, "external_to_sink").when(key % 4 == 1, "local_segment").otherwise("not_applicable").alias("scope"), start.alias("start"), end.alias("end"))
    impact = F.struct(F.when(cust % 3 == 0, "established").when(cust % 3 == 1, "conditional").otherwise("not_established").alias("status"), F.when(cust % 4 == 0, "external").when(cust % 4 == 1, "unknown").otherwise("local").alias("scope"))
    kind = F.when(key % 5 == 0, "chain_gap").when(key % 5 == 1, "deployment").when(key % 5 == 2, "other")
    conditions = F.transform(F.array_compact(F.array(kind)), lambda x: F.struct(x.alias("kind")))
    body = F.to_json(F.struct(F.lit("cause").alias("root_cause"), F.when(key % 7 != 0, "observed").otherwise("inferred").alias("behavior_status"), chain.alias("chain"), impact.alias("impact"), conditions.alias("unresolved_conditions"),
                              F.when(status == "F", "source_supported_risk").when(status == "P", "excluded").otherwise("unclosed_candidate").alias("status"), F.when(cust % 6 == 0, "not needed").otherwise("").alias("exclusion_reason")))
    broken = F.when(key % 101 == 0, F.concat(F.lit("{{"), body)).otherwise(body)
    return evaluation.validate_ledger(t.orders.select(key.alias("id"), broken.alias("body")), "id", "body")
