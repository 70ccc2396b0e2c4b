"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import BLANK_CHARS, let, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# frequent function words of the languages that the corpus is meant to hold
STOP_WORDS = tuple(
    dict.fromkeys(
        (
            "the of and to in is a that it for on was with as be by this are from or an at not he which have had "
            "der die das und zu den nicht von sie ist des sich mit dem dass er es ein ich auf so eine auch als nach wie im für "
            "de la le et les un du une que est pour qui dans par plus pas au sur ne se "
            "el en y los del las por con no su al lo como"
        ).split()
    )
)


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= metric <= high``; a missing bound is open."""

    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("n_words", low=MIN_WORDS),
    Rule("mean_word_chars", low=2.5, high=12.0),
    Rule("symbols_per_word", high=0.1),
    Rule("stop_word_ratio", low=0.05),
    Rule("dup_line_ratio", high=0.3),
)


def _repeat_words(w: Column) -> Column:
    """Words in three-word windows found twice or more, the first find included."""

    def counted(windows: Column) -> Column:
        numbered = F.zip_with(windows, F.sequence(F.lit(0), F.size(windows) - 1), lambda k, i: F.struct(k.alias("k"), i.alias("i")))

        def repeats(s: Column) -> Column:
            same = F.zip_with(F.slice(s, 2, F.size(s) - 1), F.slice(s, 1, F.size(s) - 1), lambda a, b: F.when(a.k == b.k, F.array(a.i, b.i)))
            hits = F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))
            return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(i, i + 1, i + 2)))))

        # most texts repeat no window, which a hash set shows without a sort
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(F.array_sort(numbered), repeats))

    shingles = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(w) >= 4, let(shingles, counted)).otherwise(F.lit(0))


def _of_text(text: Column, stop_words: Sequence[str]) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANK_CHARS, "") != "")
    is_stop = lambda x: F.lower(x).isin(*stop_words)

    def counts(w: Column) -> Column:
        return let(
            lines,
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(text, BLANK_CHARS, "")).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).cast("long").alias("n_repeat_words"),
                F.size(x).cast("long").alias("n_lines"),
                F.size(F.filter(w, is_stop)).cast("long").alias("n_stop_words"),
            ),
        )

    return let(words(text), counts)


def _passes(rules: Sequence[Rule]) -> Column:
    passed = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            passed = passed & (F.col(rule.metric) >= rule.low)
        if rule.high is not None:
            passed = passed & (F.col(rule.metric) <= rule.high)
    return F.coalesce(passed, F.lit(False))


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """Counts, ratios and verdict per row of ``docs``: no shuffle and no user function.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_stop_words, the ratios named by the rules, base_failed and kept. ``base_failed`` holds for
    fewer than 50 words or more than half of the words in repeated three-word windows; ``kept`` is
    false then, otherwise the verdict of the rule table. A null or blank text has no words, fails and
    has null ratios. Rows are judged alone: repeated rows and a null doc_id come back as they are.
    Other columns are not read, whatever their names.
    """
    return _judged(docs, text, rules, stop_words, F.col(doc_id).alias("doc_id"))


def passing(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    return _judged(docs, text, rules, stop_words, F.struct("*").alias("row")).filter("kept").select("row.*")


def _judged(docs: DataFrame, text: str, rules: Sequence[Rule], stop_words: Sequence[str], key: Column) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(key, let(body, lambda t: _of_text(t, stop_words)).alias("m"))
    plain = found.select(found.columns[0], "m.*")
    ratios = {
        "mean_word_chars": F.try_divide(F.col("word_chars").cast("double"), F.col("n_words").cast("double")),
        "symbols_per_word": F.try_divide(F.col("n_symbols").cast("double"), F.col("n_words").cast("double")),
        "stop_word_ratio": F.try_divide(F.col("n_stop_words").cast("double"), F.col("n_words").cast("double")),
        "dup_line_ratio": F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_lines").cast("double")),
    }
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = plain.withColumns(ratios).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & _passes(rules))


def oracle(stop_words: Sequence[str] = STOP_WORDS, rules: Sequence[Rule] = RULES, docs: str = "documents") -> str:
    """The same rows in SQL."""
    listed = ", ".join(f"'{w}'" for w in stop_words)
    tests = [f"{r.metric} {op} {bound}" for r in rules for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH rows AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {docs}
), split AS (
  SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM rows
), windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3) q
), repeated AS (
  SELECT rid, i FROM windows SEMI JOIN (SELECT rid, k FROM windows GROUP BY rid, k HAVING count(*) > 1) d USING (rid, k)
), covered AS (
  SELECT rid, count(DISTINCT i + o.d) AS n FROM repeated, (VALUES (0), (1), (2)) o(d) GROUP BY rid
), counts AS (
  SELECT rid, doc_id, len(w)::BIGINT AS n_words, length(translate(text, {blank}, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({listed})))::BIGINT AS n_stop_words
  FROM split LEFT JOIN covered c USING (rid)
), ratios AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words,
    word_chars::DOUBLE / nullif(n_words, 0) AS mean_word_chars, n_symbols::DOUBLE / nullif(n_words, 0) AS symbols_per_word,
    n_stop_words::DOUBLE / nullif(n_words, 0) AS stop_word_ratio, n_dup_lines::DOUBLE / nullif(n_lines, 0) AS dup_line_ratio,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts
)
SELECT *, NOT base_failed AND coalesce({' AND '.join(tests)}, false) AS kept FROM ratios"""
