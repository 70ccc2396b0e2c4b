"""Quality rules against plain Python and SQL."""

import re
from collections import Counter

import duckdb

from tracewell.llm import quality_rules as Q


def brute(doc_id, text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + d for i in range(len(w) - 2) for d in range(3) if seen[tuple(w[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(text.count(c) for c in Q.SYMBOLS)
    stops = sum(x.lower() in Q.STOP_WORDS for x in w)
    dup = len(lines) - len(set(lines))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    kept = not failed and 2.5 <= sum(map(len, w)) / len(w) <= 12 and symbols / len(w) <= 0.1 and stops / len(w) >= 0.05 and dup / len(lines) <= 0.3
    return (doc_id, len(w), sum(map(len, w)), symbols, dup, len(covered), failed, kept)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def got(frame):
    return sorted((tuple(r) for r in Q.quality_rules(frame).select(*COLUMNS).collect()), key=repr)


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    result = got(docs)
    assert result == sorted((brute(*r) for r in rows), key=repr)
    assert 0 < sum(r[-1] for r in result) < len(rows)


def test_odd_rows(spark):
    line = "the cat of the house and a dog is in it"
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a b c"), (5, "a b c a b c"), (6, "x x x x"), (None, "a\nb"), (7, "\n".join([line] * 9)),
            (8, " ".join(f"w{i}" for i in range(60))), (9, " ".join(f"the w{i}" for i in range(40))), (9, " ".join(f"the w{i}" for i in range(40))),
            (10, "é ü x   ß 😀 # | <>" * 20), (11, " ".join(f"w{i % 5000} the" for i in range(20_000))), (12, "the a\n\nthe a\n \nb"), (13, "A  b\rA\x0bb")]
    frame = spark.createDataFrame([(*r, 5, "clash") for r in rows], "doc_id long, text string, n_words int, m string")
    assert got(frame) == sorted((brute(*r) for r in rows), key=repr)
    assert Q.quality_rules(frame).filter("doc_id = 2").select("stop_word_ratio").first()[0] is None


def test_empty(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_sql(spark, folder):
    frame = Q.quality_rules(spark.read.parquet(f"{folder}/documents.parquet"))
    sql = Q.oracle(docs=f"read_parquet('{folder}/documents.parquet')")
    cursor = duckdb.connect().execute(sql)
    names = [c[0] for c in cursor.description]
    assert names == frame.columns
    assert sorted(map(tuple, cursor.fetchall())) == sorted(map(tuple, frame.collect()))


def test_no_user_function_and_no_shuffle(spark, folder):
    frame = Q.quality_rules(spark.read.parquet(f"{folder}/documents.parquet"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
