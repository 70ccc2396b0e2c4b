"""The pipeline, stage by stage, against the operators' brute-force versions."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm import test_mixing, test_packing, test_quality_rules, test_simhash
from tracewell.llm import weak_quality
from tracewell.llm.common import word_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Rows after each stage, the input first."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in C.STAGES:
        out.append(C.staged(stage(spark, out[-1], folder)))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "quality_rules", "simhash_dedup", "mixing", "packing"]
    for frame in stages[:-1]:
        assert tuple(frame.columns) == C.COLUMNS


def test_classifier_takes_its_own_verdicts(spark, stages):
    kept = {r.doc_id for r in weak_quality.quality(stages[0]).filter("kept").collect()}
    assert {r.doc_id for r in stages[1].collect()} == kept and len(kept) < stages[0].count()
    assert stages[1].exceptAll(stages[0]).isEmpty()


def test_rules(stages):
    want = {r.doc_id for r in stages[1].collect() if test_quality_rules.brute(r.doc_id, r.text)[-1]}
    assert {r.doc_id for r in stages[2].collect()} == want


def test_one_of_each_group(stages):
    want = {r[0] for r in test_simhash.brute([(r.doc_id, r.text) for r in stages[2].collect()]) if r[3]}
    got = [r.doc_id for r in stages[3].collect()]
    assert sorted(got) == sorted(want) and stages[3].exceptAll(stages[2]).isEmpty()


def test_mix(stages):
    sizes = stages[3].select("doc_id", "source", word_count(F.col("text")).alias("size")).collect()
    copies = Counter(r.doc_id for r in stages[4].collect())
    want = test_mixing.levels({s: sum(r.size for r in sizes if r.source == s) for s in {r.source for r in sizes}})
    taken = defaultdict(int)
    for r in sizes:
        assert copies[r.doc_id] <= 2
        taken[r.source] += copies[r.doc_id] * r.size
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(r.size for r in sizes if r.source == s) / 2 + 1e-6
    assert stages[4].distinct().exceptAll(stages[3]).isEmpty()


def test_packs_all_that_the_mix_took(stages):
    rows = [(r.doc_id, r.text) for r in stages[4].collect()]
    used, least = test_packing.check(rows, [tuple(r) for r in stages[5].select(*test_packing.COLUMNS).collect()])
    assert used <= 1.02 * least + 1


def test_run_gives_the_same_pieces(spark, folder, stages):
    key = lambda df: Counter(tuple(r) for r in df.select("doc_id", "piece", "ids_crc32", "sequence_id", "offset").collect())
    a, b = key(C.run(spark, folder)), key(stages[5])
    assert Counter({k[:3]: n for k, n in a.items()}) == Counter({k[:3]: n for k, n in b.items()})
    assert len({k[3] for k in a}) == len({k[3] for k in b})


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_odd_rows(spark, folder, name, stage):
    text = " ".join(f"the word{i} of" for i in range(60))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, text, None, None, 1), (3, text, "en", "a", 1), (3, text, "en", "a", 1), (4, text + " x", None, "b", None), (5, "the " + "word of a " * 30_000, "en", "b", 2)]
    frame = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], SCHEMA + ", _row string, score double")
    out = stage(spark, frame, folder)
    out.collect()
    if name != "packing":
        assert tuple(out.columns) == C.COLUMNS
    counts = Counter(r.doc_id for r in out.collect())
    if name == "quality_rules":
        assert counts == {None: 1, 3: 2, 4: 1}
    if name == "simhash_dedup":
        assert counts == {1: 1, 3: 1, 5: 1}
    if name == "packing":
        assert {1, 2, 3, 4, 5, None} == set(counts)
    assert stage(spark, frame.limit(0), folder).count() == 0


def test_near_copies_keep_what_is_no_copy(spark, folder):
    """Rows without an id, and different texts under one id, stay unless they are copies."""
    text = lambda k: " ".join(f"w{k}x{i} and" for i in range(60))
    rows = [(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(5)), (5, text(5)), (None, text(3)), (None, text(6)), (None, text(6))]
    frame = spark.createDataFrame([(i, x, "en", "a", len(x)) for i, x in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in C.drop_near_copies(spark, frame, folder).collect()), key=repr)
    assert got == sorted([(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (5, text(5)), (None, text(6))], key=repr)
