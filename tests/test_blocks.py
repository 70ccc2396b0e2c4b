"""Order-dependent operators against sequential models, with one key that holds most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import corpus, evaluation, evidence, runs
from tracewell.operators.skew import prefix_sums, top_n, with_neighbour


@pytest.fixture(scope="module")
def hot():
    rng = random.Random(5)
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.randrange(1, 30)) for i in range(3000)]


@pytest.fixture(scope="module")
def table(spark, hot):
    return spark.createDataFrame(hot, "k string, i long, v long").repartition(7)


def test_running_sums(hot, table):
    blocks = [F.floor(F.col("i") / 500), F.floor(F.col("i") / 50)]
    got = {r.i: r.s for r in prefix_sums(table, ["k"], blocks, ["i"], {"s": F.col("v")}).collect()}
    sums, want = {}, {}
    for k, i, v in hot:
        want[i] = sums[k] = sums.get(k, 0) + v
    assert got == want
    whole = {r.i: r.s for r in prefix_sums(table, [], blocks, ["i"], {"s": F.lit(1)}).collect()}
    assert whole == {i: i + 1 for _, i, _ in hot}


@pytest.mark.parametrize("back", [False, True])
def test_neighbours(hot, table, back):
    got = {r.i: (r.n.i if r.n else None) for r in with_neighbour(table, ["k"], F.floor(F.col("i") / 64), ["i"], ["v"], prefix="n", back=back).collect()}
    want, last = {}, {}
    for k, i, _ in (hot if back else reversed(hot)):
        want[i] = last.get(k)
        last[k] = i
    assert got == want


@pytest.mark.parametrize("n", [3, 1500])
def test_first_rows_per_key(hot, table, n):
    got = {(r.k, r.i, r.rn) for r in top_n(table, ["k"], [F.desc("v"), "i"], n).collect()}
    want = set()
    for key in {k for k, _, _ in hot}:
        rows = sorted((-v, i) for k, i, v in hot if k == key)[:n]
        want |= {(key, i, pos) for pos, (_, i) in enumerate(rows, 1)}
    assert got == want


def test_packing_stops_at_the_first_row_that_cannot_fit(spark):
    rng = random.Random(2)
    rows = [(g, i, "x" * rng.randrange(1, 60), "s" * rng.randrange(1, 20)) for g in range(30) for i in range(12)]
    df = spark.createDataFrame(rows, "g int, i int, f string, s string")
    got = {}
    for r in evidence.pack_by_bytes(df, ["g"], ["i"], F.col("f"), F.col("s"), 120, 8).collect():
        got.setdefault(r.g, []).append((r.position, r.body, r.compacted))
        assert r.used_bytes <= 120
    for g in range(30):
        used, want = 0, []
        for pos, (_, _, f, s) in enumerate([r for r in rows if r[0] == g][:8], 1):
            body = f if used + len(f) + 1 <= 120 else s
            if used + len(body) + 1 > 120:
                break
            used += len(body) + 1
            want.append((pos, body, body is not f))
        assert sorted(got[g]) == want


def test_newest_rounds_first(spark):
    rng = random.Random(8)
    rows = [(g, i, full, rng.randrange(1, full + 1)) for g in range(25) for i in range(40) for full in [rng.randrange(5, 90)]]
    df = spark.createDataFrame(rows, "g int, i long, full_size long, floor_size long")
    got = {(r.g, r.i): (r.size, r.compacted) for r in runs.latest_first_window(df, "g", "i", 300, block_width=4).collect()}
    want = {}
    for g in range(25):
        room = 300
        for _, i, full, floor in sorted((r for r in rows if r[0] == g), reverse=True):
            if full <= room:
                want[(g, i)], room = (full, False), room - full
            elif floor <= room:
                want[(g, i)], room = (room, True), 0
    assert got == want


def test_cooldown(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.8 else "cold", i, rng.randrange(20_000)) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, o long, t long")
    got = {(r.k, r.o) for r in runs.cooldown_accept(df, "k", "o", F.col("t"), 37, 500).collect()}
    want, last = set(), {}
    for t, o, k in sorted((t, o, k) for k, o, t in rows):
        if k not in last or t - last[k] >= 37:
            last[k] = t
            want.add((k, o))
    assert got == want


def test_line_allowance(spark):
    rng = random.Random(7)
    reads = [(run, seq, f"p{rng.randrange(3)}", rng.randrange(40)) for run in range(6) for seq in range(200)]
    size = lambda path, line: len(path) + line
    df = spark.createDataFrame([(a, b, c, d, size(c, d)) for a, b, c, d in reads], "run int, seq long, path string, line int, bytes long")
    got = {(r.run, r.seq) for r in runs.unique_line_allowance(df, "run", "seq", F.floor(F.col("seq") / 16), 700).collect()}
    want = set()
    for run in range(6):
        seen, used = set(), 0
        for _, seq, path, line in (r for r in reads if r[0] == run):
            charge = 0 if (path, line) in seen else size(path, line)
            if used + charge > 700:
                break
            used += charge
            seen.add((path, line))
            want.add((run, seq))
    assert got == want


def test_quantiles(spark, hot, table):
    got = {r.k: (r.a, r.b) for r in evaluation.exact_quantiles(table, ["k"], "v", {"a": 0.5, "b": 0.93}).collect()}
    for key in got:
        values = [v for k, _, v in hot if k == key]
        assert np.allclose(got[key], [np.quantile(values, 0.5), np.quantile(values, 0.93)])


def test_snippets_grow_down_then_up(spark):
    rng = random.Random(3)
    lines = {(f"f{p}", n): "w" * rng.randrange(0, 30) for p in range(3) for n in range(1, 31)}
    hits = [(f"f{p}", n, min(30, n + rng.randrange(0, 25))) for p in range(3) for n in range(1, 31, 4)]
    table = spark.createDataFrame([(p, n, t) for (p, n), t in lines.items()], "path string, line int, text string")
    asked = spark.createDataFrame(hits, "path string, line int, end_line int")
    got = {(r.path, r.line): r for r in corpus.snippets_around(table, asked, context=5, max_chars=60).collect()}
    for path, line, end in hits:
        shown = lambda n: f"{n}: {lines[(path, n)]}"
        low, high = max(1, line - 5), min(30, end + 5)
        body = [shown(n) for n in range(low, high + 1)]
        cut = len("\n".join(body)) > 60
        start, stop = low, high
        if cut:
            start = stop = line
            body = [shown(line)]
            while stop < high and len("\n".join([*body, shown(stop + 1)])) <= 60:
                stop += 1
                body.append(shown(stop))
            while start > low and len("\n".join([shown(start - 1), *body])) <= 60:
                start -= 1
                body.insert(0, shown(start))
        r = got[(path, line)]
        assert (r.truncated, r.start_line, r.stop_line, r.text) == (cut, start, stop, "\n".join(body))
        assert (r.requested_start_line, r.requested_end_line) == ((low, high) if cut else (None, None))


def test_network_accounting(spark):
    attempts = spark.createDataFrame([(1, 429, "HTTPError", 7000.0, 30125.0), (1, None, None, None, None), (2, 429, "HTTPError", None, 5.0)], "run_id int, status_code int, error_type string, elapsed_ms double, wait_ms double")
    durations = spark.createDataFrame([(1, 60000.0), (2, 60000.0)], "run_id int, duration_ms double")
    got = {r.run_id: (r.zero_token_attempts, r.excluded_request_ms, r.excluded_wait_ms, r.adjusted_duration_ms) for r in runs.network_accounting(attempts, durations).collect()}
    assert got == {1: (1, 7000.0, 30125.0, 22875.0), 2: (1, 0.0, 5.0, None)}


def test_pages_join_up_to_the_whole(spark, hot, table):
    order, identity, cursor, seen = ["v", "i"], evidence.page_identity("s", []), "", []
    while True:
        page = evidence.cursor_page(table, order, identity, cursor, 700).collect()
        if not page:
            break
        seen += [(r.v, r.i) for r in page]
        cursor = evidence.encode_cursor(identity, [page[-1][c] for c in order])
    assert seen == sorted((v, i) for _, i, v in hot)
    with pytest.raises(ValueError):
        evidence.cursor_page(table, order, "other", cursor, 5)


def test_running_sums_over_a_range_sort(spark):
    from tracewell.operators.skew import ranked, running_sums

    rng = random.Random(8)
    rows = [("hot" if i % 3 else f"k{i % 5}", rng.randrange(50), i, rng.randrange(-5, 9)) for i in range(2000)] + [(None, 1, 5000, 3)]
    df = spark.createDataFrame(rows, "k string, o int, id int, v int").repartition(7)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    total, per, want = 0, {}, {}
    for number, (k, _, i, v) in enumerate(order):
        total, per[k] = total + v, per.get(k, 0) + v
        want[i] = (total, per[k], sum(1 for x in order[: number + 1] if x[0] == k))
    every = {r.id: r.s for r in running_sums(df, [], ["k", "o", "id"], {"s": F.col("v")}).collect()}
    keyed = {r.id: r.s for r in running_sums(df.filter("k is not null"), ["k"], ["o", "id"], {"s": F.col("v")}).collect()}
    numbers = {r.id: r.rn for r in ranked(df.filter("k is not null"), ["k"], ["o", "id"]).collect()}
    assert every == {i: w[0] for i, w in want.items()}
    assert keyed == {i: w[1] for i, w in want.items() if i != 5000} and numbers == {i: w[2] for i, w in want.items() if i != 5000}
    assert running_sums(df.limit(0), ["k"], ["o"], {"s": F.col("v")}).collect() == []


def test_window_with_thousands_of_skips(spark):
    """Rounds alternate between one that is kept and one that only just no longer fits."""
    rows, room = [], 6000
    for i in range(3000):
        rows.append(("long", 10_000 - 2 * i, 1, 1))
        rows.append(("long", 9_999 - 2 * i, room + 50, room))
        room -= 1
    rows += [("short", i, 5, 2) for i in range(10)] + [("none", 1, 90_000, 90_000)]
    want, state = {}, {}
    for k, o, full, floor in sorted(rows, key=lambda r: (r[0], -r[1])):
        left = state.get(k, 6000)
        if floor <= left:
            want[k, o] = (min(full, left), full > left)
            state[k] = left - full if full <= left else -1
    df = spark.createDataFrame(rows, "g string, i int, full_size long, floor_size long").repartition(5)
    got = {(r.g, r.i): (r.size, r.compacted) for r in runs.latest_first_window(df, "g", "i", 6000).collect()}
    assert got == want and sum(1 for k in want if k[0] == "long") == 3000
