"""Periodic runs of words: multi-scale minimizers seed the extension, lag scans cover short periods."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import let, words
from tracewell.llm.sharding import CRC_TABLE, crc32_sql

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
# periods up to this one are found by direct lag scans; a power of two
SHORT = 8
# words of the texts that are searched together
_TOGETHER = 1 << 19
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _needed(period: int) -> int:
    return max(LEAST_LENGTH, LEAST_EXPONENT * period)


def _prime_factors(n: int) -> list[int]:
    found, f = [], 2
    while f * f <= n:
        if n % f == 0:
            found.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return found + [n] * (n > 1)


def _smallest(x: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of two periods or more has no period that divides this one."""
    return not any(np.array_equal(x[start : start + period], x[start + period // f : start + period + period // f]) for f in _prime_factors(period))


def _lag_scan(x: np.ndarray, lag: int) -> list[tuple[int, int, int]]:
    """Every maximal stretch of period ``lag`` that is long enough."""
    differs = np.flatnonzero(x[:-lag] != x[lag:])
    edges = np.concatenate(([-1], differs, [len(x) - lag]))
    long = np.flatnonzero(np.diff(edges) - 1 + lag >= _needed(lag))
    return [(int(edges[k]) + 1, int(edges[k + 1]) + lag, lag) for k in long]


def _same_ahead(x: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j > i on."""
    at, step = 0, 64
    while j + at < len(x):
        a, b = x[i + at : i + at + step], x[j + at : j + at + step]
        differs = np.flatnonzero(a[: len(b)] != b)
        if len(differs):
            return at + int(differs[0])
        at, step = at + len(b), step * 2
    return at


def _same_behind(x: np.ndarray, i: int, j: int) -> int:
    """How many words before i equal those before j > i."""
    at, step = 0, 64
    while i - at > 0:
        n = min(step, i - at)
        differs = np.flatnonzero(x[i - at - n : i - at] != x[j - at - n : j - at])
        if len(differs):
            return at + n - 1 - int(differs[-1])
        at, step = at + n, step * 2
    return at


def _doubled(rank: np.ndarray, length: int) -> np.ndarray:
    """Ranks of blocks of twice the length from those of ``length``: equal blocks, equal rank; -1 where a block occurs once."""
    at = np.flatnonzero(rank[: max(len(rank) - length, 0)] >= 0)
    at = at[rank[at + length] >= 0]
    out = np.full(len(rank), -1, np.int64)
    if len(at):
        _, number, count = np.unique(rank[at] * (int(rank.max()) + 1) + rank[at + length], return_inverse=True, return_counts=True)
        again = count[number] > 1
        out[at[again]] = number[again]
    return out


def _minimizers(rank: np.ndarray, window: int) -> np.ndarray:
    """Sorted positions that are the leftmost smallest of some window of ``window`` (a power of two) block starts.

    Blocks are compared by their rank in a scrambled order; blocks that occur once never win.
    """
    known = rank >= 0
    scrambled = np.random.default_rng(0).permutation(int(rank.max()) + 1)
    none = np.iinfo(np.int64).max
    low = np.full(len(rank), none)
    at = np.flatnonzero(known)
    low[at] = scrambled[rank[at]] * len(rank) + at
    span = 1
    while span < window:
        low = np.minimum(low[:-span], low[span:]) if len(low) > span else low[:0]
        span *= 2
    low = low[low != none]
    return np.unique(low % len(rank))


def _seeded(x: np.ndarray, rank: np.ndarray, scale: int) -> list[tuple[int, int, int]]:
    """Runs with periods in (scale / 2, scale] from ranks of blocks of ``scale`` words.

    Inside a run of such a period equal blocks lie whole periods apart, and window minima repeat one
    period further on; so neighbours of equal rank among the minimizers are one period apart.
    """
    chosen = _minimizers(rank, scale // 2)
    order = np.lexsort((chosen, rank[chosen]))
    chosen = chosen[order]
    gap = np.diff(chosen)
    pair = np.flatnonzero((rank[chosen[1:]] == rank[chosen[:-1]]) & (gap > scale // 2) & (gap <= scale))
    found = []
    lags = gap[pair]
    for lag in np.unique(lags).tolist():
        seeds, k = np.sort(chosen[pair[lags == lag]]), 0
        while k < len(seeds):
            seed = int(seeds[k])
            start = seed - _same_behind(x, seed, seed + lag)
            end = seed + lag + _same_ahead(x, seed, seed + lag)
            if end - start >= _needed(lag):
                found.append((start, end, lag))
            # seeds whose block and its copy lie inside this stretch would find it again
            k = max(k + 1, int(np.searchsorted(seeds, end - lag - scale, "right")))
    return found


def runs_of(texts: Sequence[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each sequence of word numbers, by start, then period.

    The sequences are laid end to end; word numbers are made to differ between them and a number of
    its own ends each, so that nothing repeats across an end.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    if not lengths.sum():
        return out
    parts, base = [], 0
    for t in texts:
        parts += [np.asarray(t, np.int64) + base, np.array([-1], np.int64)]
        base += int(t.max()) + 1 if len(t) else 0
    x = np.concatenate(parts)
    starts = np.cumsum(lengths + 1) - lengths - 1
    x[starts + lengths] = base + np.arange(len(texts))
    found = []
    for lag in range(1, min(SHORT, len(x) - 1) + 1):
        found += [r for r in _lag_scan(x, lag) if _smallest(x, r[0], lag)]
    # a block of one word: its number, where that word occurs again
    rank, length = np.where(np.bincount(x)[x] > 1, x, -1), 1
    longest = int(lengths.max())
    scale = 2 * SHORT
    while LEAST_EXPONENT * (scale // 2 + 1) <= longest and (rank >= 0).any():
        while length < scale:
            rank, length = _doubled(rank, length), 2 * length
        if (rank >= 0).any():
            found += [r for r in _seeded(x, rank, scale) if _smallest(x, r[0], r[2])]
        scale *= 2
    for start, end, period in sorted(set(found), key=lambda r: (r[0], r[2])):
        text = int(np.searchsorted(starts, start, "right")) - 1
        out[text].append((start - int(starts[text]), end - start, period))
    return out


def repeated(n: int, runs: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words lie in a run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def _numbered(tokens: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(t, len(seen)) for t in tokens], np.int64)


def _searched(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text, in groups of bounded size."""
    group, size = [], 0
    for k, text in enumerate(texts):
        # without arguments bytes are split at exactly the six blanks
        group.append(text.split())
        size += len(group[-1])
        if size >= _TOGETHER or k == len(texts) - 1:
            yield from zip(group, runs_of([_numbered(g) for g in group]))
            group, size = [], 0


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, spans, collapsed = [], [], []
        for tokens, runs in _searched([(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(0)]):
            n_words.append(len(tokens))
            spans.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            if runs:
                tokens = [tokens[i] for i in np.flatnonzero(~repeated(len(tokens), runs))]
            collapsed.append(b" ".join(tokens).decode())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        arrays = [pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(collapsed, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], names=[*batch.schema.names[1:], "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """(*keep, n_words, runs, collapsed): the periodic runs of every text, and the text without their repeats.

    A run is a stretch of words that equal the word one period on, of the smallest such period, at
    least four periods and six words long, that no neighbouring word extends. ``runs`` holds start,
    length and period, by start, then period. ``collapsed`` are the words outside all repeats, joined by
    a space: of a run only the first period stays, unless another run repeats that as well.

    Null and empty texts have no words, no runs and an empty collapsed text. Every text is read whole
    and alone, so there is no shuffle; repeated rows and null ids give a row each, an empty table none.
    Columns other than ``keep`` and ``text`` are not read; ``keep`` may not hold the three result names.
    """
    rows = docs.select(F.col(text).alias("_text"), *keep)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"], f"n_words long, runs {RUNS}, collapsed string"])
    return rows.mapInArrow(_find, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every text of crc32(doc_id) % 10 = 0 repeats a stretch of its words up to its end.

    With h that crc32 and g = floor(h / 10), word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). A null doc_id plants nothing.
    """
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    n = F.size("_words").cast("long")
    split = hashed.select("doc_id", "text", F.when(F.col("_h") % 10 == 0, words(F.col("text"))).alias("_words"), F.floor(F.col("_h") / 10).alias("_g"))
    a = F.when(n > 0, F.col("_g") % n)
    p = 1 + F.floor((n - a) / (3 + F.col("_g") % 8))

    def repeat(at: Column) -> Column:
        return F.concat(
            F.slice("_words", F.lit(1), at["a"]),
            F.transform(F.sequence(F.lit(0).cast("long"), n - at["a"] - 1), lambda i: F.get("_words", (at["a"] + i % at["p"]).cast("int"))),
        )

    planted = F.array_join(let(F.struct(a.cast("int").alias("a"), p.alias("p")), repeat), " ")
    return split.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the one of greatest exponent, and digests of all runs and of the collapsed text.

    Length / period is compared exactly; the first in the order of start, then period wins a tie.
    """
    ahead = lambda r, best: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.reduce("runs", F.lit(None).cast(RUNS[6:-1]), lambda best, r: F.when(ahead(r, best), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    one = found.withColumn("_best", best)
    return one.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def oracle() -> str:
    """The same from all pairs of equal words of a text up to a quarter of its length apart."""
    return rf"""
    WITH {CRC_TABLE}, docs AS MATERIALIZED (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql("encode(doc_id::VARCHAR)")} AS h FROM documents, crc_table
    ), laid AS MATERIALIZED (
        SELECT r, doc_id, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w
        FROM (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM (SELECT *, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM docs))
    ), word AS MATERIALIZED (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS w FROM laid
    ), pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
    ), islands AS MATERIALIZED (
        SELECT r, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs)
        GROUP BY r, q, island HAVING count(*) + q >= greatest({LEAST_LENGTH}, {LEAST_EXPONENT} * q)
    ), runs AS MATERIALIZED (
        SELECT a.* FROM islands a WHERE NOT EXISTS (SELECT 1 FROM islands b WHERE b.r = a.r AND b.q < a.q AND a.q % b.q = 0 AND b.s <= a.s AND b.s + b.len >= a.s + a.len)
    ), repeats AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs
    ), kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM word ANTI JOIN repeats USING (r, i) GROUP BY r
    ), spans AS (
        SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
            max({{'e': len::DECIMAL(38,18) / q, 's': -s, 'q': -q, 'l': len}}) AS best FROM runs GROUP BY r
    )
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, (-best.s)::BIGINT AS start, best.l::BIGINT AS length, (-best.q)::BIGINT AS period, (1000 * best.l // -best.q)::BIGINT AS exponent_milli,
        sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
    FROM laid LEFT JOIN spans USING (r) LEFT JOIN kept USING (r)"""
