"""Shards that each hold the mixture of the whole: proportional stratified interleaving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import positions, staged

SHARDS = 16
SEED = "interleave"


def _hashed(seed: str, value: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), value))


def interleave(rows: DataFrame, shards: int = SHARDS, seed: str = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, *carry, shard, slot): every row in one of ``shards`` shards of equal mixture.

    The rows of a source are shuffled by a seeded hash of doc_id and ranked. Rank r of n becomes the
    fraction (r + phase) / n, where the phase is a hash of the source in [0, 1), so that small sources
    do not all stand at the same place. Sorted by fraction the sources are interleaved in proportion,
    and cuts at equal counts give each shard n / shards rows of a source, but for a row or two.
    Shards differ by one row at most; ``slot`` counts from 0 without gaps. Reruns agree: the order
    rests on doc_id, source and the carried columns alone, so rows that differ in none of them are
    interchangeable.

    A hot source is spread by the range sort on (source, hash); repeated rows sort next to each other
    and take places of their own. A null source is a source, after all others. All rows without a
    doc_id share one hash and are ordered by the carried columns. With fewer rows than shards some
    shards stay empty; an empty table gives an empty result. Other columns are not read.
    """
    carry = list(carry)
    source = F.col("source").asc_nulls_last()
    base = rows.select("doc_id", "source", *carry, _hashed(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_hash"))
    shuffled, total = positions(staged(base), [source, F.col("_hash"), F.col("doc_id").asc_nulls_last(), *carry], "_place")
    strata = shuffled.groupBy(F.col("source").alias("_source")).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    name = F.coalesce(F.concat(F.lit("="), F.col("_source").cast("string")), F.lit(""))
    # twelve hexadecimal digits are exact in a double
    phase = F.conv(F.substring(_hashed(seed, name), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    known = shuffled.join(strata.withColumn("_phase", phase), F.col("source").eqNullSafe(F.col("_source")))
    rank = F.col("_place") - F.col("_first")
    dealt = known.select("doc_id", "source", *carry, rank.alias("_rank"), ((rank + F.col("_phase")) / F.col("_n")).alias("_fraction"))
    placed, _ = positions(dealt, [F.col("_fraction"), source, F.col("_rank")], "_place")
    cut = placed.withColumn("shard", F.expr(f"(_place * {shards}) div {max(total, 1)}"))
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return cut.select("doc_id", "source", *carry, F.col("shard").cast("int").alias("shard"), (F.col("_place") - start).alias("slot"))


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, text_crc32): UTF-8 bytes plus 1 and the checksum of each text; a null text is an empty one."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard and source, by equal counts."""
    placed = interleave(sized(docs), shards, seed, ["size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def crc32_sql(data: str) -> str:
    """DuckDB expression for the checksum of a BLOB expression, with the column ``t`` of ``CRC_TABLE``."""
    return f"""xor(4294967295::BIGINT, list_reduce(list_transform(regexp_extract_all(hex({data}), '..'), lambda b: ('0x' || b)::BIGINT), lambda c, b:
        xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"""


CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda i:
        list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i)) AS t)"""


def oracle() -> str:
    return f"""
    WITH {CRC_TABLE}, sized AS MATERIALIZED (
        SELECT doc_id, source, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size,
            CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {crc32_sql("encode(text)")} END AS text_crc32,
            md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h, ('0x' || md5('{SEED}:' || coalesce('=' || source, ''))[1:12])::BIGINT / 281474976710656.0::DOUBLE AS phase
        FROM documents, crc_table
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS LAST, size, text_crc32) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM sized
    ), dealt AS (
        SELECT *, row_number() OVER (ORDER BY (r + phase) / n, source NULLS LAST, r) - 1 AS place, count(*) OVER () AS total FROM ranked
    ), cut AS (SELECT *, (place * {SHARDS}) // total AS s FROM dealt)
    SELECT doc_id, size, text_crc32, 'rows' AS law, s::INT AS shard, (place - (s * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, source FROM cut"""
