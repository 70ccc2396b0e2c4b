"""What the corpus operators share: session settings, staged tables, word columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import ensure_checkpoint_dir, tune

# a word is a run of characters that are none of these six
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def prepared(spark: SparkSession) -> SparkSession:
    """Adaptive execution, and Arrow batches small enough for tables with very long texts."""
    tune(spark)
    for key, value in {
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it again.

    Like a reliable checkpoint this cuts the lineage, so that neither a lost executor nor a second
    use computes it again; unlike one it is columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, order: Sequence[Column], name: str) -> tuple[DataFrame, int]:
    """(rows with their place from 0 in ``order``, number of rows): a range sort, no task sees all rows.

    The sorted rows are staged; the driver learns one count per partition of the sort, and the sums of
    the counts before each partition go back as one literal array.
    """
    placed = staged(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    counts = dict(map(tuple, placed.groupBy("_part").count().collect()))
    before, total = [0] * (max(counts, default=0) + 1), 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    # the low 33 bits of the id count the rows of a partition
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    starts = F.array(*[F.lit(n).cast("long") for n in before])
    return placed.withColumn(name, F.get(starts, F.col("_part")) + within).drop("_part", "_at"), total


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def shares(n_rows: int, rows_each: int, least: int = 1) -> int:
    """Number of partitions so that each holds about ``rows_each`` rows."""
    return max(least, -(-n_rows // rows_each))
