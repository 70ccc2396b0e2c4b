"""Keyed state of streams that expires by event time.

A micro-batch is pre-aggregated per key, merged with the rows still open and written as one partition of
the state table, split into open and ended rows. The next batch reads the open rows of the last one alone,
so its state holds what is alive and not all keys ever seen. The parts are associative: an event that comes
after its key has ended opens a second row, and readers merge both, so no lateness changes a result.
A repeated batch replaces its own partition. Hot keys combine map-side before they meet.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.runs import cooldown_accept
from tracewell.session import stored
from tracewell.streaming.feeds import finished_batches, remove_folder

Parts = Mapping[str, tuple[str, Column]]


class KeyedState:
    """``parts``: name -> ("min" | "max" | "sum", value of an event). ``at``: event time in microseconds.

    ``ended(clock)`` says by the newest event time seen whether a row may leave the state; a null verdict keeps it.
    """

    def __init__(self, stream: DataFrame, folder: str, keys: Sequence[str], parts: Parts, at: Column, ended: Callable[[Column], Column]):
        self.stream, self.keys, self.at, self.ended = stream, list(keys), at, ended
        self.sink, self.checkpoint = f"{folder}/state", f"{folder}/checkpoint"
        self.parts = [getattr(F, how)(value).alias(name) for name, (how, value) in parts.items()]
        self.merge = [getattr(F, how)(name).alias(name) for name, (how, _) in parts.items()]
        row = stream.groupBy(*self.keys).agg(*self.parts).schema
        self.schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in row], T.StructField("_clock", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("ended", T.IntegerType())])

    def _table(self, spark) -> DataFrame:
        if not finished_batches(spark, self.sink):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self.sink)

    def _fold(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in finished_batches(spark, self.sink) if n < number]
        rows, clock = batch.groupBy(*self.keys).agg(*self.parts), batch.agg(F.max(self.at)).first()[0]
        if before:
            past = self._table(spark).filter(F.col("batch") == before[-1])
            clocks = [c for c in (clock, past.agg(F.max("_clock")).first()[0]) if c is not None]
            clock = max(clocks) if clocks else None
            rows = rows.unionByName(past.filter("ended = 0").select(*rows.columns)).groupBy(*self.keys).agg(*self.merge)
        now = F.lit(clock).cast("long")
        out = rows.withColumn("_clock", now).withColumn("ended", F.coalesce(self.ended(now).cast("int"), F.lit(0)))
        out.write.mode("overwrite").partitionBy("ended").parquet(f"{self.sink}/batch={number}")
        # the open rows of the last batch stay, as this one may be repeated; those before it are not read again
        for n in before[-3:-1]:
            remove_folder(spark, f"{self.sink}/batch={n}/ended=0")

    def drain(self) -> KeyedState:
        """Fold everything that has arrived since the checkpoint, then stop."""
        query = self.stream.writeStream.foreachBatch(self._fold).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return self

    def open_rows(self, spark) -> DataFrame:
        """What the next batch will read."""
        done = finished_batches(spark, self.sink)
        return self._table(spark).filter((F.col("batch") == (done[-1] if done else -1)) & (F.col("ended") == 0)).select(*self.keys, *self._names())

    def rows(self, spark) -> DataFrame:
        """One row per key over all events so far, ended or not."""
        done = finished_batches(spark, self.sink)
        last = done[-1] if done else -1
        table = self._table(spark).filter((F.col("batch") == last) | ((F.col("ended") == 1) & (F.col("batch") < last)))
        return table.groupBy(*self.keys).agg(*self.merge)

    def _names(self) -> list[str]:
        return [f.name for f in self.schema if f.name not in (*self.keys, "_clock", "batch", "ended")]


def cooldown_available(stream: DataFrame, folder: str, key: str, order: str, at: Column, cooldown: int, delay: int) -> None:
    """Deliver the events a per-key cooldown accepts; times and widths in one unit.

    The state is the last accepted event of each key. An event within the cooldown of it, or older than it, is refused,
    the others of the batch are decided as in the batch form. A key is purged once its cooldown ended ``delay`` before
    the newest event; events that come later than ``delay`` are dropped, so a purged key is never missed. Batches that
    arrive in order of time accept what the batch form accepts over all events. Rows without a key or a time are no events.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in finished_batches(spark, f"{folder}/state") if n < number]
        events = stored(batch.select(key, F.col(order).alias("_o"), at.cast("long").alias("_t")))
        newest, last = events.agg(F.max("_t")).first()[0], None
        clock = newest
        if before:
            past = spark.read.schema(events.schema.add("_clock", "long")).parquet(f"{folder}/state/batch={before[-1]}")
            seen = past.agg(F.max("_clock")).first()[0]
            clock = max(c for c in (newest, seen) if c is not None) if (newest, seen) != (None, None) else None
            last = past.filter(F.col(key).isNotNull()).drop("_clock")
            if seen is not None:
                events = events.filter(F.col("_t") >= seen - delay)
            anchors = last.select(key, F.col("_t").alias("_last"))
            events = events.join(anchors, key, "left").filter(F.col("_last").isNull() | (F.col("_t") >= F.col("_last") + cooldown)).drop("_last")
        taken = cooldown_accept(events, key, "_o", F.col("_t"), cooldown, 4 * cooldown)
        accepted = stored(events.join(taken, [key, "_o"], "left_semi"))
        accepted.select(key, F.col("_o").alias(order)).write.mode("overwrite").parquet(f"{folder}/sink/batch={number}")
        held = accepted if last is None else last.select(*accepted.columns).unionByName(accepted)
        held = held.groupBy(key).agg(F.max(F.struct("_t", "_o")).alias("_l")).select(key, F.col("_l._o").alias("_o"), F.col("_l._t").alias("_t"))
        kept = held.filter(F.col("_t") + cooldown > F.lit(clock).cast("long") - delay) if clock is not None else held
        mark = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema], F.lit(clock).cast("long").alias("_clock"))
        kept.withColumn("_clock", F.lit(clock).cast("long")).unionByName(mark).write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
        for n in before[-3:-1]:
            remove_folder(spark, f"{folder}/state/batch={n}")

    query = stream.filter(F.col(key).isNotNull() & at.isNotNull()).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
