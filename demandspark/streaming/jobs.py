"""Streaming counterparts of the batch jobs: pricing, hourly counts, lag features.

Row-local rules are the batch functions applied to a streaming frame. Row windows do not
exist on streams, so lag features join each micro-batch with the last rows of its keys,
kept in a state table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from demandspark.config import BusinessConfig
from demandspark.operators.ordered import Op, OrderedFrame, SeriesSpec
from demandspark.plans.pricing import price_table
from demandspark.sources import contract


#: Buckets of the state of lag features; each is a folder of one file.
STATE_BUCKETS = 256
_SLOTS = "bucket int, slot int"


def read_stream(
    spark: SparkSession, path: str, schema: str | T.StructType, glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet file source with a fixed schema."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def files_by_batch(df: DataFrame, column: str, staged: str, out: str) -> str:
    """One parquet file per value of ``column`` under ``out``, written in ascending order, for a
    file stream of one file a trigger.

    The table is scanned once, by all tasks, into folders by value; each file then reads only its
    own folder. Rows of a null value belong to no batch.
    """
    df.where(F.col(column).isNotNull()).write.partitionBy(column).parquet(staged)
    spark = df.sparkSession
    for (value,) in sorted(spark.read.parquet(staged).select(column).distinct().collect()):
        part = spark.read.schema(df.drop(column).schema).parquet(f"{staged}/{column}={value}")
        part.coalesce(1).write.parquet(f"{out}/{column}={value:03d}")
    return out


def price_stream(
    requests: DataFrame,
    config: BusinessConfig | None = None,
    demand: Column | str = "demand",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Check, round and price requests; one projection, so it runs on streams and tables.

    Requests outside the input contract keep their row with null prices and an error.
    """
    kept = list(requests.columns if keep is None else keep)
    checked = contract.round_inputs(contract.check(requests))
    priced = price_table(checked, config, demand, keep=[*kept, "violations"])
    bad = F.size("violations") > 0
    nulled = {
        c: F.when(~bad, F.col(c)) for c in ("price", "price_multiplier", "surge", "discount", "competitor_price")
    }
    error = F.when(bad, F.concat(F.lit("input:"), F.array_join("violations", ","))).otherwise(F.col("error"))
    return priced.withColumns({**nulled, "error": error}).drop("violations")


def hourly_stream(
    events: DataFrame,
    ts: str,
    aggs: dict[str, Column],
    keys: Sequence[str] = (),
    delay: str = "2 hours",
    name: str = "datetime",
) -> DataFrame:
    """Hourly aggregates per key on a stream; events later than ``delay`` are dropped.

    In append mode an hour appears once the watermark has passed its end. ``open_hours`` gives the
    hours that a finished source leaves open; ``accounted_hours`` keeps the late events too.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    counted = timed.groupBy(F.window(ts, "1 hour"), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return counted.select(*keys, F.col("window.start").alias(name), *aggs)


def open_hours(
    events: DataFrame,
    written: DataFrame,
    ts: str,
    aggs: dict[str, Column],
    keys: Sequence[str] = (),
    name: str = "datetime",
) -> DataFrame:
    """Closing step: hours of a finished source (a plain table) after the last written hour.

    Every earlier hour that had events in time has been written, so the two together are the
    hours of the whole source. Only events after that hour are read.
    """
    last = written.agg(F.max(name)).first()[0]
    if last is not None:
        begin = F.lit(last) + F.expr("interval 1 hour")
        events = events.where(F.col(ts).cast("timestamp") >= begin)
    return hourly_stream(events, ts, aggs, keys, name=name)


#: Aggregates whose parts combine: what is computed of the events, how parts are put together.
COMBINED = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


@dataclass(frozen=True)
class HourlyTables:
    """Where an accounted hourly stream keeps its rows; ``late`` has the rejected events whole."""

    path: str

    def closed(self, spark: SparkSession) -> DataFrame:
        """Hours that were over when they were written; each appears once."""
        return self._epochs(spark, "closed")

    def late(self, spark: SparkSession) -> DataFrame:
        """Events of hours that were closed when they came."""
        return self._epochs(spark, "late")

    def open(self, spark: SparkSession) -> DataFrame:
        """Hours that the events so far leave open."""
        last = self._last(spark)
        return spark.read.parquet(f"{self.path}/open/{last % 2}")

    def _epochs(self, spark: SparkSession, name: str) -> DataFrame:
        # One batch after the last one known may have failed half-way and will be written again.
        return spark.read.parquet(f"{self.path}/{name}").where(F.col("epoch") <= self._last(spark)).drop("epoch")

    def _last(self, spark: SparkSession) -> int:
        return self.marks(spark).agg(F.max("epoch")).first()[0]

    def marks(self, spark: SparkSession) -> DataFrame:
        """(epoch, seen): the latest event time up to each of the last two batches."""
        return spark.read.schema("epoch bigint, seen timestamp").parquet(f"{self.path}/marks/0", f"{self.path}/marks/1")


def accounted_hours(
    events: DataFrame, ts: str, aggs: dict[str, tuple[str, str]], keys: Sequence[str], tables: HourlyTables, checkpoint: str, delay: str = "2 hours", name: str = "datetime"
) -> StreamingQuery:
    """Hourly aggregates in which every event is accounted for: closed hours, open hours, late events.

    An hour is closed once the latest event time less ``delay`` has reached its end; an event that
    comes for an hour that earlier batches closed is late and is kept whole. The watermark is a
    table of the batches, so nothing depends on the progress Spark keeps. ``aggs`` names a
    function of ``COMBINED`` and its column; open hours hold the combined parts. Open hours and
    watermark have two slots and closed and late rows a folder for each batch, so a batch that
    is run again after a failure gives the same files. Events without a time are late.
    """
    hour = F.date_trunc("hour", ts).cast("timestamp").alias(name)
    over = lambda mark: (F.col(name) + F.expr("interval 1 hour")) <= (mark - F.expr(f"interval {delay}"))

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        seen = None
        if epoch > 0:
            seen = spark.read.schema("epoch bigint, seen timestamp").parquet(f"{tables.path}/marks/{(epoch - 1) % 2}").first()["seen"]
        rows = batch.withColumn(name, hour).persist()
        try:
            late = F.col(name).isNull() if seen is None else F.col(name).isNull() | over(F.lit(seen))
            rows.where(late).drop(name).write.mode("overwrite").parquet(f"{tables.path}/late/epoch={epoch}")
            parts = rows.where(~late).groupBy(*keys, name).agg(*[COMBINED[f][0](c).alias(n) for n, (f, c) in aggs.items()])
            if epoch > 0:
                before = spark.read.schema(parts.schema).parquet(f"{tables.path}/open/{(epoch - 1) % 2}")
                parts = parts.unionByName(before).groupBy(*keys, name).agg(*[COMBINED[f][1](n).alias(n) for n, (f, _) in aggs.items()])
            latest = rows.agg(F.max(F.col(ts).cast("timestamp"))).first()[0]
            now = max((t for t in (seen, latest) if t is not None), default=None)
            done = F.lit(False) if now is None else over(F.lit(now))
            parts = parts.persist()
            parts.where(done).write.mode("overwrite").parquet(f"{tables.path}/closed/epoch={epoch}")
            parts.where(~done).write.mode("overwrite").parquet(f"{tables.path}/open/{epoch % 2}")
            parts.unpersist()
            # Last, as it says that the batch is whole.
            mark = spark.createDataFrame([(epoch, now)], "epoch bigint, seen timestamp").coalesce(1)
            mark.write.mode("overwrite").parquet(f"{tables.path}/marks/{epoch % 2}")
            if epoch == 0:
                mark.limit(0).write.mode("ignore").parquet(f"{tables.path}/marks/1")
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet files and stop when the available input is done."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def lag_feature_stream(
    hours: DataFrame, spec: SeriesSpec, ops: Sequence[Op], path: str, state: str, checkpoint: str, buckets: int = STATE_BUCKETS
) -> StreamingQuery:
    """Append ordered-series features of arriving rows to ``path``.

    Rows must arrive in series order per key across batches, as closed hours do. Each batch is
    computed together with the last ``reach`` rows of its keys, which are kept in hash buckets:
    only buckets with new rows are read and written again. A bucket has two slots and a batch
    writes the one it doesn't read; which slots are current is a small table of its own, also
    in two slots. So a batch that is run again after a failure gives the same files.
    """
    if any(op.ahead for op in ops):
        raise ValueError("a stream has no later rows: lead is not available")
    reach = max((op.back for op in ops), default=0)
    cols = hours.columns
    schema = hours.schema
    bucket = F.pmod(F.xxhash64(*spec.partition_by), F.lit(buckets)).cast("int") if spec.partition_by else F.lit(0)

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # Both have at most one row per bucket.
        current: dict[int, int] = {}
        if epoch > 0:
            current = dict(spark.read.schema(_SLOTS).parquet(f"{state}/current/{(epoch - 1) % 2}").collect())
        new = batch.withColumns({"__bucket": bucket, "__new": F.lit(True)}).persist()
        rows = new
        try:
            touched = {r[0] for r in new.select("__bucket").distinct().collect()}
            old = [f"{state}/rows/__bucket={b}/__slot={current[b]}" for b in sorted(touched & current.keys())]
            if old:
                before = spark.read.schema(schema).parquet(*old)
                rows = new.unionByName(before.withColumns({"__bucket": bucket, "__new": F.lit(False)})).persist()
            done = OrderedFrame(rows.drop("__bucket"), spec).with_ops(ops).df.where("__new").drop("__new")
            done.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
            if touched:
                w = Window.partitionBy("__bucket", *spec.partition_by).orderBy(*[F.desc(c) for c in spec.order_by])
                tail = rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= reach)
                other = {b: 1 - current.get(b, 1) for b in touched}
                number = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(other.items()) for x in pair]), F.col("__bucket"))
                tail = tail.select(*cols, "__bucket", number.alias("__slot")).repartition("__bucket")
                kept = tail.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                kept.partitionBy("__bucket", "__slot").parquet(f"{state}/rows")
                current |= other
            slots = spark.createDataFrame(sorted(current.items()), _SLOTS)
            slots.coalesce(1).write.mode("overwrite").parquet(f"{state}/current/{epoch % 2}")
        finally:
            new.unpersist()
            rows.unpersist()

    return (
        hours.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
