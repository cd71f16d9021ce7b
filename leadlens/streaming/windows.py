"""Event-time windows and keyed state over the events stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.operators import mx
from leadlens.sources import shared

#: How late an event may be before it is dropped.
LATE = "1 hour"
#: Files that one batch takes; batches after which the state of all hosts is written.
FILES = 64
WHOLE = 10


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a stream source takes a folder or a glob
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame) -> DataFrame:
    """Events and whole values by type and hour."""
    g = events.withWatermark("at", LATE).groupBy("event_type", F.window("at", "1 hour")).agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total"))
    return g.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "total")


def sliding_quota(events: DataFrame) -> DataFrame:
    """What each user has used in every 24 hours, moved on by six."""
    k = F.try_element_at(F.from_json("props", "map<string,int>"), F.lit("k"))
    g = events.withWatermark("at", LATE).groupBy("user_id", F.window("at", "24 hours", "6 hours")).agg(F.count("*").alias("n"), F.sum(k).alias("used"))
    return g.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "used")


def mx_state(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    """Running average of each host's probe times, going on from the state of the batches before; a batch's rows count in time order."""
    keyed = batch.select(F.concat(F.lit("mx"), F.col("user_id") % 20).alias("mx_host"), F.col("at").alias("checked_at"), F.col("event_id").alias("id"), F.floor(F.col("value") * 10).cast("int").alias("elapsed_ms"))
    return mx.running_average(keyed, before)


def _state(spark: SparkSession, base: str, before: int) -> DataFrame | None:
    """Each host's last state from the batches before one: the last whole table and the changes after it, as the folder has them."""
    names = [(int(n.split("_")[0]), n) for n in shared.written(spark, f"{base}/rows")]
    names = sorted(n for n in names if n[0] < before)
    if not names:
        return None
    since = max((k for k, n in names if n.endswith("_all")), default=-1)
    parts = [spark.read.parquet(f"{base}/rows/{n}").withColumn("batch", F.lit(k)) for k, n in names if k >= since]
    return reduce(DataFrame.union, parts).groupBy("mx_host").agg(F.max_by(F.struct("n", "average"), "batch").alias("s")).select("mx_host", "s.*")


def _next_state(batch: DataFrame, k: int, base: str) -> None:
    """Write what a batch changes; every ``WHOLE``th batch the state of all hosts."""
    spark = batch.sparkSession
    held, whole = _state(spark, base, k), k % WHOLE == WHOLE - 1
    if held is not None and not whole:
        met = batch.select(F.concat(F.lit("mx"), F.col("user_id") % 20).alias("mx_host")).distinct()
        held = held.join(met, "mx_host", "left_semi")
    mx_state(batch, held).write.mode("overwrite").parquet(f"{base}/rows/{k}_{'all' if whole else 'new'}")


def run_to_end(spark: SparkSession, sf_dir: str, form: Callable[..., DataFrame], base: str | None = None) -> DataFrame:
    """Run a stream over all that is there and give the result table.

    Each batch writes the rows it changes as Parquet, none come to the driver.
    Windows are kept until the watermark passes them, so the state doesn't grow
    with the stream; the result has each window's last row. ``base``: a folder
    to go on in, from the stream's log and from the rows written there; else one
    of its own in the checkpoint folder.
    """
    base = base or f"{shared.folder(spark)}/s_{uuid.uuid4().hex}"
    events = source(spark, sf_dir)
    keyed = form is mx_state
    rows = events if keyed else form(events)

    def write(batch: DataFrame, k: int) -> None:
        if keyed:
            _next_state(batch, k, base)
        else:
            batch.write.mode("overwrite").parquet(f"{base}/rows/{k}_new")

    q = rows.writeStream.foreachBatch(write).outputMode("append" if keyed else "update").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    if keyed:
        out = _state(spark, base, 1 << 60)
        return spark.createDataFrame([], "mx_host string, n long, average double") if out is None else out.withColumn("average", F.round("average", 6))
    names = shared.written(spark, f"{base}/rows")
    if not names:
        return spark.createDataFrame([], rows.schema)
    keys, values = rows.columns[:2], rows.columns[2:]
    parts = [spark.read.schema(rows.schema).parquet(f"{base}/rows/{n}").withColumn("batch", F.lit(int(n.split("_")[0]))) for n in names]
    return reduce(DataFrame.union, parts).groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
