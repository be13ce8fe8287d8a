"""Progress as a stream: patches folded into a state per job, late data, single flight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A field that a patch carries with this value is cleared; a field that it lacks stays.
CLEARED = "\x00"


def fold(patches: DataFrame, key: str = "job", at: str = "ts", fields: tuple[str, ...] = ("status", "progress", "message")) -> DataFrame:
    """The last value of each field per job, in the order of time; cleared fields are null.

    A batch and a stream give the same rows: each field is the value of the greatest (time, value) that
    sets it, so the aggregate is associative, needs no order and combines before the shuffle.
    """
    latest = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(at).alias("t"), F.col(f).alias("v")))).alias(f) for f in fields]
    value = lambda f: F.when(F.col(f)["v"].cast("string") != CLEARED, F.col(f)["v"]).alias(f)
    return patches.groupBy(key).agg(F.max(at).alias("last_at"), F.count("*").alias("patches"), *latest).select(key, "last_at", "patches", *(value(f) for f in fields))


def run_fold(spark: SparkSession, source: str, schema: StructType, checkpoint: str, name: str, **how) -> DataFrame:
    """Fold all files of a folder as a stream, until they are read, and return the state.

    Every batch writes what changed under its own number, so a repeated batch replaces itself, and the state is
    the newest row of each key; nothing of it is held by the driver.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    folded = fold(stream, **how)
    kinds = folded.schema
    where = f"{checkpoint}/{name}"
    query = folded.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{where}/batch={n}")).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    key = how.get("key", "job")
    rows = spark.read.schema(kinds.add("batch", "long")).parquet(where)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("batch").desc()))).where("__n = 1").drop("batch", "__n")


def windowed_counts(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Events per window and kind; rows later than the watermark are left out on a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), by, "events")


def single_flight(requests: DataFrame, key: str = "request", at: str = "ts", within: str = "10 minutes") -> DataFrame:
    """Each request once within the watermark, however many ask for it at the same time."""
    return requests.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def stalled(states: DataFrame, now, after_seconds: int = 60) -> DataFrame:
    """Jobs that still run but have said nothing for ``after_seconds``."""
    running = ~F.col("status").isin("done", "cancelled", "error", "idle")
    return states.where(running & (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("last_at") >= after_seconds))
