"""Progress folds over the event table, as a batch and as a stream, and SNK rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.queries import register
from quillmill.session import checkpoint_dir, table
from quillmill.sources import sinks
from quillmill.streaming import progress as P

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
FOLD = """SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_at, count(*) AS patches, max(struct_pack(t := ts, v := event_type)).v AS event_type,
max(struct_pack(t := ts, v := value)).v AS value FROM events GROUP BY user_id"""


@register("progress_fold", FOLD)
def progress_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.fold(table(spark, sf_dir, "events"), "user_id", "ts", ("event_type", "value"))
    return out.select("user_id", F.date_format("last_at", STAMP).alias("last_at"), "patches", "event_type", "value")


@register("progress_stream", FOLD)
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold as a stream that reads the table's files until none is left."""
    schema = table(spark, sf_dir, "events").schema
    where = f"{checkpoint_dir(spark)}/progress-{uuid.uuid4()}"
    out = P.run_fold(spark, f"{sf_dir}/events.parquet*", schema, where, "progress_state", key="user_id", at="ts", fields=("event_type", "value"))
    return out.select("user_id", F.date_format("last_at", STAMP).alias("last_at"), "patches", "event_type", "value")


@register("hourly_events", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS start, event_type, count(*) AS events FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.windowed_counts(table(spark, sf_dir, "events")).select(F.date_format("start", STAMP).alias("start"), "event_type", "events")


@register("event_lines", """SELECT '{"event_type":"' || event_type || '","event_id":' || event_id || ',"user_id":' || user_id || '}' AS value FROM events""")
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.event_lines(table(spark, sf_dir, "events").select("event_type", "event_id", "user_id"), "event_type")


@register("book_upsert", "WITH l AS (SELECT DISTINCT book_id, text FROM books WHERE text IS NOT NULL) SELECT book_id, length(text) AS chars FROM l")
def book_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All books put over a table that has some of them already, with other text."""
    b = table(spark, sf_dir, "books").select("book_id", "text").where("text is not null").distinct()
    old = b.where(F.crc32("book_id") % 3 == 0).select("book_id", F.lit("old").alias("text"))
    return sinks.upsert(old, b, "book_id").select("book_id", F.length("text").cast("bigint").alias("chars"))
