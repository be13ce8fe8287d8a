"""Sinks: job bundles, event lines, keyed tables. Writes are atomic through Spark's commit protocol."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.sources.files import wav_bytes


def write_job_bundle(jobs: DataFrame, chunks: DataFrame, path: str, done: DataFrame | None = None) -> None:
    """``job``: one JSON object per job with its number of pending chunks; ``chunks``: one line {job_key, i, pieces} per pending chunk.

    Pending are chunks with pieces that are not ``done`` (job_key, i), each once, under their own numbers. Lines of a job
    lie together in order; jobs share files, so a million jobs make no million folders.
    """
    pending = chunks.where("pieces is not null").select("job_key", "i", "pieces").dropDuplicates(["job_key", "i"])
    if done is not None:
        pending = pending.join(done.select("job_key", "i"), ["job_key", "i"], "left_anti")
    counts = pending.groupBy("job_key").agg(F.count("*").alias("pending"))
    jobs.drop("pending").join(counts, "job_key", "left").withColumn("pending", F.coalesce("pending", F.lit(0))).write.mode("overwrite").json(f"{path}/job")
    pending.repartition("job_key", F.floor(F.col("i") / 10_000)).sortWithinPartitions("job_key", "i").write.mode("overwrite").json(f"{path}/chunks")


def joined_sounds(parts: DataFrame, key: str, order: str, pcm: str, rate: int) -> DataFrame:
    """(key, wav): the 16-bit parts of each key one after the other in one sound file; null parts are left out.

    The parts of a key are sorted on disk and written as they stream by; a task holds one key's sound, which is a file in the end.
    """
    schema = f"{key} {dict(parts.dtypes)[key]}, wav binary"

    def run(it):
        import pandas as pd

        now, held = None, []
        for pdf in it:
            for k, x in zip(pdf[key], pdf[pcm]):
                if held and k != now:
                    yield pd.DataFrame({key: [now], "wav": [wav_bytes(np.frombuffer(b"".join(held), "<i2"), rate)]})
                    held = []
                now = k
                held.append(bytes(x))
        if held:
            yield pd.DataFrame({key: [now], "wav": [wav_bytes(np.frombuffer(b"".join(held), "<i2"), rate)]})

    return parts.select(key, order, pcm).where(F.col(pcm).isNotNull()).repartition(key).sortWithinPartitions(key, order).drop(order).mapInPandas(run, schema)


def event_lines(events: DataFrame, kind: str = "type") -> DataFrame:
    """(value): one JSON object per event, null fields left out."""
    rest = [c for c in events.columns if c != kind]
    return events.select(F.to_json(F.struct(F.col(kind), *rest)).alias("value"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, text: str = "text", at: str | None = None) -> DataFrame:
    """The keyed table after incoming rows replaced those of the same key; rows with empty text are deletions.

    Of several incoming rows of a key the last in the order of ``at`` counts, or of their values where none is named.
    """
    order = [F.col(at).desc_nulls_last()] if at else []
    rest = [F.col(c).desc_nulls_last() for c in incoming.columns if c not in (key, at)]
    incoming = incoming.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order, *rest))).where("__n = 1").drop("__n")
    kept = existing.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming.where((F.col(text).isNotNull()) & (F.col(text) != "")), allowMissingColumns=True)
