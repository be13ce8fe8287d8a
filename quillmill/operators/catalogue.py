"""Voice catalogues, jobs and chunk deliveries: lookups, grouping, ordering, set operations, resume."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.functions.maths import run_key

ENGINES = ["piper", "supertonic", "kokoro"]


def union_catalogues(parts: list[DataFrame]) -> DataFrame:
    """All rows of several catalogues; columns that one lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_licence(voices: DataFrame, by_dataset: DataFrame, by_engine: DataFrame) -> DataFrame:
    """voices with ``licence``: of the dataset for engines that name one, else of the engine, else unknown.

    Both tables are lookups of a few rows; the optimizer broadcasts them by their size.
    """
    out = voices.join(by_dataset, voices["name"] == by_dataset["dataset"], "left").drop("dataset").withColumnRenamed("licence", "__d")
    out = out.join(by_engine.withColumnRenamed("engine", "__engine"), F.col("engine") == F.col("__engine"), "left").drop("__engine").withColumnRenamed("licence", "__e")
    return out.withColumn("licence", F.coalesce(F.when(F.col("engine") == "piper", F.col("__d")), F.when(F.col("engine") != "piper", F.col("__e")), F.lit("unknown"))).drop("__d", "__e")


def search(voices: DataFrame, needle: str) -> DataFrame:
    """Rows of which some shown field, the licence too where there is one, contains ``needle``, without regard to case; all rows for a blank one."""
    fields = F.lower(F.concat_ws(" ", "name", "label", "locale", "quality", "gender", "engine", "voice_group", *(["licence"] if "licence" in voices.columns else [])))
    n = needle.strip().lower()
    return voices if not n else voices.where(fields.contains(n))


def grouped(voices: DataFrame) -> DataFrame:
    """(voice_group, voices, names, with_locale), and how many are ``publishable`` where a column says so."""
    free = [F.count_if("publishable").alias("publishable")] if "publishable" in voices.columns else []
    return voices.groupBy("voice_group").agg(F.count("*").alias("voices"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"), F.count("locale").alias("with_locale"), *free)


def newest_batch(rows: DataFrame, at: str = "added_at", hours: int = 1) -> DataFrame:
    """Rows within ``hours`` of the latest; none when those are all rows. The latest is one value, joined back."""
    top = rows.agg(F.max(at).alias("__top"), F.count(at).alias("__n"))
    late = rows.join(F.broadcast(top), F.col(at) >= F.col("__top") - F.expr(f"INTERVAL {hours} HOURS"))
    size = late.agg(F.count("*").alias("__late"))
    return late.join(F.broadcast(size), F.col("__late") < F.col("__n")).drop("__top", "__n", "__late")


def newest_first(rows: DataFrame, at: str = "added_at") -> list[Column]:
    """Order: latest first, rows without a time last."""
    return [F.coalesce(F.unix_micros(at), F.lit(0)).desc()]


def keep_latest(rows: DataFrame, keys: list[str], at: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*at))).where("__rn = 1").drop("__rn")


def pruned(rows: DataFrame, keep: int, at: str) -> DataFrame:
    """The rows a cache of ``keep`` entries would drop: all but the latest. A global rank over the keys alone."""
    order = [F.col(at).desc(), *[F.col(c) for c in rows.columns if c != at]]
    kept = rows.orderBy(*order).limit(keep).select(*(F.col(c).alias(f"__{c}") for c in rows.columns))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in rows.columns]
    return rows.join(kept, functools.reduce(operator.and_, same), "left_anti")


def deliveries(chunks: DataFrame) -> DataFrame:
    """(job_key, i, n_pieces, deliveries, first_at, last_at): each chunk once; partial counts before the shuffle."""
    return chunks.groupBy("job_key", "i").agg(F.max(F.coalesce(F.size("pieces"), F.lit(0))).alias("n_pieces"), F.count("*").alias("deliveries"), F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"))


def planned(jobs: DataFrame) -> DataFrame:
    """(job_key, i): the chunk numbers that each job with a total should have."""
    j = jobs.where("total > 0").groupBy("job_key").agg(F.max("total").alias("total"))
    return j.select("job_key", F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("i"))


def pending(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Planned chunks that were not delivered."""
    return planned(jobs).join(chunks.select("job_key", "i").distinct(), ["job_key", "i"], "left_anti")


def finished(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(job_key, done): planned chunks that were delivered."""
    return planned(jobs).join(chunks.select("job_key", "i").distinct(), ["job_key", "i"], "left_semi").groupBy("job_key").agg(F.count("*").alias("done"))


def resume_state(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(job_key, run_key, total, done, missing, progress): what a job's run could resume from."""
    j = jobs.where("total > 0").groupBy("job_key").agg(F.max("total").alias("total"), F.max_by("voice_id", "exported_at").alias("voice_id"), F.max_by("speed", "exported_at").alias("speed"), F.max_by("title", "exported_at").alias("title"))
    out = j.join(finished(jobs, chunks), "job_key", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    key = run_key(F.col("voice_id"), F.col("speed"), F.coalesce("title", F.lit("")))
    return out.select("job_key", key.alias("run_key"), "total", "done", (F.col("total") - F.col("done")).alias("missing"), F.floor(F.col("done") * 70 / F.col("total") + 0.5).alias("progress"))


def cumulative(chunks: DataFrame, seconds_per_word: float = 0.38) -> DataFrame:
    """(job_key, i, words, start_sec, end_sec): a job's chunks on its running clock.

    The running sum is by job; the open feed is one job, so sums are first made per block of 1,000
    chunks and then within blocks, and no task sees a whole feed.
    """
    c = keep_latest(chunks, ["job_key", "i"], [F.col("received_at").desc(), F.col("words").desc_nulls_last(), F.md5(F.to_json(F.struct("pieces", "words")))])
    c = c.select("job_key", "i", F.coalesce("words", F.lit(0)).alias("words"), F.floor(F.col("i") / 1000).alias("b"))
    per = c.groupBy("job_key", "b").agg(F.sum("words").alias("w"))
    before = per.select("job_key", "b", F.coalesce(F.sum("w").over(Window.partitionBy("job_key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    run = F.sum("words").over(Window.partitionBy("job_key", "b").orderBy("i"))
    out = c.join(before, ["job_key", "b"]).withColumn("upto", run + F.col("before"))
    return out.select("job_key", "i", "words", F.round((F.col("upto") - F.col("words")) * seconds_per_word, 2).alias("start_sec"), F.round(F.col("upto") * seconds_per_word, 2).alias("end_sec"))


def chunk_at(points: DataFrame, clock: DataFrame, width: float = 120.0) -> DataFrame:
    """Each (job_key, at) with the chunk whose span holds it: a range join on buckets of ``width`` seconds."""
    spans = clock.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_sec") / width), F.floor(F.col("end_sec") / width))))
    p = points.withColumn("bucket", F.floor(F.col("at") / width))
    hit = p.join(spans, ["job_key", "bucket"]).where((F.col("at") >= F.col("start_sec")) & (F.col("at") < F.col("end_sec")))
    return hit.select("job_key", "at", "i")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with the latest ``value`` of right at or before its time; null before the first.

    One union and one window instead of a range join: a single shuffle by key.
    """
    both = left.withColumns({"__v": F.lit(None).cast(dict(right.dtypes)[value]), "__side": F.lit(1)}).unionByName(right.select(*keys, at, F.col(value).alias("__v")).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__v", "__side")


def first_source(rows: DataFrame, order: list[str], source: str = "source") -> DataFrame:
    """The rows of the first source in ``order`` that has any."""
    rank = F.coalesce(*[F.when(F.col(source) == s, F.lit(n)) for n, s in enumerate(order)])
    ranked = rows.withColumn("__r", rank).where("__r is not null")
    best = ranked.agg(F.min("__r").alias("__best"))
    return ranked.join(F.broadcast(best), F.col("__r") == F.col("__best")).drop("__r", "__best")


def first_seen(rows: DataFrame, keys: list[str], order: list[Column], enough: int | None = None, term: str = "term") -> DataFrame:
    """The first row of each key in the order; with ``enough`` no term is looked at once those before it gave that many."""
    first = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
    if enough is None:
        return first
    per = first.groupBy(term).agg(F.count("*").alias("__c"))
    before = per.select(term, F.coalesce(F.sum("__c").over(Window.orderBy(term).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return first.join(before, term).where(F.col("__before") < enough).drop("__before")


def remembered(kept: DataFrame, found: DataFrame, pinned: Column, keys: list[str]) -> DataFrame:
    """What a catalogue holds after a search: the rows found, and the pinned ones of before unless found again."""
    return kept.where(pinned).join(found.select(*keys), keys, "left_anti").unionByName(found, allowMissingColumns=True)


def find(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """wanted with the row of the same composite key; those not found are left out."""
    return wanted.join(rows, keys)


def source_chain(rows: DataFrame, order: list[str], passes: Column, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(chosen, reasons): rows that pass of the first source with any, and for the sources before it why not."""
    rank = F.coalesce(*[F.when(F.col(source) == s, F.lit(n)) for n, s in enumerate(order)])
    ranked = rows.withColumn("__r", rank).where("__r is not null").withColumn("__ok", F.coalesce(passes, F.lit(False)))
    spark = rows.sparkSession
    asked = spark.createDataFrame(list(enumerate(order)), "__r int, source string")
    seen = asked.join(ranked.groupBy("__r").agg(F.count("*").alias("found"), F.count_if("__ok").alias("kept")), "__r", "left").select("__r", "source", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("kept", F.lit(0)).alias("kept"))
    best = seen.where("kept > 0").agg(F.min("__r").alias("__best"))
    chosen = ranked.where("__ok").join(F.broadcast(best), F.col("__r") == F.col("__best")).drop("__r", "__best", "__ok")
    why = F.when(F.col("found") == 0, "no matches").otherwise(F.format_string("%d found, none steady enough", "found"))
    reasons = seen.join(F.broadcast(best), F.col("__best").isNull() | (F.col("__r") < F.col("__best"))).select("source", why.alias("reason"))
    return chosen, reasons


def conflict(running: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (job_key, total, discard) with ``action``: resume the same run, start anew, or refuse (409) because another run would be lost."""
    r = running.select(F.col("job_key").alias("__k"), F.col("total").alias("__total"), "slot")
    same = (F.col("__k") == F.col("job_key")) & (F.col("__total") == F.col("total"))
    action = F.when(F.col("__k").isNull() | F.col("discard"), "start").when(same, "resume").otherwise("refuse")
    return asked.join(r, "slot", "left").select("slot", "job_key", action.alias("action"))


def unit_hits(units: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """units (key, items) with ``hit``: whether the cache (key, v, items) has that content in this version with as many items."""
    c = cache.where(F.col("v") == version).select("key", F.col("items").alias("__n"))
    return units.join(c, "key", "left").select("key", "items", F.coalesce(F.col("__n") == F.col("items"), F.lit(False)).alias("hit"))


def unit_key(*parts: Column) -> Column:
    """The address of a unit by its content."""
    return F.sha1(F.to_json(F.struct(*[p.alias(f"p{n}") for n, p in enumerate(parts)])))


def titles(voices: DataFrame) -> DataFrame:
    """(voice_id, title, subtitle, initials)."""
    return voices.select("voice_id", T.voice_title("label", "name").alias("title"), T.voice_subtitle("label", "quality").alias("subtitle"), T.initials(F.coalesce("label", "name")).alias("initials"))
