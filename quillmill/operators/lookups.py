"""Where in a book: the word, the chunk, the chapter and the block at a time or a share of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total_weight(words: Column) -> Column:
    """A word weighs its length and one more."""
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w) + 1)


def words_before(words: Column, target: Column) -> Column:
    """How many words end before ``target`` of the running weight."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
    step = lambda a, w: F.struct((a["sum"] + F.length(w) + 1).alias("sum"), (a["n"] + (a["sum"] + F.length(w) + 1 < target).cast("int")).alias("n"))
    return F.aggregate(words, zero, step, lambda a: a["n"])


def word_at(points: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """points (key, at) with ``word``: the word spoken then.

    segments: (key, s, e, a, words). In a gap the segment before counts, and its last word; before the first there
    is none (-1). Inside, time is shared out by the words' weights. One union and one window by key find the segment;
    a point on the border of two belongs to the first of them.
    """
    seg = segments.select(key, F.col("s").alias("__t"), F.struct("s", "e", "a", "words").alias("__seg"))
    p = points.select(key, F.col("at").alias("__t"), F.col("at"))
    both = seg.withColumn("at", F.lit(None).cast("double")).unionByName(p.withColumn("__seg", F.lit(None).cast(dict(seg.dtypes)["__seg"])))
    # at the same time points come before segments that start there, unless no segment before reaches it
    w = Window.partitionBy(key).orderBy("__t", F.col("at").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(key).orderBy("__t", F.col("at").isNull()).rowsBetween(1, Window.unboundedFollowing)
    found = both.withColumn("__before", F.last("__seg", ignorenulls=True).over(w)).withColumn("__next", F.first("__seg", ignorenulls=True).over(ahead)).where("at is not null")
    inside = F.col("__before").isNotNull() & (F.col("at") <= F.col("__before.e"))
    starts = (F.col("__next.s") == F.col("at")) & ~F.coalesce(inside, F.lit(False))
    found = found.withColumn("__s", F.when(starts, F.col("__next")).otherwise(F.col("__before")))
    span = F.col("__s.e") - F.col("__s.s")
    target = (F.col("at") - F.col("__s.s")) / span * total_weight(F.col("__s.words"))
    last = F.col("__s.a") + F.size("__s.words") - 1
    place = words_before(F.col("__s.words"), target)
    word = F.when(F.col("__s").isNull(), -1).when((span <= 0) | (F.col("at") >= F.col("__s.e")), last).otherwise(F.least(last, F.col("__s.a") + place))
    return found.select(key, "at", word.cast("int").alias("word"))


def chapter_at(points: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """points (key, at) with ``chapter``: the last of marks (key, start, chapter) that starts at or before it, else the first."""
    both = marks.select(key, F.col("start").alias("at"), F.lit(0).alias("__side"), "chapter").unionByName(points.select(key, "at", F.lit(1).alias("__side"), F.lit(None).cast(dict(marks.dtypes)["chapter"]).alias("chapter")))
    w = Window.partitionBy(key)
    run = w.orderBy("at", "__side", "chapter").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({"__c": F.last("chapter", ignorenulls=True).over(run), "__first": F.min("chapter").over(w)}).where("__side = 1")
    return out.select(key, "at", F.coalesce("__c", "__first").alias("chapter"))


def seek(points: DataFrame, clock: DataFrame, width: float = 3600.0) -> DataFrame:
    """points (job_key, at) with the first chunk of clock (job_key, i, start_sec, end_sec) that ends after it, and the seconds into it.

    Before the start it is the first chunk, from the end on the last one. Windows run from the latest time back, so
    that all that ends after a point is a growing frame and each row is added once. The open feed is one job: stretches
    of ``width`` seconds come first, then one row of each stretch with the points, and no task sees a whole feed.
    """
    at = F.greatest(F.lit(0.0), F.col("at"))
    both = clock.select("job_key", F.col("end_sec").alias("__t"), F.lit(2).alias("__side"), F.struct("i", "start_sec").alias("__c"), F.lit(None).cast("double").alias("at"))
    both = both.unionByName(points.select("job_key", at.alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(dict(both.dtypes)["__c"]).alias("__c"), F.col("at").cast("double").alias("at")))
    stretch = Window.partitionBy("job_key", "__b")
    back = stretch.orderBy(F.desc("__t"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.withColumn("__b", F.rint(F.col("__t") / width)).withColumns({"__n": F.min("__c").over(back), "__k": F.count("__c").over(back), "__min": F.min("__c").over(stretch), "__max": F.max("__c").over(stretch)})
    few = ends.where("__side = 1 or __k = 1").withColumn("__min", F.when(F.col("__side") == 2, F.col("__min")))
    job = Window.partitionBy("job_key")
    # a stretch's points come before its own row, so only later stretches are in their frame
    later = job.orderBy(F.desc("__b"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = few.withColumns({"__later": F.min("__min").over(later), "__last": F.max("__max").over(job)}).where("__side = 1")
    hit = F.coalesce(F.least("__n", "__later"), "__last")
    return out.select("job_key", "at", hit["i"].alias("i"), F.round(F.greatest(F.lit(0.0), F.col("at")) - hit["start_sec"], 2).alias("into"))


def block_at(points: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """points (key, word) with the block of blocks (key, block, word_start, words) that holds the word; null past the end."""
    spans = blocks.where("words > 0").select(key, F.col("word_start").alias("word"), F.struct(F.col("word_start").alias("s"), (F.col("word_start") + F.col("words")).alias("e"), "block").alias("__b"), F.lit(0).alias("__side"))
    both = spans.unionByName(points.select(key, F.col("word").cast("long").alias("word"), F.lit(None).cast(dict(spans.dtypes)["__b"]).alias("__b"), F.lit(1).alias("__side")))
    w = Window.partitionBy(key).orderBy("word", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__h", F.last("__b", ignorenulls=True).over(w)).where("__side = 1")
    return out.select(key, "word", F.when(F.col("word") < F.col("__h.e"), F.col("__h.block")).alias("block"))


def display_words(segments: DataFrame, shown: DataFrame, key: str, look: int = 60) -> DataFrame:
    """(key, n, a, b): the shown words that each segment (key, n, text) covers, found forward within ``look`` words.

    shown: (key, words). A segment of which no word is found stands where the one before ended; segments without
    a letter or digit are left out. Positions depend on one another, so a text's segments are folded in one
    Arrow-batched group, whose size is one text's.
    """
    from quillmill.operators.timeline import match_segments

    kinds = dict(segments.dtypes)
    schema = f"{key} {kinds[key]}, n {kinds['n']}, a int, b int"
    gathered = segments.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("seg")).join(shown.select(key, "words"), key)

    def run(it):
        import pandas as pd

        for pdf in it:
            rows = [(k, n, a, b) for k, seg, words in zip(pdf[key], pdf["seg"], pdf["words"]) for n, a, b in match_segments([(s["n"], s["text"]) for s in seg], list(words), look)]
            yield pd.DataFrame(rows, columns=[key, "n", "a", "b"])

    return gathered.mapInPandas(run, schema)
