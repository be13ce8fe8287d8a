"""Spoken openings and closings: recognising, removing and writing them; title and author of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T

# Shapes of spoken openings and closings.
INTRO_OPENER = r"(?i)^welcome to\s"
OUTRO_OPENER = r"(?i)^that\s+(brings\s+us\s+to\s+the\s+end\s+of|concludes)\s"
INTRO_CUE = r"(?i)^let us begin[.!]?\z"
SUMMARY_PREFIX = r"(?i)^this summary of\s+"
WRITTEN_BY = r"(?is)^welcome to\s+(.+?),\s*written by\s+(.+?)\s*[.!]\s*\z"
BY = r"(?is)^welcome to\s+(.+?)\s+by\s+(.+?)\s*[.!]"
TITLE_ONLY = r"(?is)^welcome to\s+(.+?)\s*[.!]"
# Lines that are never a title.
META_NOISE = r"(?i)^(contents|table of contents|copyright|all rights reserved|isbn|first published|published by|a note|dedication|epigraph|chapter|part|prologue|introduction|foreword|preface)\b"
BY_LINE = r"(?i)^\s*(by|written by)\s+(.{2,60}?)\s*\z"


def opening(title: Column, author: Column, summary: bool = False) -> Column:
    """The spoken opening of a book, or of its summary."""
    what = F.concat(F.lit("this summary of " if summary else ""), title)
    has = F.coalesce(author, F.lit("")) != ""
    return F.when(has, F.concat(F.lit("Welcome to "), what, F.lit(", written by "), author, F.lit("."))).otherwise(F.concat(F.lit("Welcome to "), what, F.lit(".")))


def closing(title: Column, author: Column, summary: bool = False) -> Column:
    """The spoken closing of a book, or of its summary."""
    what = F.concat(F.lit("this summary of " if summary else ""), title)
    has = F.coalesce(author, F.lit("")) != ""
    end = F.lit("That brings us to the end of ")
    return F.when(has, F.concat(end, what, F.lit(" by "), author, F.lit("."))).otherwise(F.concat(end, what, F.lit(".")))


def meta_of_opening(text: Column | str) -> Column:
    """struct<title, author> said in a spoken opening; null for texts without one."""
    first = T.trim(F.get(F.filter(F.split(T.col(text), "\n{2,}"), lambda p: T.trim(p) != ""), F.lit(0)))
    bare = lambda c: F.regexp_replace(T.trim(c), SUMMARY_PREFIX, "")
    pair = lambda p: F.struct(bare(F.regexp_extract(first, p, 1)).alias("title"), T.trim(F.regexp_extract(first, p, 2)).alias("author"))
    alone = F.struct(bare(F.regexp_extract(first, TITLE_ONLY, 1)).alias("title"), F.lit("").alias("author"))
    return F.when(first.rlike(INTRO_OPENER), F.when(first.rlike(WRITTEN_BY), pair(WRITTEN_BY)).when(first.rlike(BY), pair(BY)).when(first.rlike(TITLE_ONLY), alone))


def without_narration(text: Column | str, intro: int = 6, outro: int = 4) -> Column:
    """The text without a spoken closing among its last paragraphs and a spoken opening among its first."""
    ps = F.filter(F.transform(F.split(T.col(text), "\n{2,}"), T.trim), lambda p: p != "")

    def cut_end(a: Column) -> Column:
        at = F.filter(F.transform(a, lambda p, i: F.when((i >= F.size(a) - outro) & p.rlike(OUTRO_OPENER), i)), lambda i: i.isNotNull())
        return F.when(F.size(at) > 0, F.slice(a, F.lit(1), F.array_min(at))).otherwise(a)

    def cut_start(a: Column) -> Column:
        cue = F.filter(F.transform(a, lambda p, i: F.when((i > 0) & (i < intro) & p.rlike(INTRO_CUE), i)), lambda i: i.isNotNull())
        end = F.when(F.size(cue) > 0, F.array_min(cue)).otherwise(F.lit(0))
        return F.when((F.size(a) > 0) & F.get(a, F.lit(0)).rlike(INTRO_OPENER), F.slice(a, end + 2, F.greatest(F.size(a), F.lit(1)))).otherwise(a)

    # each cut is bound once, as the only element of an array, so that it is not computed anew per use
    once = F.transform(F.transform(F.array(ps), cut_end), cut_start)
    return F.array_join(F.get(once, F.lit(0)), "\n\n")


def book_meta(books: DataFrame, scan: int = 80) -> DataFrame:
    """(book_id, title, author): the first by-line and the first short line that reads like a title among the first lines, else the file's name."""
    rows = books.where("text is not null").select("book_id", "filename", F.posexplode(F.slice(F.split("text", "\n", -1), 1, scan)).alias("n", "line")).withColumn("line", T.trim("line"))
    rows = rows.withColumn("ok", (F.col("line") != "") & (F.length("line") <= 80) & ~F.col("line").rlike(META_NOISE)).withColumn("by", F.col("line").rlike(BY_LINE))
    title = F.min(F.when(F.col("ok") & ~F.col("by") & ~F.col("line").rlike(r"[.!?]\z") & F.col("line").rlike("[A-Za-z]"), F.struct("n", "line")))["line"]
    author = F.min(F.when(F.col("ok") & F.col("by"), F.struct("n", F.trim(F.regexp_extract("line", BY_LINE, 2)).alias("a"))))["a"]
    out = rows.groupBy("book_id").agg(title.alias("t"), author.alias("author"), F.max("filename").alias("f"))
    name = T.collapse(F.regexp_replace(T.stem_of_filename("f"), "[_-]+", " "))
    return out.select("book_id", F.coalesce("t", F.nullif(name, F.lit("")), F.lit("this book")).alias("title"), F.coalesce("author", F.lit("")).alias("author"))


# The line that opens the body, and how long the parts of a spoken frame may be, in words.
INTRO_CLOSER = "Let us begin."
FRAME_CAPS = {"about": 90, "invitation": 60, "reflection": 90, "farewell": 35}


def reserve(title: Column, author: Column) -> Column:
    """Words that the spoken opening and closing of a summary may take."""
    said = [opening(title, author, True), F.lit(INTRO_CLOSER), closing(title, author, True)]
    return (sum((T.count_words(x) for x in said[1:]), T.count_words(said[0])) + sum(FRAME_CAPS.values())).cast("bigint")
