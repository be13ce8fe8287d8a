"""The line model: structure read off the shape of a text's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T


def texts(books: DataFrame) -> DataFrame:
    """(book_id, text), each once, nulls left out.

    The exchange is named, so that texts stay spread over all partitions: they are small to move, but dear to
    work on, and an exchange sized by bytes alone would leave few tasks.
    """
    wide = int(books.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return books.select("book_id", "text").where("text is not null").repartition(wide, "book_id", "text").distinct()


def line_table(books: DataFrame) -> DataFrame:
    """(book_id, line_idx, line, kind) of every line of every text."""
    rows = texts(books).select("book_id", F.posexplode(T.lines("text")).alias("line_idx", "line"))
    return rows.withColumn("kind", T.line_kind("line"))


def measured_levels(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """(book_id, key, level): the least level measured for each heading, by its key."""
    seen = entries.where("kind = 'heading' and level between 1 and 3").select("book_id", "line_idx", "level").distinct()
    at = lines.join(seen, ["book_id", "line_idx"]).select("book_id", T.heading_key("line").alias("key"), "level")
    return at.where("key <> ''").groupBy("book_id", "key").agg(F.min("level").alias("level"))


def outline(books: DataFrame, entries: DataFrame) -> DataFrame:
    """(book_id, line_idx, kind, level, marker, ordered): headings and list items in the text as it stands.

    A line whose key was measured as a heading is one whatever its shape, unless it is a list item;
    headings without a measured level get level 2.
    """
    # blank lines go by their text: the kind would be worked out once more for the filter
    lines = line_table(books).where(T.trim("line") != "").withColumn("key", T.heading_key("line"))
    seen = entries.where("kind = 'heading' and level between 1 and 3").groupBy("book_id", "line_idx").agg(F.min("level").alias("seen"))
    # lines without a key are apart from one another, so that no book's rules and dots make one large group
    group = F.when(F.col("key") == "", F.concat(F.lit(" "), F.col("line_idx").cast("string"))).otherwise(F.col("key"))
    same = Window.partitionBy("book_id", group)
    hit = lines.join(seen, ["book_id", "line_idx"], "left").withColumn("level", F.when(F.col("key") != "", F.min("seen").over(same)))
    heading = (F.col("kind") == "heading") | ((F.col("kind") != "list") & F.col("level").isNotNull())
    marker = F.when(F.col("kind") == "list", T.list_marker("line"))
    return hit.where(heading | (F.col("kind") == "list")).select(
        "book_id", "line_idx", F.when(heading, "heading").otherwise("list").alias("kind"),
        F.when(heading, F.coalesce("level", F.lit(2))).alias("level"), marker.alias("marker"), F.when(marker.isNotNull(), T.is_ordered_marker(marker)).alias("ordered"),
    )


def prose_share(books: DataFrame) -> DataFrame:
    """(book_id, lines, prose_lines, is_prose): whether 0.4 of the lines with text read like prose."""
    rows = line_table(books).where(T.trim("line") != "")
    agg = rows.groupBy("book_id").agg(F.count("*").alias("lines"), F.count_if(T.is_prose_line("line")).alias("prose_lines"))
    return agg.withColumn("is_prose", F.col("prose_lines") >= 0.4 * F.col("lines"))


def running_heads(books: DataFrame, least: int = 3) -> DataFrame:
    """(book_id, key, repeats): short lines that come ``least`` times or more, by their key."""
    rows = line_table(books).where(T.trim("line") != "").where(F.length("line") <= 80).withColumn("key", T.heading_key("line"))
    return rows.where("key <> ''").groupBy("book_id", "key").agg(F.count("*").alias("repeats")).where(F.col("repeats") >= least)


def without_running_heads(books: DataFrame, least: int = 3) -> DataFrame:
    """(book_id, kept): lines with text that are no running head."""
    rows = line_table(books).where(T.trim("line") != "").withColumn("key", T.heading_key("line"))
    heads = running_heads(books, least).select("book_id", "key")
    return rows.join(heads, ["book_id", "key"], "left_anti").groupBy("book_id").agg(F.count("*").alias("kept"))


def drop_repeats(marks: DataFrame, least: int = 3) -> DataFrame:
    """Headings whose key comes once, or the last of two; of those that come ``least`` times none."""
    w = Window.partitionBy("book_id", "key")
    out = marks.withColumn("key", T.heading_key("title")).withColumn("n", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy("line_idx")))
    return out.where((F.col("n") < least) & (F.col("n") == F.col("nth"))).drop("n", "nth")


def upper_median(values: Column) -> Column:
    """The middle of the sorted values, the upper one of two; 0 of none."""
    v = F.array_sort(values)
    return F.when(F.size(v) > 0, F.element_at(v, F.floor(F.size(v) / 2).cast("int") + 1)).otherwise(F.lit(0))


def hard_wrapped(books: DataFrame) -> DataFrame:
    """(book_id, median_length, wrapped): 20 lines with text or more, their upper median under 110 characters.

    The median comes from a histogram of lengths, so no list of lines is gathered.
    """
    rows = line_table(books).where(T.trim("line") != "").select("book_id", F.length(T.trim("line")).alias("n"))
    hist = rows.groupBy("book_id", "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy("book_id")
    run = hist.withColumn("upto", F.sum("c").over(w.orderBy("n"))).withColumn("total", F.sum("c").over(w))
    mid = run.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("book_id").agg(F.min("n").alias("median_length"), F.max("total").alias("total"))
    return mid.select("book_id", "median_length", ((F.col("total") >= 20) & (F.col("median_length") < 110)).alias("wrapped"))


def reflowed(books: DataFrame) -> DataFrame:
    """(book_id, block, text): hard-wrapped lines joined to paragraphs.

    A line goes on in the next when it is nearly as long as the text's wrap width (the 90th percentile
    of lengths less 15, at least 50) and does not end on a colon; blank, heading and list lines part.
    """
    rows = line_table(books).withColumn("t", T.trim("line")).withColumn("n", F.length("t"))
    hist = rows.where("n > 0").groupBy("book_id", "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy("book_id")
    run = hist.withColumn("upto", F.sum("c").over(w.orderBy("n"))).withColumn("total", F.sum("c").over(w))
    p90 = run.where(F.col("upto") > F.floor(F.col("total") * 0.9)).groupBy("book_id").agg(F.min("n").alias("p90"))
    width = p90.select("book_id", F.greatest(F.lit(50), F.col("p90") - 15).alias("wrap_at"))
    rows = rows.join(width, "book_id")
    order = w.orderBy("line_idx")
    before = lambda c: F.lag(c).over(order)
    flows = (before("kind") == "paragraph") & (F.col("kind") == "paragraph") & (before("n") >= F.col("wrap_at")) & ~before("t").endswith(":")
    marked = rows.withColumn("new", F.when(F.coalesce(flows, F.lit(False)), 0).otherwise(1)).withColumn("block", F.sum("new").over(order))
    return marked.where("n > 0").groupBy("book_id", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_idx", "t"))), lambda x: x["t"]), " ").alias("text"))


def blocks(books: DataFrame) -> DataFrame:
    """(book_id, block, kind, ordered, first_line, lines, words, word_start): islands of headings, list runs and paragraphs.

    Consecutive list items are one block while bullets and numbers don't change; every heading and
    paragraph line is a block; ``word_start`` counts the words before it.
    """
    rows = line_table(books).withColumn("words", T.count_words("line")).withColumn("ordered", F.when(F.col("kind") == "list", T.is_ordered_marker(T.list_marker("line"))))
    w = Window.partitionBy("book_id").orderBy("line_idx")
    same = (F.col("kind") == "list") & (F.lag("kind").over(w) == "list") & (F.lag("ordered").over(w) == F.col("ordered"))
    rows = rows.withColumn("block", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w)).where("kind <> 'blank'")
    made = rows.groupBy("book_id", "block", "kind", "ordered").agg(F.min("line_idx").alias("first_line"), F.count("*").alias("lines"), F.sum("words").alias("words"))
    start = F.coalesce(F.sum("words").over(Window.partitionBy("book_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return made.withColumn("word_start", start)
