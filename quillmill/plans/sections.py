"""Sections between headings, cuts of long sections, answers put back into reading order, trimming to budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import lines as L
from quillmill.operators import sentences as S


def sections(books: DataFrame, marks: DataFrame, small: int = 150, front: float = 0.1, back: float = 0.8, least: float = 0.4) -> DataFrame:
    """(book_id, section, title, first_line, words): the texts between heading marks (book_id, line_idx, title).

    Marks that are no real heading or repeat are left out. Sections headed like front or back matter go,
    list-shaped ones in the first tenth too, and everything from the first such one past four fifths.
    """
    m = marks.select("book_id", "line_idx", T.clean_title("title").alias("title")).where(T.is_real_heading("title")).distinct()
    m = L.drop_repeats(m).select("book_id", F.col("line_idx").alias("mark"), "title")
    lines = L.line_table(books).join(m.select("book_id", F.col("mark").alias("line_idx"), F.lit(True).alias("is_mark")), ["book_id", "line_idx"], "left")
    w = Window.partitionBy("book_id").orderBy("line_idx")
    lines = lines.withColumn("section", F.count("is_mark").over(w)).withColumn("mark", F.last(F.when(F.col("is_mark"), F.col("line_idx")), True).over(w))
    body = (F.col("kind") != "blank") & F.col("is_mark").isNull()
    agg = lines.groupBy("book_id", "section", "mark").agg(F.coalesce(F.sum(F.when(body, T.count_words("line"))), F.lit(0)).alias("words"), F.count_if(body).alias("n"), F.count_if(body & T.is_prose_line("line")).alias("prose"), F.min("line_idx").alias("first_line"))
    agg = agg.join(m, ["book_id", "mark"], "left")
    whole = Window.partitionBy("book_id")
    order = whole.orderBy("section")
    total = F.greatest(F.sum("words").over(whole), F.lit(1))
    agg = agg.withColumn("start", (F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")) / total)
    named = F.coalesce(T.is_not_the_book("title"), F.lit(False))
    listed = (F.col("words") >= small) & (F.col("prose") < least * F.col("n"))
    agg = agg.withColumns({"named": named, "listed": listed}).withColumn("stop", F.max(((F.col("start") >= back) & (F.col("named") | F.col("listed"))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    keep = (F.col("stop") == 0) & ~F.col("named") & ~(F.col("listed") & (F.col("start") < front)) & (F.col("title").isNotNull() | (F.col("words") > 0))
    return agg.where(keep).select("book_id", "section", "title", "first_line", "words")


def split_lines(lines: DataFrame, key: str, order: str, words: str, count: int) -> DataFrame:
    """lines with ``piece``: a new piece starts behind the line that reaches the next equal share of the words."""
    w = Window.partitionBy(key)
    total = F.sum(words).over(w)
    run = F.sum(words).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    passed = F.floor(F.coalesce(run, F.lit(0)) * count / F.greatest(total, F.lit(1)))
    return lines.withColumn("piece", F.least(F.lit(count - 1), passed).cast("int"))


def trim_to_budget(df: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """(key, trimmed, words): whole sentences from the start while they fit the budget of words; one at least."""
    s = S.split_sentences(df, key, text)
    w = Window.partitionBy(key).orderBy("para_idx", "sent_idx")
    s = s.withColumn("upto", F.sum("words").over(w)).withColumn("nth", F.row_number().over(w))
    kept = s.where((F.col("upto") <= budget) | (F.col("nth") == 1))
    paras = kept.groupBy(key, "para_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_idx", "sentence"))), lambda x: x["sentence"]), " ").alias("p"), F.sum("words").alias("w"))
    return paras.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_idx", "p"))), lambda x: x["p"]), "\n\n").alias("trimmed"), F.sum("w").alias("words"))


def merge_wrapped(text: Column | str) -> Column:
    """Blocks joined to the one before when that is an unfinished single line and the next goes on in small letters."""
    blocks = F.filter(F.transform(F.split(T.col(text), "\n{2,}"), T.trim), lambda b: b != "")

    def step(a: Column, b: Column) -> Column:
        p = F.get(a, F.size(a) - 1)
        shape = ~p.contains("\n") & ~b.contains("\n") & ~p.rlike(T.LIST_MARKER) & ~b.rlike(T.LIST_MARKER)
        joinable = shape & ~T.is_heading_like(p) & ~p.rlike("[.!?:;\"')\\]]\\z") & b.rlike("^[a-z(“‘\"']")
        joined = F.when(p.rlike(r"[a-z]-\z"), F.concat(F.substring(p, F.lit(1), F.length(p) - 1), b)).otherwise(F.concat(p, F.lit(" "), b))
        return F.when((F.size(a) > 0) & joinable, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(joined))).otherwise(F.concat(a, F.array(b)))

    return F.array_join(F.aggregate(blocks, F.array().cast("array<string>"), step), "\n\n")


def outer_json(c: Column | str) -> Column:
    """What stands between the outermost braces of an answer, else all of it; empty gives null."""
    t = T.trim(c)
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.nullif(F.when(inner != "", inner).otherwise(t), F.lit(""))


def answers_in_order(asked: DataFrame, answers: DataFrame, key: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(answered, missing): asked items with the latest answer whose id, reduced to digits, is theirs."""
    a = answers.withColumn("__id", F.expr("try_cast(regexp_replace(id, '[^0-9]', '') as bigint)"))
    last = a.withColumn("__rn", F.row_number().over(Window.partitionBy("__id").orderBy(F.col(at).desc()))).where("__rn = 1").select("__id", "answer")
    joined = asked.join(last, asked[key].cast("bigint") == F.col("__id"), "left").drop("__id")
    return joined.where("answer is not null"), joined.where("answer is null").drop("answer")


def level_map(pairs: DataFrame, doc: str, most: int = 5000) -> DataFrame:
    """(doc, key, level): the last of levels 1 to 3 given to each heading key of a document, of its first ``most`` entries (doc, line, level, ord)."""
    p = pairs.where((F.col("ord") < most) & F.col("level").between(1, 3)).select(doc, T.heading_key("line").alias("key"), "level", "ord").where("key <> ''")
    return p.groupBy(doc, "key").agg(F.max_by("level", "ord").alias("level"))
