"""Page layout: positioned tokens to lines, page measures, margins, drop caps, paragraphs.

Tokens are rows (book_id, page, ord, str, x, y, w, h); every step is a window or a group over a page, so
work is split by page and no page meets another but for running heads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.functions.maths import level_from_ratio

PAGE = ["book_id", "page"]
# Tolerances of the layout, in points or in parts of the letter size.
BASELINE, SPACE, MARGIN_GAP, PARA_GAP, INDENT = 3.0, 0.25, 1.8, 1.35, 0.5
LETTERS, LEAST_JUMP, HEADING, HEAD_CHARS = 0.6, 0.2, 1.15, 80


def lines(tokens: DataFrame) -> DataFrame:
    """(book_id, page, line, text, x0, x1, y, size): tokens on one baseline, blanks put in where a gap shows.

    A gap shows from a quarter of the letter size on. In a line of single letters, set with space between them, it
    shows beyond the widest jump between its gaps; where there is no jump, such a line holds no gap at all.
    """
    down = Window.partitionBy(*PAGE).orderBy(F.col("y").desc(), "x", "ord")
    t = tokens.where(F.col("str") != "").withColumn("new", F.coalesce((F.lag("y").over(down) - F.col("y") > BASELINE).cast("int"), F.lit(1)))
    t = t.withColumn("line", F.sum("new").over(down) - 1)
    size = F.max(F.struct(F.length("str").alias("n"), F.col("h").alias("h")))["h"]
    g = t.groupBy(*PAGE, "line").agg(F.sort_array(F.collect_list(F.struct("x", "ord", "str", "w"))).alias("t"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max("y").alias("y"), size.alias("size"))
    n = F.size("t")
    rest = F.slice(F.col("t"), F.lit(2), F.greatest(n - 1, F.lit(0)))
    gaps = F.zip_with(rest, F.slice(F.col("t"), F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: b["x"] - (a["x"] + a["w"]))
    g = g.withColumns({"gaps": gaps, "usual": SPACE * F.col("size")}).withColumn("sorted", F.array_sort("gaps"))
    single = F.size(F.filter("t", lambda x: F.trim(x["str"]).rlike(r"^[A-Za-z]\z")))
    jumps = F.zip_with(F.slice(F.col("sorted"), F.lit(2), F.greatest(n - 2, F.lit(0))), F.slice(F.col("sorted"), F.lit(1), F.greatest(n - 2, F.lit(0))), lambda b, a: F.struct((b - a).alias("jump"), (-a).alias("first"), ((a + b) / 2).alias("middle")))
    best = F.array_max(jumps)
    tracked = F.when(best["jump"] >= LEAST_JUMP * F.col("size"), best["middle"]).when(F.get("sorted", F.lit(0)) > F.col("usual"), F.element_at("sorted", -1) + 1).otherwise(F.col("usual"))
    g = g.withColumn("from", F.when((n >= 4) & (single >= LETTERS * n), tracked).otherwise(F.col("usual")))
    joint = lambda x, i: F.when((i > 0) & (F.get("gaps", i - 1) > F.col("from")) & ~F.get("t", i - 1)["str"].endswith(" ") & ~x["str"].startswith(" "), " ").otherwise("")
    text = F.array_join(F.transform("t", lambda x, i: F.concat(joint(x, i), x["str"])), "")
    return g.select(*PAGE, "line", text.alias("text"), "x0", "x1", "y", "size")


def modal_size(rows: DataFrame, keys: list[str], value: str, weight: str, order: str) -> DataFrame:
    """(keys, value): the value with the most weight, in steps of a half; of two the one that appears first."""
    step = rows.groupBy(*keys, (F.floor(F.col(value) * 2 + 0.5) / 2).alias("value")).agg(F.sum(weight).alias("__w"), F.min(order).alias("__first"))
    return step.groupBy(*keys).agg(F.max_by("value", F.struct("__w", -F.col("__first"))).alias("value"))


def page_measures(lines_: DataFrame) -> DataFrame:
    """(book_id, page, body, left, right, leading): the body's letter size by weight of text, its edges, the usual distance of lines."""
    body = modal_size(lines_.withColumn("__n", F.length("text")), PAGE, "size", "__n", "line").withColumnRenamed("value", "body")
    w = Window.partitionBy(*PAGE).orderBy(F.col("y").desc())
    l = lines_.join(body, PAGE).withColumn("gap", F.lag("y").over(w) - F.col("y"))
    near = (F.col("gap") > 0) & (F.col("gap") < 3 * F.col("body"))
    gaps = F.array_sort(F.collect_list(F.when(near, F.col("gap"))))
    is_body = F.abs(F.col("size") - F.col("body")) <= 0.5
    agg = l.groupBy(*PAGE, "body").agg(F.min(F.when(is_body, F.col("x0"))).alias("left"), F.max(F.when(is_body, F.col("x1"))).alias("right"), gaps.alias("g"))
    return agg.select(*PAGE, "body", "left", "right", F.when(F.size("g") > 0, F.element_at("g", F.floor(F.size("g") / 2).cast("int") + 1)).otherwise(1.2 * F.col("body")).alias("leading"))


def without_margins(lines_: DataFrame, measures: DataFrame) -> DataFrame:
    """Lines without page numbers that stand apart at the top or bottom of pages of four lines or more.

    A line that is a page number goes; from another short one in letters of the body's size its number is cut off.
    """
    w = Window.partitionBy(*PAGE).orderBy(F.col("y").desc())
    l = lines_.join(measures.select(*PAGE, "leading", "body"), PAGE).withColumns({"up": F.lag("y").over(w) - F.col("y"), "down": F.col("y") - F.lead("y").over(w), "n": F.count("*").over(Window.partitionBy(*PAGE))})
    far = MARGIN_GAP * F.col("leading")
    edge = (F.col("n") >= 4) & ((F.col("up").isNull() & (F.col("down") >= far)) | (F.col("down").isNull() & (F.col("up") >= far)))
    edge = F.coalesce(edge & (F.length("text") <= HEAD_CHARS) & (F.col("size") <= HEADING * F.col("body")), F.lit(False))
    bare = T.trim(F.regexp_replace("text", r"^\d{1,4}\s+|\s+\d{1,4}\z", ""))
    kept = l.where(~(edge & T.is_folio("text")))
    return kept.withColumn("text", F.when(edge & (F.length(bare) >= 3), bare).otherwise(F.col("text"))).drop("up", "down", "n", "leading", "body")


def without_repeated_edges(lines_: DataFrame, share: float = 0.3, least: int = 3) -> DataFrame:
    """Lines but for first and last lines of pages that come on ``least`` pages and ``share`` of all."""
    w = Window.partitionBy(*PAGE).orderBy(F.col("y").desc())
    l = lines_.withColumns({"top": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(*PAGE)), "key": T.heading_key("text")})
    edge = (F.col("top") == 1) | (F.col("top") == F.col("n"))
    pages = lines_.select(*PAGE).distinct().groupBy("book_id").agg(F.count("*").alias("pages"))
    often = l.where(edge & (F.col("key") != "")).groupBy("book_id", "key").agg(F.countDistinct("page").alias("c")).join(pages, "book_id").where(F.col("c") >= F.greatest(F.lit(least), F.col("pages") * share))
    mark = often.select("book_id", "key", F.lit(True).alias("head"))
    return l.join(mark, ["book_id", "key"], "left").where(~(edge & F.coalesce("head", F.lit(False)))).drop("top", "n", "key", "head")


def drop_caps(lines_: DataFrame, measures: DataFrame) -> DataFrame:
    """(book_id, page, cap, line): each large single letter with the topmost line beside it; a line takes one cap, the first."""
    l = lines_.join(measures.select(*PAGE, "body"), PAGE)
    caps = l.where(T.trim("text").rlike(r"^[A-Z]\z") & (F.col("size") >= 1.6 * F.col("body"))).select(*PAGE, F.col("line").alias("cap"), F.col("x1").alias("cx"), F.col("y").alias("cy"), F.col("size").alias("cs"))
    beside = caps.join(l.where(F.col("size") < 1.6 * F.col("body")), PAGE).where((F.col("x0") >= F.col("cx") - 1) & (F.col("y") <= F.col("cy") + F.col("cs")) & (F.col("y") >= F.col("cy") - 1))
    top = beside.groupBy(*PAGE, "cap").agg(F.max_by("line", "y").alias("line"))
    return top.groupBy(*PAGE, "line").agg(F.min("cap").alias("cap"))


def paragraphs(lines_: DataFrame, measures: DataFrame) -> DataFrame:
    """(book_id, page, para, text): lines joined until an indent, a wide gap or a short line parts them; a dash at a line's end goes."""
    w = Window.partitionBy(*PAGE).orderBy(F.col("y").desc())
    l = lines_.join(measures, PAGE)
    indent = F.col("x0") - F.col("left") > INDENT * F.col("body")
    wide = F.lag("y").over(w) - F.col("y") > PARA_GAP * F.col("leading")
    short = F.lag("x1").over(w) < F.col("right") - 3 * F.col("body")
    new = F.coalesce((indent | wide | short).cast("int"), F.lit(1))
    l = l.withColumn("para", F.sum(new).over(w) - 1)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("line", F.trim("text").alias("t")))), lambda x: x["t"])
    joined = F.regexp_replace(F.array_join(parts, "\n"), r"(?<=[a-z])-\n(?=[a-z])", "")
    return l.groupBy(*PAGE, "para").agg(F.replace(joined, F.lit("\n"), F.lit(" ")).alias("text"))


def with_caps(lines_: DataFrame, measures: DataFrame) -> DataFrame:
    """Lines with each large first letter put in front of the line it stands beside."""
    caps = drop_caps(lines_, measures)
    letters = lines_.select(*PAGE, F.col("line").alias("cap"), T.trim("text").alias("letter"))
    held = caps.join(letters, [*PAGE, "cap"])
    rest = lines_.join(caps.select(*PAGE, F.col("cap").alias("line")), [*PAGE, "line"], "left_anti")
    out = rest.join(held.select(*PAGE, "line", "letter"), [*PAGE, "line"], "left")
    return out.withColumn("text", F.concat(F.coalesce("letter", F.lit("")), "text")).drop("letter")


def page_blocks(lines_: DataFrame, measures: DataFrame) -> DataFrame:
    """(book_id, page, block, kind, level, text): headings by letter size, list items by their mark, paragraphs by indent, gap and short line.

    Lines of one heading and level are one block, a list item takes the lines behind it that start further in; dashes at
    line ends go where a small letter follows; a large first letter joins its line.
    """
    w = Window.partitionBy(*PAGE).orderBy(F.col("y").desc())
    l = with_caps(lines_, measures).join(measures, PAGE)
    ratio = F.col("size") / F.col("body")
    kind = F.when((ratio >= HEADING) & T.text_has_letters("text"), "heading").when(T.list_marker("text").isNotNull(), "list").otherwise("paragraph")
    l = l.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", level_from_ratio(ratio)))
    before = lambda c: F.lag(c).over(w)
    wide = before("y") - F.col("y") > PARA_GAP * F.col("leading")
    indent = F.col("x0") - F.col("left") > INDENT * F.col("body")
    short = before("x1") < F.col("right") - 3 * F.col("body")
    l = l.withColumns({"was": before("kind"), "same": (before("level") == F.col("level")) & ~wide, "parts": indent | wide | short, "goes_on": (before("kind") == "list") & (F.col("x0") > before("x0")) & ~wide})
    joins = F.when(F.col("kind") == "heading", (F.col("was") == "heading") & F.col("same")).when(F.col("kind") == "list", F.lit(False)).otherwise(F.when(F.col("was") == "list", F.col("goes_on")).otherwise((F.col("was") == "paragraph") & ~F.col("parts")))
    l = l.withColumn("block", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w) - 1)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("line", F.trim("text").alias("t")))), lambda x: x["t"])
    joined = F.replace(F.regexp_replace(F.array_join(parts, "\n"), r"(?<=[a-z])-\n(?=[a-z])", ""), F.lit("\n"), F.lit(" "))
    first = lambda c: F.min_by(c, "line")
    return l.groupBy(*PAGE, "block").agg(first("kind").alias("kind"), first("level").alias("level"), joined.alias("text"))
