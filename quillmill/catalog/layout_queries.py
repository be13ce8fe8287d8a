"""Layout and timelines over tokens and sounds made from the tables by rule, and relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.catalog import sqltext as Q
from quillmill.functions import text as T
from quillmill.operators import layout as Y
from quillmill.operators import lines as L
from quillmill.operators import timeline as TL
from quillmill.queries import register
from quillmill.session import cut, table


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every line as a positioned token: 40 lines a page, 6 points a character, 12 a line; each text is a book."""
    b = table(spark, sf_dir, "books").where("text is not null").select(F.concat_ws(":", "book_id", F.substring(F.md5("text"), 1, 8)).alias("book_id"), "text")
    rows = L.line_table(b).where(T.trim("line") != "").select("book_id", "line_idx", F.posexplode(T.words("line")).alias("ord", "str"))
    start = F.coalesce(F.sum(F.length("str") + 1).over(Window.partitionBy("book_id", "line_idx").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    y = 600.0 - (F.col("line_idx") % 40) * 12
    return rows.select("book_id", F.floor(F.col("line_idx") / 40).cast("int").alias("page"), "ord", "str", (start * 6.0).alias("x"), y.alias("y"), (F.length("str") * 6.0).alias("w"), F.lit(10.0).alias("h"))


@register("layout_lines", f"""WITH b AS (SELECT DISTINCT book_id || ':' || left(md5(text), 8) AS book_id, text FROM books WHERE text IS NOT NULL){Q.LINES[len(Q.BOOKS):]}, w AS (SELECT book_id, line_idx, {Q.words('line')} AS ws FROM l), n AS (SELECT * FROM w WHERE len(ws) > 0)
SELECT book_id, CAST(line_idx // 40 AS INTEGER) AS page, row_number() OVER (PARTITION BY book_id, line_idx // 40 ORDER BY line_idx) - 1 AS line, CASE WHEN len(ws) >= 4 AND len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Za-z]$'))) >= 0.6 * len(ws) THEN array_to_string(ws, '') ELSE array_to_string(ws, ' ') END AS text, 0.0::DOUBLE AS x0, length(array_to_string(ws, ' ')) * 6.0::DOUBLE AS x1,
600.0::DOUBLE - (line_idx % 40) * 12 AS y, 10.0::DOUBLE AS size FROM n""")  # fmt: skip
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.lines(tokens(spark, sf_dir))


@register("layout_paragraphs")
def layout_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = cut(Y.lines(tokens(spark, sf_dir)))  # read several times
    m = cut(Y.page_measures(lines))
    return Y.paragraphs(Y.with_caps(Y.without_repeated_edges(Y.without_margins(lines, m)), m), m)


@register("layout_blocks")
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages on which the lines in capitals are set in large letters."""
    capitals = F.col("str") == F.upper("str")
    t = tokens(spark, sf_dir).withColumn("h", F.when(capitals & F.col("str").rlike("[A-Z]{2}"), 14.0).otherwise(F.col("h")))
    l = cut(Y.lines(t))
    return Y.page_blocks(l, cut(Y.page_measures(l)))


@register("chunk_segments")
def chunk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivered chunk's segments, with pauses placed by rule at every full stop of its text."""
    c = table(spark, sf_dir, "chunks").where("pieces is not null").select("job_key", "i", F.array_join("pieces", " ").alias("text")).where("text <> ''").distinct()
    seconds = T.count_words("text") * 0.38
    stops = F.filter(F.transform(T.words("text"), lambda w, n: F.when(w.rlike(r"[.!?]\z"), (n + 1) * 0.38)), lambda x: x.isNotNull())
    c = c.withColumns({"seconds": seconds, "pauses": F.transform(stops, lambda t: F.struct((t - 0.2).alias("start"), (t + 0.2).alias("end")))})
    s = TL.with_segments(c).select("job_key", "i", F.posexplode("segments").alias("n", "s"))
    return s.select("job_key", "i", "n", "s.s", "s.e", "s.a", "s.b")


@register("job_clock", """WITH d AS (SELECT job_key, i, max(coalesce(words, 0)) AS w, bool_or(ends_chapter) AS e FROM chunks GROUP BY ALL),
g AS (SELECT *, CAST(w * 0.4 AS DECIMAL(28,6)) AS speech, CAST(CASE WHEN e THEN 2.0 ELSE 0.08 END AS DECIMAL(28,6)) AS gap FROM d)
SELECT job_key, i, round(CAST(coalesce(sum(speech + gap) OVER (PARTITION BY job_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE), 2) AS start_sec FROM g""")  # fmt: skip
def job_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running clock of all jobs, the open feed too: speech at a fixed pace, longer gaps behind chapters."""
    c = table(spark, sf_dir, "chunks").groupBy("job_key", "i").agg(F.max(F.coalesce("words", F.lit(0))).alias("w"), F.bool_or("ends_chapter").alias("e"))
    c = c.select("job_key", "i", (F.col("w") * 0.4).alias("speech_sec"), F.when(F.col("e"), 2.0).otherwise(0.08).alias("gap_sec"))
    return TL.running_clock(c, "job_key", "i").select("job_key", "i", "start_sec")


@register("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS cents, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")  # fmt: skip
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    cents = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.sum(cents).alias("cents"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@register("nation_revenue", """SELECT n_name, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey
GROUP BY n_name""")  # fmt: skip
def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are summed per key before they meet customers, so the large side is shuffled once."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint")).alias("r"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    by_customer = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("r").alias("r"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return by_customer.join(c, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.sum("r").alias("cents"))


@register("orders_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def orders_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


@register("top_parts", "SELECT p_brand, p_partkey, place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 3")
def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(w).cast("bigint").alias("place")).where("place <= 3")


@register("quiet_customers", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderpriority = '1-URGENT')")
def quiet_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order of the last years."""
    urgent = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_orderpriority") == "1-URGENT"))
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("shared_nations", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def shared_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@register("latest_deliveries", "SELECT job_key, i, count(DISTINCT received_at) AS times FROM chunks GROUP BY ALL HAVING count(DISTINCT received_at) > 1")
def latest_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that came more than once."""
    return table(spark, sf_dir, "chunks").groupBy("job_key", "i").agg(F.countDistinct("received_at").alias("times")).where("times > 1")


