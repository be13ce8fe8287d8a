"""Jobs, requests and providers: life cycles, framing, windows, carried text, resume and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.catalog.grounding_queries import CHUNK_TEXT
from quillmill.operators import catalogue as C
from quillmill.operators import writers as W
from quillmill.queries import register
from quillmill.session import table
from quillmill.streaming import jobs as J
from quillmill.streaming import progress as P

COMMANDS = ["start", "progress", "merge", "end", "cancel", "fail"]
ORDER = "cm AS (SELECT user_id, ['start', 'progress', 'merge', 'end', 'cancel', 'fail'][event_id % 6 + 1] AS command, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
MOVE = " ".join(f"WHEN r.state = '{s}' AND cm.command = '{c}' THEN '{t}'" for (s, c), t in J.MOVES.items())


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "ts", F.col("event_id").alias("ord"), F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("event_id") % 6 + 1).cast("int")).alias("command"))


@register("job_lifecycle", f"WITH RECURSIVE {ORDER}, r AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 'idle' AS state FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT cm.user_id, cm.n, CASE {MOVE} ELSE r.state END FROM r JOIN cm ON cm.user_id = r.user_id AND cm.n = r.n + 1) SELECT user_id, arg_max(state, n) AS state, max(n) AS commands FROM r GROUP BY user_id")
def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs and their events as commands."""
    return J.lifecycle(commands(spark, sf_dir), "user_id")


@register("heartbeats", "WITH e AS (SELECT DISTINCT user_id, ts FROM events), g AS (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM e), p AS (SELECT user_id, ts, (gap - 1) // 15000000 AS pings FROM g WHERE gap > 0) SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, pings FROM p WHERE pings > 0")
def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return J.heartbeats(e, "user_id").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "pings")


LINES = """ln AS (SELECT user_id, '{"type":"' || CASE WHEN event_id % 11 = 0 THEN 'done' ELSE event_type END || '","id":' || event_id || '}' AS line, event_id % 11 = 0 OR event_type IN ('done', 'error') AS last, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)"""


@register("framed_lines", f"WITH {LINES}, st AS (SELECT user_id, min(n) AS stop FROM ln WHERE last GROUP BY user_id) SELECT ln.user_id, CAST(n AS INTEGER) AS n, line FROM ln LEFT JOIN st USING (user_id) WHERE stop IS NULL OR n <= stop")
def framed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines of each user, sent in reads of 37 characters."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.to_json(F.struct(F.when(F.col("event_id") % 11 == 0, "done").otherwise(F.col("event_type")).alias("type"), F.col("event_id").alias("id"))).alias("line"))
    whole = e.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("t"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 37).cast("int")), lambda k: F.substring("t", k * 37 + 1, F.lit(37)))
    return J.framed(whole.select("user_id", F.posexplode(cuts).alias("ord", "data")), "user_id")


@register("kept_window", "WITH l AS (SELECT user_id, event_type, max(ts) AS t0 FROM events GROUP BY ALL) SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t0 DESC, event_type) AS INTEGER) AS place FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t0 DESC, event_type) <= 3")
def kept_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three kinds of event each user met last: a report of what would be kept."""
    return J.kept_window(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", 3)


@register("wanted_ahead", "WITH p AS (SELECT j.job_key, max(total) AS total, CAST(max(total) // 2 AS INTEGER) AS i FROM jobs j WHERE total > 0 GROUP BY j.job_key) SELECT job_key, i + d AS i FROM p, (SELECT unnest([1, 2]) AS d) WHERE i + d < total")
def wanted_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to fetch when every job plays its middle chunk."""
    p = table(spark, sf_dir, "jobs").where("total > 0").groupBy("job_key").agg(F.max("total").alias("total")).withColumn("i", F.floor(F.col("total") / 2).cast("int"))
    return J.wanted_ahead(p, "job_key", "i", "total")


@register("lanes", "WITH v AS (SELECT voice_id, row_number() OVER (ORDER BY voice_id) - 1 AS n FROM voices) SELECT voice_id, CAST(n % 3 AS INTEGER) AS lane, CAST(n // 3 AS INTEGER) AS turn FROM v")
def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices dealt to three slots."""
    return J.lanes(table(spark, sf_dir, "voices").select("voice_id"), ["voice_id"], 3)


@register("carried_tails", f"WITH {CHUNK_TEXT}, l AS (SELECT job_key, i, CASE WHEN trim(text) <> '' THEN list_filter(regexp_split_to_array(text, '\\n{{2,}}'), lambda p: trim(p) <> '')[-1] END AS last FROM ct) SELECT job_key, i, coalesce(last_value(last IGNORE NULLS) OVER (PARTITION BY job_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS tail FROM l")
def carried_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each chunk would be told of the one before it."""
    c = table(spark, sf_dir, "chunks").where("pieces is not null").groupBy("job_key", "i").agg(F.max(F.array_join("pieces", " ")).alias("text"))
    return J.carried(c, "job_key", "i").select("job_key", "i", "tail")


@register("patience", "WITH l AS (SELECT user_id, max(ts) AS t0 FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events) SELECT user_id, epoch_us(now) - epoch_us(t0) > 60 * 1000000 AS waiting FROM l, n")
def patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose last snapshot is older than a minute when the last event of all comes."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    last = P.fold(e, "user_id", "ts", ("event_type",)).join(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return J.shown(last, F.col("now")).select("user_id", "waiting")


@register("stalled_jobs", "WITH l AS (SELECT user_id, max(ts) AS t0, arg_max(event_type, struct_pack(t := ts, v := event_type)) AS status FROM events GROUP BY user_id) SELECT user_id FROM l WHERE status NOT IN ('done', 'cancelled', 'error', 'idle') AND epoch(TIMESTAMP '2030-01-01') - floor(epoch(t0)) >= 60")
def stalled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that run on without a word, seen from later."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    states = P.fold(e, "user_id", "ts", ("status",))
    return P.stalled(states, "2030-01-01 00:00:00").select("user_id")


@register("single_flight", "SELECT DISTINCT user_id, event_type FROM events")
def single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request once, however often it came."""
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("request"), "user_id", "event_type")
    return e.dropDuplicates(["request"]).select("user_id", "event_type")


@register("resume_conflicts", """WITH a AS (SELECT book_id, min(job_key) AS lo, max(job_key) AS hi FROM jobs WHERE book_id IS NOT NULL AND total > 0 GROUP BY book_id), t AS (SELECT job_key, max(total) AS total FROM jobs GROUP BY job_key)
SELECT book_id AS slot, hi AS job_key, CASE WHEN hi = lo THEN 'resume' WHEN th.total % 2 = 0 THEN 'start' ELSE 'refuse' END AS action FROM a JOIN t th ON th.job_key = hi""")  # fmt: skip
def resume_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's last job asked for while its first one is there; jobs of an even size may discard it."""
    j = table(spark, sf_dir, "jobs").where("book_id is not null and total > 0").groupBy("book_id", "job_key").agg(F.max("total").alias("total"))
    ends = j.groupBy("book_id").agg(F.min("job_key").alias("lo"), F.max("job_key").alias("hi"))
    of = lambda c: ends.select(F.col("book_id").alias("slot"), F.col(c).alias("job_key")).join(j.select("job_key", "total"), "job_key")
    asked = of("hi").withColumn("discard", (F.col("total") % 2 == 0) & F.lit(True))
    same = ends.where("lo = hi").select(F.col("book_id").alias("slot"), F.lit(True).alias("one"))
    asked = asked.join(same, "slot", "left").withColumn("discard", F.col("discard") & F.col("one").isNull()).drop("one")
    return C.conflict(of("lo"), asked)


@register("unit_cache", f"WITH {CHUNK_TEXT} SELECT job_key, i, i % 3 <> 0 AND i % 5 <> 0 AND i % 7 <> 0 AS hit FROM ct")
def unit_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as units of a cache by content: a third is not there, a fifth of an old version, a seventh has another count."""
    c = table(spark, sf_dir, "chunks").where("pieces is not null").groupBy("job_key", "i").agg(F.max(F.array_join("pieces", " ")).alias("text"))
    units = c.select("job_key", "i", C.unit_key(F.col("job_key"), F.col("i"), F.sha1("text")).alias("key"), F.length("text").alias("items"))
    cache = units.where("i % 3 <> 0").select("key", F.when(F.col("i") % 5 == 0, 1).otherwise(2).alias("v"), F.when(F.col("i") % 7 == 0, F.col("items") + 1).otherwise(F.col("items")).alias("items"))
    hits = C.unit_hits(units.select("key", "items"), cache, 2).select("key", "hit")
    return units.join(hits, "key").select("job_key", "i", "hit")


@register("stub_summaries")
def stub_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book summarised by the stand-in writer."""
    from quillmill.catalog.plan_queries import level_map

    return W.summaries(table(spark, sf_dir, "books"), level_map(spark, sf_dir), 5)
