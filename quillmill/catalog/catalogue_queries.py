"""Voices, jobs, chunk deliveries, as-of and range lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.catalog import sqltext as Q
from quillmill.functions import maths as M
from quillmill.operators import catalogue as C
from quillmill.queries import register
from quillmill.session import table


@register("voice_union", "SELECT voice_id, engine, name FROM voices")
def voice_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "voices").select("voice_id", "engine", "name")
    return C.union_catalogues([v.where(F.col("engine") == e) for e in C.ENGINES])


LICENCES = [("barulock", "CC0"), ("melldane", "CC BY 4.0"), ("garuzell", "CC BY-SA 4.0")]
ENGINE_LICENCES = [("kokoro", "Apache 2.0"), ("supertonic", "OpenRAIL")]


@register("voice_licences", """SELECT voice_id, CASE WHEN engine = 'piper' THEN coalesce(CASE name WHEN 'barulock' THEN 'CC0' WHEN 'melldane' THEN 'CC BY 4.0' WHEN 'garuzell' THEN 'CC BY-SA 4.0' END, 'unknown')
 ELSE coalesce(CASE engine WHEN 'kokoro' THEN 'Apache 2.0' WHEN 'supertonic' THEN 'OpenRAIL' END, 'unknown') END AS licence FROM voices""")  # fmt: skip
def voice_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_dataset, by_engine = spark.createDataFrame(LICENCES, "dataset string, licence string"), spark.createDataFrame(ENGINE_LICENCES, "engine string, licence string")
    return C.with_licence(table(spark, sf_dir, "voices"), by_dataset, by_engine).select("voice_id", "licence")


@register("voice_search", "SELECT voice_id, label FROM voices WHERE contains(lower(concat_ws(' ', name, label, locale, quality, gender, engine, voice_group)), 'en_')")
def voice_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.search(table(spark, sf_dir, "voices"), " EN_ ").select("voice_id", "label")


@register("voice_groups", "SELECT voice_group, count(*) AS voices, string_agg(name, ',' ORDER BY name) AS names, count(locale) AS with_locale FROM voices GROUP BY voice_group")
def voice_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.grouped(table(spark, sf_dir, "voices"))


@register("engine_counts", "SELECT engine, count(*) AS voices FROM voices GROUP BY ROLLUP (engine)")
def engine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "voices").rollup("engine").agg(F.count("*").alias("voices"))


@register("newest_batch", "WITH t AS (SELECT max(uploaded_at) AS m, count(*) AS n FROM books), l AS (SELECT b.* FROM books b, t WHERE uploaded_at >= m - INTERVAL 1 HOUR) SELECT book_id FROM l WHERE (SELECT count(*) FROM l) < (SELECT n FROM t)")
def newest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.newest_batch(table(spark, sf_dir, "books").select("book_id", "uploaded_at"), "uploaded_at").select("book_id")


@register("newest_voices", "SELECT voice_id, row_number() OVER (ORDER BY coalesce(epoch_us(added_at), 0) DESC, voice_id) AS place FROM voices")
def newest_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return table(spark, sf_dir, "voices").select("voice_id", F.row_number().over(Window.orderBy(*C.newest_first(None, "added_at"), "voice_id")).cast("bigint").alias("place"))


@register("quality_order", "SELECT voice_id, row_number() OVER (ORDER BY quality, name, voice_id) AS place FROM voices WHERE engine = 'kokoro'")
def quality_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return table(spark, sf_dir, "voices").where("engine = 'kokoro'").select("voice_id", F.row_number().over(Window.orderBy("quality", "name", "voice_id")).cast("bigint").alias("place"))


@register("voice_titles", f"""WITH v AS (SELECT voice_id, name, quality, label, {Q.words('coalesce(label, name)')} AS w FROM voices)
SELECT voice_id, coalesce(nullif({Q.trim("split_part(label, '|', 1)")}, ''), name) AS title, coalesce(nullif({Q.trim("split_part(label, '|', 2)")}, ''), quality) AS subtitle,
upper(array_to_string(list_transform(list_slice(w, 1, 2), lambda x: x[1]), '')) AS initials FROM v""")  # fmt: skip
def voice_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.titles(table(spark, sf_dir, "voices"))


@register("voice_costs", "SELECT v.voice_id, count(DISTINCT j.job_key) AS jobs, round(coalesce(v.speed_factor, 1) * 60, 2) AS minutes_per_hour FROM voices v LEFT JOIN jobs j ON j.voice_id = v.voice_id GROUP BY v.voice_id, v.speed_factor")
def voice_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "jobs").groupBy("voice_id").agg(F.countDistinct("job_key").alias("jobs"))
    return table(spark, sf_dir, "voices").join(j, "voice_id", "left").select("voice_id", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.round(F.coalesce("speed_factor", F.lit(1.0)) * 60, 2).alias("minutes_per_hour"))


PLANNED = """t AS (SELECT job_key, max(total) AS total FROM jobs WHERE total > 0 GROUP BY job_key), pl AS (SELECT job_key, CAST(unnest(range(total)) AS INTEGER) AS i FROM t),
c AS (SELECT DISTINCT job_key, i FROM chunks)"""


@register("pending_chunks", f"WITH {PLANNED}, f AS (SELECT DISTINCT job_key, i FROM chunks WHERE len(pieces) > 0) SELECT job_key, i FROM pl ANTI JOIN f USING (job_key, i)")
def pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned chunks that never came with a piece."""
    return C.pending(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "chunks").where(F.size("pieces") > 0))


@register("finished_chunks", f"WITH {PLANNED} SELECT job_key, count(*) AS done FROM pl SEMI JOIN c USING (job_key, i) GROUP BY job_key")
def finished_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.finished(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "chunks"))


@register("resume_state", f"""WITH {PLANNED}, d AS (SELECT job_key, count(*) AS done FROM pl SEMI JOIN c USING (job_key, i) GROUP BY job_key),
j AS (SELECT job_key, max(total) AS total, arg_max(voice_id, exported_at) AS voice_id, arg_max(speed, exported_at) AS speed, arg_max(title, exported_at) AS title FROM jobs WHERE total > 0 GROUP BY job_key)
SELECT j.job_key, substring(sha1(j.voice_id || '|' || CAST(j.speed AS VARCHAR) || '|' || coalesce(j.title, '')), 1, 16) AS run_key, j.total, coalesce(done, 0) AS done, j.total - coalesce(done, 0) AS missing,
CAST(floor(coalesce(done, 0) * 70 / j.total + 0.5) AS BIGINT) AS progress FROM j LEFT JOIN d USING (job_key)""")  # fmt: skip
def resume_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resume_state(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "chunks"))


@register("deliveries", "SELECT job_key, i, max(coalesce(len(pieces), 0)) AS n_pieces, count(*) AS deliveries, epoch_us(min(received_at)) AS first_us, epoch_us(max(received_at)) AS last_us FROM chunks GROUP BY job_key, i")
def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.deliveries(table(spark, sf_dir, "chunks"))
    return d.select("job_key", "i", F.col("n_pieces").cast("bigint").alias("n_pieces"), "deliveries", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


@register("latest_books", "SELECT book_id, arg_max(filename, uploaded_at) AS filename, epoch_us(max(uploaded_at)) AS at FROM (SELECT * FROM books WHERE filename IS NOT NULL) GROUP BY book_id")
def latest_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "books").where("filename is not null").select("book_id", "filename", "uploaded_at")
    return C.keep_latest(b, ["book_id"], [F.col("uploaded_at").desc(), F.col("filename")]).select("book_id", "filename", F.unix_micros("uploaded_at").alias("at"))


CLOCK = """k AS (SELECT job_key, i, coalesce(arg_max(words, struct_pack(r := received_at, w := coalesce(words, -1))), 0) AS w0, row_number() OVER () AS z FROM chunks GROUP BY job_key, i),
d AS (SELECT job_key, i, coalesce(words, 0) AS words FROM (SELECT *, row_number() OVER (PARTITION BY job_key, i ORDER BY received_at DESC, words DESC NULLS LAST) AS rn FROM chunks) WHERE rn = 1),
u AS (SELECT *, sum(words) OVER (PARTITION BY job_key ORDER BY i) AS upto FROM d),
clock AS (SELECT job_key, i, words, round((upto - words) * 0.38, 2) AS start_sec, round(upto * 0.38, 2) AS end_sec FROM u)"""


@register("chunk_clock", f"WITH {CLOCK} SELECT * FROM clock")
def chunk_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cumulative(table(spark, sf_dir, "chunks"))


@register("chunk_at_time", f"""WITH {CLOCK}, e AS (SELECT job_key, max(end_sec) AS total FROM clock GROUP BY job_key),
p AS (SELECT job_key, round(total * f / 7, 2) AS at FROM e, (SELECT unnest(range(1, 7)) AS f)) SELECT p.job_key, p.at, c.i FROM p JOIN clock c ON c.job_key = p.job_key AND p.at >= c.start_sec AND p.at < c.end_sec""")  # fmt: skip
def chunk_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six points of every job's time, each with the chunk that plays then."""
    clock = C.cumulative(table(spark, sf_dir, "chunks"))
    points = clock.groupBy("job_key").agg(F.max("end_sec").alias("total")).select("job_key", F.explode(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda f: F.round(F.col("total") * f / 7, 2))).alias("at"))
    return C.chunk_at(points, clock)


@register("event_asof", """SELECT a.event_id, b.value AS last_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') a
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts""")  # fmt: skip
def event_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other event with the value of the user's last purchase before it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    rest = e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return C.as_of(rest, bought, ["user_id"], "ts", "last_purchase").select("event_id", "last_purchase")


@register("first_source", "WITH s AS (SELECT * FROM documents WHERE source IN ('letters', 'glossaries', 'reference')) SELECT doc_id, source FROM s WHERE source = (SELECT CASE min(CASE source WHEN 'letters' THEN 0 WHEN 'glossaries' THEN 1 ELSE 2 END) WHEN 0 THEN 'letters' WHEN 1 THEN 'glossaries' ELSE 'reference' END FROM s)")
def first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_source(table(spark, sf_dir, "documents").select("doc_id", "source"), ["letters", "glossaries", "reference"])


@register("cache_pruned", "SELECT job_key FROM (SELECT DISTINCT job_key, exported_at FROM jobs WHERE exported_at IS NOT NULL) QUALIFY row_number() OVER (ORDER BY exported_at DESC, job_key) > 40")
def cache_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "jobs").where("exported_at is not null").select("job_key", "exported_at").distinct()
    return C.pruned(j, 40, "exported_at").select("job_key")


@register("job_speeds", "SELECT DISTINCT job_key, least(2.0, greatest(0.5, coalesce(nullif(speed, 0), 1))) AS speed FROM jobs")
def job_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jobs").select("job_key", M.clamp_speed(F.col("speed")).alias("speed")).distinct()


@register("back_off", "SELECT n AS attempt, least(60.0, greatest(1.0, 5.0 * pow(2, n - 1))) AS seconds FROM (SELECT unnest(range(1, 8)) AS n)")
def back_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 8).select(F.col("id").alias("attempt"), M.back_off(F.col("id")).alias("seconds"))


@register("http_errors", """SELECT DISTINCT http_status AS status, CASE WHEN http_status = 429 THEN 'RATE_LIMITED' WHEN http_status IN (401, 403) THEN 'AUTH' WHEN http_status = 404 THEN 'MODEL_MISSING' WHEN http_status = 413 THEN 'TOO_LARGE'
WHEN http_status >= 500 THEN 'SERVER' ELSE 'BAD_REQUEST' END AS code, coalesce(http_status = 429 OR http_status >= 500, false) AS retryable FROM documents WHERE http_status <> 200""")  # fmt: skip
def http_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("http_status <> 200").select(F.col("http_status").alias("status"), M.http_error(F.col("http_status")).alias("e")).select("status", "e.code", "e.retryable").distinct()


@register("speech_rate", """WITH sp AS (SELECT job_key, max(speed) AS speed FROM jobs GROUP BY job_key), j AS (SELECT DISTINCT c.job_key, coalesce(sp.speed, 1.0) AS speed FROM chunks c LEFT JOIN sp USING (job_key)),
r AS (SELECT job_key, i, received_at, array_to_string(list_filter(pieces, lambda p: p IS NOT NULL), ' ') AS text, words FROM chunks WHERE pieces IS NOT NULL),
l AS (SELECT job_key, text, words FROM (SELECT *, row_number() OVER (PARTITION BY job_key, i ORDER BY received_at DESC, text COLLATE C DESC, words DESC NULLS LAST) AS rn FROM r WHERE trim(text) <> '') WHERE rn = 1),
s AS (SELECT l.job_key, l.words, round_even(len(list_filter(regexp_split_to_array(text, '[\\s\\x1c-\\x1f\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> '')) * 0.38::DOUBLE * 100 / greatest(j.speed, 0.5), 0) / 100 AS seconds FROM l JOIN j USING (job_key)),
a AS (SELECT job_key, sum(seconds) AS seconds, sum(words) AS words FROM s GROUP BY job_key)
SELECT j.job_key, CASE WHEN coalesce(a.words, 0) >= 40 THEN round(a.seconds / a.words, 4) ELSE round(0.38::DOUBLE / greatest(0.5, j.speed), 4) END AS seconds_per_word, CAST(coalesce(a.words, 0) AS BIGINT) AS words FROM j LEFT JOIN a USING (job_key)""")  # fmt: skip
def speech_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds a word as the stand-in engine's samples measure them once 40 words are known, else the usual pace at the job's speed."""
    from quillmill.operators import hooks

    chunks = table(spark, sf_dir, "chunks")
    speeds = table(spark, sf_dir, "jobs").groupBy("job_key").agg(F.max("speed").alias("speed"))
    jobs = chunks.select("job_key").distinct().join(speeds, "job_key", "left").withColumn("speed", F.coalesce("speed", F.lit(1.0)))
    rendered = chunks.select("job_key", "i", "received_at", F.array_join("pieces", " ").alias("text"), "words").where("trim(text) <> ''")
    last = rendered.groupBy("job_key", "i").agg(F.max(F.struct("received_at", "text", "words")).alias("c")).join(jobs, "job_key")
    known = hooks.durations(last.select("job_key", "c.text", "c.words", "speed")).groupBy("job_key").agg(F.sum("seconds").alias("seconds"), F.sum("words").alias("words"))
    words = F.coalesce("words", F.lit(0).cast("bigint"))
    rate = F.when(words >= 40, F.round(F.col("seconds") / words, 4)).otherwise(F.round(0.38 / F.greatest(F.lit(0.5), "speed"), 4))
    return jobs.join(known, "job_key", "left").select("job_key", rate.alias("seconds_per_word"), words.alias("words"))


@register("orphan_chunks", "SELECT DISTINCT job_key, i FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.job_key = c.job_key AND j.total IS NOT NULL)")
def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without a job that says how many there are."""
    jobs = table(spark, sf_dir, "jobs").where("total is not null").select("job_key").distinct()
    return table(spark, sf_dir, "chunks").select("job_key", "i").distinct().join(jobs, "job_key", "left_anti")


@register("line_marks", """SELECT DISTINCT o.book_id, o.line_idx, o.kind, c.idx AS chapter FROM outline_entries o LEFT JOIN (SELECT DISTINCT book_id, line_idx, idx FROM chapters) c ON c.book_id = o.book_id AND c.line_idx = o.line_idx""")
def line_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline entries with the chapter that starts on their line."""
    c = table(spark, sf_dir, "chapters").select("book_id", "line_idx", F.col("idx").alias("chapter")).distinct()
    return table(spark, sf_dir, "outline_entries").select("book_id", "line_idx", "kind").distinct().join(c, ["book_id", "line_idx"], "left").distinct()


@register("chapter_levels", """WITH o AS (SELECT DISTINCT book_id, line_idx, level FROM outline_entries WHERE kind = 'heading'), c AS (SELECT DISTINCT book_id, line_idx, title FROM chapters WHERE title IS NOT NULL)
SELECT book_id, title, min(coalesce(level, 2)) AS level FROM c LEFT JOIN o USING (book_id, line_idx) GROUP BY book_id, title""")  # fmt: skip
def chapter_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least level measured for each chapter title, 2 where none was."""
    o = table(spark, sf_dir, "outline_entries").where("kind = 'heading'").select("book_id", "line_idx", "level").distinct()
    c = table(spark, sf_dir, "chapters").where("title is not null").select("book_id", "line_idx", "title").distinct()
    return c.join(o, ["book_id", "line_idx"], "left").groupBy("book_id", "title").agg(F.min(F.coalesce("level", F.lit(2))).alias("level"))


@register("voices_by_job", "SELECT DISTINCT j.job_key, v.name, v.engine FROM jobs j JOIN voices v ON v.voice_id = j.voice_id AND split_part(j.voice_id, ':', 1) = v.engine")
def voices_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voice of each job by engine and id."""
    j = table(spark, sf_dir, "jobs").select("job_key", "voice_id", F.split_part("voice_id", F.lit(":"), F.lit(1)).alias("engine")).distinct()
    return j.join(table(spark, sf_dir, "voices").select("voice_id", "engine", "name"), ["voice_id", "engine"]).select("job_key", "name", "engine").distinct()


@register("stub_speech")
def stub_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in engine over every chunk with text: seconds, level and pauses measured from its samples."""
    from quillmill.operators import hooks, signal

    c = table(spark, sf_dir, "chunks").where("pieces is not null").select("job_key", "i", F.array_join("pieces", " ").alias("text"), F.lit(1.0).alias("speed")).where("trim(text) <> ''").distinct()
    s = hooks.synthesise(c)
    return s.select("job_key", "i", (F.size("samples") / 100).alias("seconds"), F.round(signal.dbfs(signal.rms("samples")), 4).alias("dbfs"), signal.bounds("samples", 0.01)["last"].alias("last"))
