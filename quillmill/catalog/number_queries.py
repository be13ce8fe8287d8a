"""Numbers, durations, waits, masks and small text forms over columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.catalog import sqltext as Q
from quillmill.functions import maths as M
from quillmill.functions import narration as N
from quillmill.functions import speech as V
from quillmill.functions import text as T
from quillmill.operators import hooks as H
from quillmill.operators import lines as L
from quillmill.operators import sentences as S
from quillmill.operators import signal as G
from quillmill.queries import register
from quillmill.session import table


@register("waits", """SELECT DISTINCT words, CASE WHEN words < 90 THEN words || ' s' ELSE CAST(floor(words / 60.0 + 0.5) AS BIGINT) || ' min' END AS wait, CAST(floor(words * 70 / 500.0 + 0.5) AS BIGINT) AS first, CAST(floor(70 + words * 10 / 500.0 + 0.5) AS BIGINT) AS second,
CAST(floor(80 + words * 20 / 500.0 + 0.5) AS BIGINT) AS third, CASE WHEN words > 0 THEN (500 - words) * 30.0::DOUBLE / words END AS remaining, words >= 20 AND 9.5 < words / 6.0::DOUBLE AS too_short FROM chunks WHERE words IS NOT NULL""")  # fmt: skip
def waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits, progress over three stages, what is left, and sound too short for its words."""
    w = F.col("words")
    total = F.lit(500)
    return table(spark, sf_dir, "chunks").where("words is not null").select("words").distinct().select(
        "words", M.wait_text(w).alias("wait"), M.stage_progress(w, total).alias("first"), M.stage_progress(w, total, 1).alias("second"), M.stage_progress(w, total, 2).alias("third"),
        M.remaining_seconds(w, total, F.lit(30.0)).alias("remaining"), M.too_short(w, F.lit(9.5), F.lit(1.0)).alias("too_short"),
    )


@register("added_when", """WITH n AS (SELECT max(added_at) AS now FROM voices), d AS (SELECT voice_id, added_at, CAST(floor((epoch_us(now) - epoch_us(added_at)) / 86400000000.0) AS BIGINT) AS days, speed_factor FROM voices, n)
SELECT voice_id, days, CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 30 THEN days || ' days ago' ELSE strftime(added_at, '%Y-%m-%d') END AS added,
CASE WHEN floor(speed_factor * 60 + 0.5) < 90 THEN CAST(floor(speed_factor * 60 + 0.5) AS BIGINT) || ' min' WHEN speed_factor IS NOT NULL THEN printf('%.1f h', round(speed_factor, 1)) END AS cost FROM d""")  # fmt: skip
def added_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long ago each voice came, seen from the newest, and what an hour of its sound costs."""
    v = table(spark, sf_dir, "voices").select("voice_id", "added_at", "speed_factor")
    v = v.join(F.broadcast(v.agg(F.max("added_at").alias("now"))))
    return v.select("voice_id", M.days_ago(F.col("now"), F.col("added_at")).alias("days"), M.added_when(F.col("now"), F.col("added_at")).alias("added"), M.cost_text(F.col("speed_factor")).alias("cost"))


@register("clocks", """SELECT DISTINCT words, CAST(words AS DOUBLE) AS clock, CAST(words // 60 * 60 + words % 60 AS DOUBLE) AS colon, CASE WHEN words % 3 = 0 THEN words * 1000.0::DOUBLE WHEN words % 3 = 1 THEN 90000.0::DOUBLE END AS retry,
CASE WHEN words % 2 = 0 THEN CAST(words // 60 * 60 + words % 60 AS DOUBLE) ELSE floor(words * 1000 / 16000.0 + 0.5) END AS track FROM chunks WHERE words IS NOT NULL""")  # fmt: skip
def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of words written as clocks and headers, and read back."""
    c = table(spark, sf_dir, "chunks").where("words is not null").select("words").distinct()
    w = F.col("words")
    clock = F.format_string("%02d:%02d:%02d.00", F.floor(w / 3600), F.floor(w / 60) % 60, w % 60)
    colon = F.format_string("%d:%02d", F.floor(w / 60), w % 60)
    header = F.when(w % 3 == 0, w.cast("string")).when(w % 3 == 1, F.lit("Fri, 19 Jul 2024 02:01:30 GMT")).otherwise(F.lit("soon"))
    now = F.lit("2024-07-19 02:00:00").cast("timestamp")
    return c.select("words", M.clock_seconds(clock).alias("clock"), M.colon_seconds(colon).alias("colon"), M.retry_after(header, now).alias("retry"), M.track_seconds(F.when(w % 2 == 0, colon).otherwise(""), w * 1000).alias("track"))


@register("heading_levels", """SELECT DISTINCT p_size, CASE WHEN p_size / 20.0 >= 1.5 THEN 1 WHEN p_size / 20.0 >= 1.25 THEN 2 ELSE 3 END AS level, (p_size * 10.0 > 50 + 12 AND 500 - (p_size * 10.0 + 150) > 12 AND abs((p_size * 10.0 + p_size * 10.0 + 150) / 2 - 275) < 0.02 * 450) AS centred FROM part""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels by size, and lines in the middle of a column, with sizes of parts as measures."""
    x = F.col("p_size") * 10.0
    return table(spark, sf_dir, "part").select("p_size").distinct().select("p_size", M.level_from_ratio(F.col("p_size") / 20).alias("level"), M.is_centred(x, x + 150, F.lit(50.0), F.lit(500.0), F.lit(12.0)).alias("centred"))


@register("half_point_mode", """WITH s AS (SELECT p_brand, floor(p_retailprice / 100 * 2 + 0.5) / 2 AS k, p_size AS w, p_partkey AS ord FROM part), g AS (SELECT p_brand, k, sum(w) AS w, min(ord) AS first FROM s GROUP BY ALL)
SELECT p_brand, k AS mode FROM g QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY w DESC, first) = 1""")  # fmt: skip
def half_point_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size with the most weight, in steps of a half; the first to appear of two."""
    from quillmill.operators.layout import modal_size

    p = table(spark, sf_dir, "part").select("p_brand", (F.col("p_retailprice") / 100).alias("v"), F.col("p_size").alias("w"), F.col("p_partkey").alias("ord"))
    return modal_size(p, ["p_brand"], "v", "w", "ord").withColumnRenamed("value", "mode")


@register("summary_targets", f"""WITH {Q.BOOKS}, c AS (SELECT book_id, text, len({Q.words('text')}) AS n FROM b), m AS (SELECT *, unnest([2, 5, 12]) AS minutes FROM c), t AS (SELECT *, CAST(floor(minutes * 165 * 1.2::DOUBLE) AS BIGINT) AS target FROM m)
SELECT book_id, minutes, n AS book_words, target, CASE WHEN n < 200 THEN 'NO_TEXT' WHEN target < 450 THEN 'SUMMARY_TOO_SHORT' WHEN target > n * 0.6::DOUBLE THEN 'SUMMARY_TOO_LONG' END AS code FROM t""")  # fmt: skip
def summary_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a summary of some minutes may hold, and why it cannot be made."""
    b = L.texts(table(spark, sf_dir, "books")).select("book_id", T.count_words("text").cast("bigint").alias("book_words")).withColumn("minutes", F.explode(F.array(F.lit(2), F.lit(5), F.lit(12))))
    return b.withColumn("t", M.target_words(F.col("minutes"), F.lit(1.2), F.col("book_words"))).select("book_id", "minutes", "book_words", "t.target", "t.code")


@register("narration_reserve", f"""WITH j AS (SELECT DISTINCT title FROM jobs WHERE title IS NOT NULL) SELECT title, CAST(len({Q.words("'Welcome to this summary of ' || title || ', written by A. B.'")}) + 3 + len({Q.words("'That brings us to the end of this summary of ' || title || ' by A. B.' || '.'")}) + 275 AS BIGINT) AS words FROM j""")
def narration_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a spoken frame may take for each title."""
    j = table(spark, sf_dir, "jobs").where("title is not null").select("title").distinct()
    return j.select("title", N.reserve(F.col("title"), F.lit("A. B.")).alias("words"))


@register("masks", """SELECT vec_id, array_to_string(list_transform(range(8), lambda j: CASE WHEN j < vec_id % 9 THEN 1 ELSE 0 END), '') AS mask, CAST(len(embedding) * 2 + 5 AS INTEGER) AS joined FROM embeddings""")
def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of lengths, and two sounds joined with five silent samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.array_join(G.length_mask((F.col("vec_id") % 9).cast("int"), F.lit(8)).cast("array<string>"), "").alias("mask"), F.size(G.concat_waves(F.array("embedding", "embedding"), 5)).alias("joined"))


@register("code_units", "SELECT DISTINCT label, array_to_string(list_concat(list_transform(string_split(left(label, 12), ''), lambda c: ascii(c)), list_transform(range(12 - length(left(label, 12))), lambda i: 0)), ',') AS units FROM voices WHERE label IS NOT NULL AND label <> ''")
def code_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve characters of each label as numbers."""
    return table(spark, sf_dir, "voices").where("label is not null and label <> ''").select("label").distinct().select("label", F.array_join(G.code_units("label", 12).cast("array<string>"), ",").alias("units"))


@register("cache_actions", "SELECT job_key, i, CASE WHEN words % 3 = 2 THEN 'hit' WHEN words % 2 = 0 THEN 'retime' ELSE 'render' END AS action FROM (SELECT DISTINCT job_key, i, words FROM chunks WHERE words IS NOT NULL)")
def cache_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cached chunk of some version needs."""
    c = table(spark, sf_dir, "chunks").where("words is not null").select("job_key", "i", "words").distinct()
    return c.select("job_key", "i", H.cache_action(F.col("words") % 3, F.when(F.col("words") % 2 == 0, F.array(F.lit(1.0)))).alias("action"))


@register("stale_chunks", "WITH c AS (SELECT job_key || ':' || i AS id, max(words) AS w FROM chunks GROUP BY ALL) SELECT id FROM c WHERE w IS NOT NULL AND (w % 10 = 0 OR w % 10 = 1)")
def stale_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose file has another size than was recorded, or is gone."""
    c = table(spark, sf_dir, "chunks").groupBy(F.concat_ws(":", "job_key", "i").alias("id")).agg(F.max("words").cast("long").alias("bytes")).where("bytes is not null")
    files = c.where("bytes % 10 <> 1").select("id", F.when(F.col("bytes") % 10 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"))
    return H.stale(c, files, "id")


@register("spoken_lines", f"""WITH {Q.LINES}, u AS (SELECT DISTINCT line FROM l), a AS (SELECT line, {Q.trim('line')} AS t, {Q.trim("regexp_replace(" + Q.collapse('line') + ", '^[\"“”]+|[\"“”]+$', '', 'g')")} AS p FROM u),
f AS (SELECT *, {Q.collapse("regexp_replace(regexp_replace(t, " + Q.q(Q.LIST_MARKER) + ", ''), '[*_#`>]+', '', 'g')")} AS m FROM a)
SELECT line, CASE WHEN p = '' THEN '' WHEN regexp_matches(p, '[.!?]$') THEN p ELSE regexp_replace(p, '[,;:]+$', '') || '.' END AS spoken,
CASE WHEN NOT regexp_matches(m, '[A-Za-z]') THEN '' WHEN regexp_matches(m, '[.!?]["''’”)\\]]?$') THEN m ELSE regexp_replace(m, '[,;:]+$', '') || '.' END AS flat,
{Q.trim("regexp_replace(" + Q.collapse('line') + ", '[.,;:]+$', '')")} AS title, left(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '_', 'g'), 40) AS safe FROM f""")  # fmt: skip
def spoken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as speech, as a model's line without marks, as a title and as a file's name."""
    u = L.line_table(table(spark, sf_dir, "books")).select("line").distinct()
    return u.select("line", T.spoken_paragraph("line").alias("spoken"), T.flatten_marks("line").alias("flat"), T.clean_title("line").alias("title"), T.safe_name("line", 40).alias("safe"))


WORDS_SQL = f"WITH {Q.BOOKS}, w AS (SELECT DISTINCT unnest({Q.words('text')}) AS word FROM b)"


@register("word_forms", WORDS_SQL + " SELECT word, regexp_replace(regexp_replace(translate(lower(word), '‘’', ''''''), '[^a-z'']', '', 'g'), '^''+|''+$', '', 'g') AS token, regexp_replace(translate(lower(word), '‘’', ''''''), '[^a-z0-9'']', '', 'g') AS spoken FROM w")
def word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word in the two forms by which words are matched."""
    w = L.texts(table(spark, sf_dir, "books")).select(F.explode(T.words("text")).alias("word")).distinct()
    return w.select("word", T.normalise_token("word").alias("token"), T.normalise_word("word").alias("spoken"))


@register("distinct_titles", "WITH c AS (SELECT book_id, title, min(line_idx) AS first FROM chapters WHERE title IS NOT NULL GROUP BY ALL) SELECT book_id, string_agg(title, ' | ' ORDER BY first, title) AS titles FROM c GROUP BY book_id")
def distinct_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book's titles in reading order, each once."""
    c = table(spark, sf_dir, "chapters").where("title is not null").groupBy("book_id").agg(F.sort_array(F.collect_set(F.struct("line_idx", "title"))).alias("t"))
    return c.select("book_id", F.array_join(F.array_distinct(F.transform("t", lambda x: x["title"])), " | ").alias("titles"))


@register("clean_paragraphs", f"WITH {Q.PARAGRAPHS} SELECT book_id, len(ps) AS paragraphs, sum(length({Q.collapse('t')})) AS chars FROM (SELECT book_id, ps, unnest(ps) AS t FROM p0) GROUP BY book_id, ps")
def clean_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of every text, with single blanks."""
    p = L.texts(table(spark, sf_dir, "books")).select("book_id", F.transform(S.paragraphs("text"), T.collapse).alias("ps")).where(F.size("ps") > 0)
    return p.select("book_id", F.size("ps").cast("bigint").alias("paragraphs"), F.aggregate("ps", F.lit(0), lambda a, x: a + F.length(x)).cast("bigint").alias("chars"))


@register("public_plan", "SELECT DISTINCT job_key, total, CASE WHEN total > 0 THEN 'planned' ELSE 'open' END AS kind FROM jobs")
def public_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a plan is shown: everything but voices, texts and times."""
    j = table(spark, sf_dir, "jobs").withColumn("kind", F.when(F.col("total") > 0, "planned").otherwise("open"))
    return j.drop(*[c for c in j.columns if c not in ("job_key", "total", "kind")]).distinct()


@register("engine_text")
def engine_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk as the engine of its job's language takes it."""
    c = table(spark, sf_dir, "chunks").where("pieces is not null").groupBy("job_key", "i").agg(F.max(F.array_join("pieces", " ")).alias("text"))
    lang = table(spark, sf_dir, "jobs").groupBy("job_key").agg(F.max("lang_code").alias("code"))
    return c.join(lang, "job_key", "left").select("job_key", "i", V.engine_text("text", F.coalesce(F.when(F.length("code") == 2, F.lower("code")), F.lit("en"))).alias("text"))


@register("engine_chunks")
def engine_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book packed by characters."""
    return S.per_text(L.texts(table(spark, sf_dir, "books")), "book_id", "text", "i int, text string", lambda t: list(enumerate(V.engine_chunks(t))))
