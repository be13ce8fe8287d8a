"""Listings of voices, tracks and models, made from the tables by rule and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.catalog.catalogue_queries import ENGINE_LICENCES, LICENCES
from quillmill.operators import catalogue as C
from quillmill.queries import register
from quillmill.session import table
from quillmill.sources import files as X

VOICES = "v AS (SELECT voice_id, name, coalesce(locale, 'xx') AS locale, CASE WHEN length(name) % 4 = 0 THEN 'x_low' WHEN length(name) % 4 = 1 THEN 'low' WHEN length(name) % 4 = 2 THEN 'medium' ELSE 'high' END AS q, max_chars FROM voices)"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of model files as voices would fill it; those with short pieces have no description beside them."""
    v = table(spark, sf_dir, "voices").select("name", F.coalesce("locale", F.lit("xx")).alias("locale"), F.element_at(F.array(*map(F.lit, ["x_low", "low", "medium", "high"])), (F.length("name") % 4 + 1).cast("int")).alias("q"), "max_chars")
    f = v.select(F.concat(F.lit("/voices/"), "locale", F.lit("-"), "name", F.lit("-"), "q", F.lit(".onnx")).alias("path"), "max_chars")
    return f.select("path").unionByName(f.where("max_chars >= 400").select(F.concat("path", F.lit(".json")).alias("path")))


@register("model_files", f"""WITH {VOICES}, f AS (SELECT DISTINCT *, locale || '-' || name || '-' || q AS id, regexp_matches(locale, '^[a-z]{{2}}_[A-Z]{{2}}$') AS fits FROM v WHERE max_chars >= 400)
SELECT DISTINCT '/voices/' || id || '.onnx' AS path, id, CASE WHEN fits THEN locale END AS locale, CASE WHEN fits THEN name ELSE id END AS name, CASE WHEN fits THEN q ELSE 'unknown' END AS quality,
CASE WHEN fits THEN upper(name[1]) || name[2:] || ' | ' || replace(locale, '_', '-') || ' Voice (' || q || ')' ELSE id END AS label, CASE WHEN NOT fits THEN 'Other' WHEN locale = 'en_GB' THEN 'British' ELSE replace(locale, '_', '-') END AS voice_group,
CASE WHEN fits THEN CASE q WHEN 'x_low' THEN 0.12::DOUBLE WHEN 'low' THEN 0.16::DOUBLE WHEN 'medium' THEN 0.25::DOUBLE ELSE 0.97::DOUBLE END END AS speed_factor FROM f""")  # fmt: skip
def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.model_files(listing(spark, sf_dir), groups={"en_GB": "British"}).distinct()


@register("style_files", "SELECT DISTINCT upper(name) AS name, CASE WHEN starts_with(upper(name), 'F') THEN 'Female' ELSE 'Male' END AS gender, 'Supertonic ' || upper(name) || ' | ' || upper(name) AS label FROM voices")
def style_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "voices").select(F.concat(F.lit("styles/"), F.upper("name"), F.lit(".json")).alias("path")).distinct()
    return X.style_files(f.unionByName(f.select(F.concat("path", F.lit(".txt")).alias("path"))))


GRADED = [("af_a", "A"), ("bf_b", "B-"), ("am_c", "B"), ("bm_d", "B+"), ("af_e", "A-"), ("bf_f", "C"), ("am_g", "F+")]


@register("graded_voices", "SELECT * FROM (VALUES ('af_a', 'en_US', 'Female', 'A', 1, 1.63::DOUBLE), ('af_e', 'en_US', 'Female', 'A-', 2, 1.63), ('bm_d', 'en_GB', 'Male', 'B+', 3, 1.63), ('am_c', 'en_US', 'Male', 'B', 4, 1.63), ('bf_b', 'en_GB', 'Female', 'B-', 5, 1.63), ('bf_f', 'en_GB', 'Female', 'C', 6, 1.63), ('am_g', 'en_US', 'Male', 'F+', 7, 1.63)) AS t(name, locale, gender, grade, place, speed_factor)")
def graded_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed catalogue by grade."""
    return X.graded(spark, GRADED)


@register("rendered_chunks", """WITH c AS (SELECT DISTINCT job_key, i FROM chunks WHERE i < 9000), j AS (SELECT min(job_key) AS a, max(job_key) AS b FROM c),
f AS (SELECT i AS idx, '/' || job_key || '/chunk-' || lpad(CAST(i + 1 AS VARCHAR), 4, '0') || CASE WHEN i % 3 = 0 THEN '.wav' ELSE '.flac' END AS path FROM c, j WHERE job_key <> b),
g AS (SELECT * FROM f UNION ALL SELECT idx, replace(path, '.flac', '.wav') FROM f WHERE path LIKE '%.flac')
SELECT idx, arg_min(path, CASE WHEN path LIKE '%.wav' THEN '1' ELSE '0' END || path) AS path FROM g WHERE idx < 25 GROUP BY idx""")  # fmt: skip
def rendered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of chunks of all jobs but the last, whose folder holds measurements and is refused."""
    c = table(spark, sf_dir, "chunks").select("job_key", "i").where("i < 9000").distinct()
    name = F.concat(F.lit("/"), "job_key", F.lit("/chunk-"), F.lpad((F.col("i") + 1).cast("string"), 4, "0"))
    f = c.select(F.concat(name, F.when(F.col("i") % 3 == 0, ".wav").otherwise(".flac")).alias("path"))
    twice = f.where(F.col("path").endswith(".flac")).select(F.replace("path", F.lit(".flac"), F.lit(".wav")).alias("path"))
    last = c.groupBy().agg(F.max("job_key").alias("job_key")).select(F.concat(F.lit("/"), "job_key", F.lit("/chunk-0001.json")).alias("path"))
    return X.rendered_chunks(f.unionByName(twice).unionByName(last), 25)


# hits of four listings, one for each document: even numbers lack an author, every seventh its sound
HITS = """h AS (SELECT doc_id, doc_id % 4 AS p, CASE WHEN doc_id % 2 = 1 THEN coalesce(trim(source), 'x') END AS who, coalesce(host, 'h') || ' ' || doc_id || '.mp3' AS title, CASE WHEN doc_id % 7 <> 0 THEN url END AS url, coalesce(n_chars, 0) AS n,
CASE WHEN doc_id % 5 = 0 THEN 'calm,vocals' ELSE 'calm,slow' END AS tags FROM (SELECT doc_id, max(source) AS source, max(host) AS host, max(url) AS url, max(n_chars) AS n_chars FROM documents WHERE url IS NOT NULL AND url <> '' GROUP BY doc_id))"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("url is not null and url <> ''").select("doc_id", "source", "host", "url", "n_chars")
    d = d.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in ("source", "host", "url", "n_chars")))
    who = F.when(F.col("doc_id") % 2 == 1, F.coalesce(F.trim("source"), F.lit("x")))
    title = F.concat(F.coalesce("host", F.lit("h")), F.lit(" "), F.col("doc_id").cast("string"), F.lit(".mp3"))
    url, n = F.when(F.col("doc_id") % 7 != 0, F.col("url")), F.coalesce("n_chars", F.lit(0))
    tags = F.when(F.col("doc_id") % 5 == 0, "calm,vocals").otherwise("calm,slow")
    forms = {
        "pixabay": F.struct(F.col("doc_id").alias("id"), url.alias("audio"), title.alias("title"), who.alias("user"), n.alias("duration")),
        "freesound": F.struct(F.col("doc_id").alias("id"), F.struct(url.alias("preview-hq-mp3")).alias("previews"), title.alias("name"), who.alias("username"), (n + F.lit(0.5)).alias("duration"), F.split(tags, ",").alias("tags")),
        "ccmixter": F.struct(F.col("doc_id").alias("upload_id"), F.array(F.struct(url.alias("download_url"), n.alias("file_rawsize"), F.struct(F.when(F.col("doc_id") % 3 == 0, "2:05").alias("ps")).alias("file_format_info"))).alias("files"), title.alias("upload_name"), who.alias("user_name"), tags.alias("upload_tags")),
        "openverse": F.struct(F.col("doc_id").cast("string").alias("id"), url.alias("url"), title.alias("title"), who.alias("creator"), n.alias("duration"), F.lit("by").alias("license"), F.lit("4.0").alias("license_version")),
    }
    each = [d.where(F.col("doc_id") % 4 == k).select(F.lit(p).alias("provider"), F.to_json(f).alias("hit")) for k, (p, f) in enumerate(forms.items())]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


TRACKS = HITS + """, tr AS (SELECT ['pixabay', 'freesound', 'ccmixter', 'openverse'][p + 1] AS provider, CAST(doc_id AS VARCHAR) AS id, left(CASE WHEN p = 1 THEN regexp_replace(title, '(?i)\\.[a-z0-9]+$', '') ELSE title END, 90) AS title,
coalesce(who, CASE WHEN p = 0 THEN 'Pixabay contributor' ELSE 'Unknown' END) AS author, CAST(CASE p WHEN 0 THEN n WHEN 1 THEN floor(n + 1) WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN 125 ELSE floor(n / 16000.0 + 0.5) END ELSE floor(n / 1000.0 + 0.5) END AS DOUBLE) AS duration_sec,
CASE p WHEN 0 THEN 'Pixabay Content License' WHEN 1 THEN 'CC0' WHEN 2 THEN 'CC BY' ELSE 'BY 4.0' END AS license, CASE WHEN p = 2 THEN '"' || left(title, 90) || '" by ' || coalesce(who, 'Unknown') || ' (https://creativecommons.org/licenses/by/3.0/)' END AS attribution,
CASE p WHEN 0 THEN 'https://pixabay.com/music/-' || doc_id || '/' WHEN 1 THEN 'https://freesound.org/s/' || doc_id || '/' WHEN 2 THEN 'http://ccmixter.org/files/' || coalesce(who, 'Unknown') || '/' || doc_id ELSE '' END AS page_url, url AS audio_url
FROM h WHERE url IS NOT NULL AND NOT (p IN (1, 2) AND tags LIKE '%vocals%'))"""


@register("listing_tracks", f"WITH {TRACKS} SELECT * FROM tr")
def listing_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.listing_tracks(hits(spark, sf_dir))


SCREENED = TRACKS + """, m AS (SELECT *, CASE WHEN CAST(id AS BIGINT) % 3 > 0 THEN (CAST(id AS BIGINT) % 90) / 10.0::DOUBLE END AS flatness_db, CASE WHEN CAST(id AS BIGINT) % 3 > 0 THEN (CAST(id AS BIGINT) % 200) / 10.0::DOUBLE END AS range_db, CAST(id AS BIGINT) AS ord FROM tr),
sc AS (SELECT *, CASE WHEN duration_sec NOT BETWEEN 90 AND 900 THEN 'duration' WHEN flatness_db > 6 THEN 'flatness' WHEN range_db > 16 THEN 'range' END AS reason FROM m)"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id").cast("long")
    some = lambda c: F.when(n % 3 > 0, c)
    m = X.listing_tracks(hits(spark, sf_dir)).withColumns({"flatness_db": some((n % 90) / 10.0), "range_db": some((n % 200) / 10.0), "ord": n})
    return X.screened(m)


@register("screened_tracks", f"WITH {SCREENED} SELECT provider, id, reason FROM sc")
def screened_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each track is turned down, if it is."""
    return measured(spark, sf_dir).select("provider", "id", "reason")


@register("kept_tracks", f"WITH {SCREENED}, f AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY provider ORDER BY ord) <= 14), k AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY flatness_db IS NULL, flatness_db, ord) AS place FROM f WHERE reason IS NULL) SELECT provider, id, CAST(place AS INTEGER) AS place FROM k WHERE place <= 12")
def kept_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search's report: of the first 14 hits of each listing the best 12 that pass."""
    from pyspark.sql import Window

    w = Window.partitionBy("provider")
    first = measured(spark, sf_dir).withColumn("n", F.row_number().over(w.orderBy("ord"))).where("n <= 14 and reason is null")
    return first.withColumn("place", F.row_number().over(w.orderBy(*X.screened_order()))).where("place <= 12").select("provider", "id", "place")


@register("source_chain", f"WITH {SCREENED} SELECT provider, id FROM sc WHERE reason IS NULL AND author <> 'Unknown' AND provider = (SELECT arg_min(provider, CASE provider WHEN 'freesound' THEN 0 WHEN 'ccmixter' THEN 1 WHEN 'openverse' THEN 2 ELSE 3 END) FROM sc WHERE reason IS NULL AND author <> 'Unknown')")
def source_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks of the first listing with any that pass and name an author."""
    chosen, _ = C.source_chain(measured(spark, sf_dir), ["freesound", "ccmixter", "openverse", "pixabay"], F.col("reason").isNull() & (F.col("author") != "Unknown"), "provider")
    return chosen.select("provider", "id")


@register("source_reasons", f"WITH {SCREENED}, n AS (SELECT s AS source, r FROM (VALUES ('nowhere', 0), ('pixabay', 1), ('openverse', 2)) AS t(s, r)), a AS (SELECT n.*, count(sc.id) AS found, count(sc.id) FILTER (reason IS NULL AND duration_sec < 100) AS kept FROM n LEFT JOIN sc ON sc.provider = n.source GROUP BY ALL), b AS (SELECT min(r) AS best FROM a WHERE kept > 0) SELECT source, CASE WHEN found = 0 THEN 'no matches' ELSE found || ' found, none steady enough' END AS reason FROM a, b WHERE best IS NULL OR r < best")
def source_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the listings before the chosen one gave nothing."""
    return C.source_chain(measured(spark, sf_dir), ["nowhere", "pixabay", "openverse"], F.col("reason").isNull() & (F.col("duration_sec") < 100), "provider")[1]


@register("first_seen", """WITH d AS (SELECT lower(trim(source)) AS provider, host AS id, CAST(min(doc_id % 9) AS INTEGER) AS term FROM documents WHERE source IS NOT NULL AND host IS NOT NULL GROUP BY ALL),
c AS (SELECT term, count(*) AS c FROM d GROUP BY term), b AS (SELECT term, coalesce(sum(c) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT provider, id, d.term FROM d JOIN b ON b.term = d.term WHERE before < 16""")  # fmt: skip
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts by the first of nine terms that finds them; no further term once 16 are found."""
    d = table(spark, sf_dir, "documents").where("source is not null and host is not null").select(F.lower(F.trim("source")).alias("provider"), F.col("host").alias("id"), (F.col("doc_id") % 9).cast("int").alias("term"))
    return C.first_seen(d, ["provider", "id"], [F.col("term")], 16)


@register("remembered", "SELECT voice_id, name FROM voices WHERE engine = 'piper' OR (engine = 'kokoro' AND max_chars >= 400)")
def remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kokoro's voices replace the list, but what is piper's stays pinned."""
    v = table(spark, sf_dir, "voices").select("voice_id", "name", "engine", "max_chars")
    return C.remembered(v, v.where("engine = 'kokoro' and max_chars >= 400"), F.col("engine") == "piper", ["voice_id"]).select("voice_id", "name")


@register("found_tracks", f"WITH {TRACKS} SELECT provider, id, title FROM tr WHERE CAST(id AS BIGINT) % 10 = 3")
def found_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks looked up by listing and id, some of which are in none."""
    t = X.listing_tracks(hits(spark, sf_dir))
    asked = t.where(F.col("id").cast("long") % 10 == 3).select("provider", "id").unionByName(t.select("provider", F.lit("none").alias("id")).distinct())
    return C.find(t, asked, ["provider", "id"]).select("provider", "id", "title")


MODELS = """md AS (SELECT DISTINCT p_name || CASE WHEN p_size % 2 = 0 THEN ':free' ELSE '' END || CASE WHEN p_size % 7 = 0 THEN '-coder' ELSE '' END AS id0, p_partkey, p_size FROM part),
mm AS (SELECT p_partkey || '/' || CASE WHEN p_size % 7 = 0 THEN 'coder-' ELSE '' END || p_size || CASE WHEN p_size % 2 = 0 THEN ':free' ELSE '' END AS id, p_size % 2 = 0 AS free, CAST(p_size * 2000 AS BIGINT) AS context, CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS BIGINT) END AS max_output,
CASE WHEN p_size % 5 = 0 THEN 'strict' WHEN p_size % 5 = 1 THEN 'object' ELSE 'prompt' END AS format, p_size % 4 = 0 AS effort, p_size FROM (SELECT DISTINCT p_partkey, p_size FROM part))"""


def model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    name = F.concat(F.col("p_partkey").cast("string"), F.lit("/"), F.when(s % 7 == 0, "coder-").otherwise(""), s.cast("string"), F.when(s % 2 == 0, ":free").otherwise(""))
    able = F.array_compact(F.array(F.when(s % 5 == 0, "structured_outputs"), F.when(s % 5 <= 1, "response_format"), F.when(s % 4 == 0, "reasoning_effort")))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size").distinct()
    return p.select(F.to_json(F.struct(name.alias("id"), (s * 2000).alias("context_length"), able.alias("supported_parameters"), F.struct(F.when(s % 3 > 0, s).alias("max_completion_tokens")).alias("top_provider"))).alias("hit"))


@register("models", f"WITH {MODELS} SELECT id, free, context, max_output, format, effort FROM mm")
def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.models(model_list(spark, sf_dir))


@register("free_writers", f"WITH {MODELS} SELECT id, CAST(row_number() OVER (ORDER BY (format = 'strict') DESC, context DESC, id) AS INTEGER) AS place FROM mm WHERE free AND context >= 32000 AND NOT regexp_matches(id, '(?i)safety|guard|code|coder')")
def free_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.free_writers(X.models(model_list(spark, sf_dir))).select("id", "place")


@register("licensed_search", "WITH l AS (SELECT voice_id, engine, concat_ws(' ', name, label, locale, quality, gender, engine, voice_group) AS f, CASE WHEN engine = 'piper' THEN coalesce(CASE name WHEN 'barulock' THEN 'CC0' WHEN 'melldane' THEN 'CC BY 4.0' WHEN 'garuzell' THEN 'CC BY-SA 4.0' END, 'unknown') ELSE coalesce(CASE engine WHEN 'kokoro' THEN 'Apache 2.0' WHEN 'supertonic' THEN 'OpenRAIL' END, 'unknown') END AS licence FROM voices) SELECT voice_id, licence FROM l WHERE contains(lower(f || ' ' || licence), 'apache')")
def licensed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices found by their licence."""
    return C.search(licensed(spark, sf_dir), "Apache").select("voice_id", "licence")


def licensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_licence(table(spark, sf_dir, "voices"), spark.createDataFrame(LICENCES, "dataset string, licence string"), spark.createDataFrame(ENGINE_LICENCES, "engine string, licence string"))


@register("publishable_groups", "SELECT voice_group, count(*) AS voices, string_agg(name, ',' ORDER BY name) AS names, count(locale) AS with_locale, count(*) FILTER (engine = 'kokoro') AS publishable FROM voices GROUP BY voice_group")
def publishable_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with a count of a flag of each voice."""
    return C.grouped(licensed(spark, sf_dir).withColumn("publishable", F.col("licence") == "Apache 2.0"))


@register("total_seconds", "SELECT count(*) * 64 / 8000.0::DOUBLE AS seconds FROM embeddings")
def total_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of all vectors written as sound files of 8,000 samples a second, added up from their headers."""

    def run(it):
        import numpy as np
        import pandas as pd

        for pdf in it:
            yield pd.DataFrame({"content": [X.wav_bytes(np.clip(np.asarray(x) * 32767, -32768, 32767).astype("<i2"), 8000) for x in pdf["embedding"]]})

    f = table(spark, sf_dir, "embeddings").select("embedding").mapInPandas(run, "content binary")
    return X.total_seconds(f).select(F.round("seconds", 6).alias("seconds"))
