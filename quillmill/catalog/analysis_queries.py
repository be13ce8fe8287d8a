"""Grounding checks, vocabularies, moods, budgets and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.catalog import sqltext as Q
from quillmill.functions import maths as M
from quillmill.functions import text as T
from quillmill.operators import grounding as G
from quillmill.operators import lines as L
from quillmill.operators import signal as S
from quillmill.plans import budget as B
from quillmill.queries import register
from quillmill.session import table

NUM = "regexp_replace(replace({x}, ',', ''), '\\.$', '')"
NUMS = "unnest(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?'))"


def norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"


WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c) for c in range(0x21, 0x7F))


def norm_wide(x: str) -> str:
    """The same for texts with full-width forms."""
    return norm(f"translate({x}, {Q.q(WIDE)}, {Q.q(NARROW)})")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("id"), "text").where("text is not null")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("text").where("text is not null")


@register("number_check", f"""WITH s AS (SELECT DISTINCT doc_id AS id, {NUM.format(x=NUMS)} AS number FROM documents), h AS (SELECT DISTINCT {NUM.format(x=NUMS)} AS number FROM eval_items)
SELECT id, number FROM s WHERE length(regexp_replace(number, '[^0-9]', '', 'g')) >= 2 AND number NOT IN (SELECT number FROM h)""")  # fmt: skip
def number_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the documents that no item has."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").where("text is not null")
    return G.number_issues(d, claims(spark, sf_dir))


@register("quote_check", f"""WITH q AS (SELECT DISTINCT item_id AS id, unnest(regexp_extract_all(text, {Q.q(G.QUOTE)}, 1)) AS quote FROM eval_items),
n AS (SELECT id, quote, {norm('quote')} AS norm FROM q), d AS (SELECT ' ' || {norm('text')} || ' ' AS n FROM documents WHERE text IS NOT NULL)
SELECT id, quote FROM n WHERE len(string_split(norm, ' ')) >= 3 AND NOT EXISTS (SELECT 1 FROM d WHERE contains(d.n, ' ' || norm || ' '))""")  # fmt: skip
def quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.quote_issues(claims(spark, sf_dir), sources(spark, sf_dir))


@register("vocabulary", f"SELECT DISTINCT unnest(string_split({norm_wide('text')}, ' ')) AS word FROM (SELECT unnest(pieces) AS text FROM chunks) WHERE {norm_wide('text')} <> ''")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all chunks."""
    return G.vocabulary(table(spark, sf_dir, "chunks").select(F.explode("pieces").alias("text")))


LEX = f"""e AS (SELECT {Q.trim('lower(entry)')} AS e FROM lexicon WHERE entry IS NOT NULL), p AS (SELECT unnest(regexp_split_to_array(e, '(' || {Q.q(Q.WS)} || '|-)+')) AS p FROM e WHERE e <> '' AND NOT starts_with(e, '#')),
lex AS (SELECT DISTINCT regexp_replace(p, '[^a-z'']', '', 'g') AS word FROM p WHERE length(regexp_replace(p, '[^a-z'']', '', 'g')) >= 2)"""


@register("lexicon_words", f"WITH {LEX} SELECT word FROM lex")
def lexicon_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lexicon_words(table(spark, sf_dir, "lexicon"))


def _base_forms(w: str) -> str:
    """The list of forms a word (column ``w``) may be derived from; ``v`` is the word without a closing 's."""
    cut = lambda n, extra="": f"(v[:length(v) - {n}] || '{extra}')"
    keep = lambda end, x: f"CASE WHEN ends_with(v, '{end}') AND length({x}) >= 3 THEN {x} END"
    stem = "regexp_replace(v, '(ing|ed)$', '')"
    double = f"CASE WHEN {stem} <> v AND length({stem}) >= 4 AND {stem}[-1] = {stem}[-2] THEN {stem}[:length({stem}) - 1] END"
    plain = f"CASE WHEN ends_with(v, 's') AND NOT ends_with(v, 'ss') AND length({cut(1)}) >= 3 THEN {cut(1)} END"
    forms = [w, keep("ies", cut(3, "y")), keep("es", cut(1)), keep("es", cut(2)), plain, keep("ed", cut(1)), keep("ed", cut(2)), keep("ing", cut(3)), keep("ing", cut(3, "e")), keep("ly", cut(2)), keep("er", cut(1)), keep("er", cut(2)), keep("est", cut(2)), keep("est", cut(3)), keep("ness", cut(4)), keep("ment", cut(4)), double, "v"]
    return "[" + ", ".join(forms) + "]"


ROMAN_SQL = T.ROMAN.replace(r"\z", "$")


@register("known_tokens", f"""WITH {LEX}, {Q.BOOKS}, tk AS (SELECT DISTINCT unnest({Q.words('text')}) AS token FROM b),
n AS (SELECT token, regexp_replace(regexp_replace(translate(lower(token), '‘’', chr(39) || chr(39)), '[^a-z'']', '', 'g'), '^''+|''+$', '', 'g') AS w FROM tk), m AS (SELECT *, regexp_replace(w, chr(39) || 's$', '') AS v FROM n),
f AS (SELECT token, unnest({_base_forms('w')}) AS form FROM m), k AS (SELECT word FROM lex UNION SELECT unnest(string_split({Q.q(Q.ABBREVIATIONS)}, ' '))), h AS (SELECT DISTINCT token FROM f JOIN k ON k.word = f.form WHERE form <> '')
SELECT m.token, (regexp_matches(m.token, '(?i)^[0-9][0-9.,:%-]*(st|nd|rd|th)?$') OR (length(w) >= 2 AND regexp_matches(w, {Q.q(ROMAN_SQL)})) OR h.token IS NOT NULL) AS known FROM m LEFT JOIN h ON h.token = m.token""")  # fmt: skip
def known_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = L.texts(table(spark, sf_dir, "books")).select(F.explode(T.words("text")).alias("token"))
    return G.known_tokens(tokens, G.lexicon_words(table(spark, sf_dir, "lexicon")))


def moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mood lexicon by rule: words of the lexicon in nine moods, weights 1 to 4. The real one is a parameter."""
    w = table(spark, sf_dir, "lexicon").where(F.col("entry").rlike("^[a-z]{4,}$")).groupBy("entry").agg(F.min("line_no").alias("n"))
    return w.select(F.concat(F.lit("mood"), F.col("n") % 9).alias("mood"), (F.col("n") % 9).alias("ord"), F.col("entry").alias("keyword"), (F.col("n") % 4 + 1).alias("weight"))


@register(
    "mood_score",
    """WITH b AS (SELECT DISTINCT book_id || ':' || left(md5(text), 8) AS book_id, text FROM books WHERE text IS NOT NULL), m AS (SELECT entry AS keyword, min(line_no) AS n FROM lexicon WHERE regexp_matches(entry, '^[a-z]{4,}$') GROUP BY entry),
w AS (SELECT book_id AS id, unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS w FROM b),
f AS (SELECT id, unnest(list_distinct([x for x in [w, CASE WHEN ends_with(w, 's') AND length(w) >= 4 THEN w[:-2] END, CASE WHEN ends_with(w, 'es') AND length(w) >= 5 THEN w[:-3] END, CASE WHEN ends_with(w, 'ed') AND length(w) >= 5 THEN w[:-3] END,
  CASE WHEN ends_with(w, 'ing') AND length(w) >= 6 THEN w[:-4] END, CASE WHEN ends_with(w, 'ies') AND length(w) >= 5 THEN w[:-4] || 'y' END] if x is not null])) AS k FROM w WHERE length(w) >= 3),
s AS (SELECT id, n % 9 AS ord, sum(n % 4 + 1) AS score FROM f JOIN m ON f.k = m.keyword GROUP BY ALL),
r AS (SELECT *, row_number() OVER o AS rn, coalesce(lead(score) OVER o, 0) AS second FROM s WINDOW o AS (PARTITION BY id ORDER BY score DESC, ord)),
t AS (SELECT id, 'mood' || ord AS mood, score, second, CASE WHEN second = 0 THEN 3.0 ELSE round(score / second, 6) END AS margin FROM r WHERE rn = 1)
SELECT i.book_id AS id, coalesce(mood, 'mood0') AS mood, CAST(coalesce(score, 0) AS BIGINT) AS score, CAST(coalesce(second, 0) AS BIGINT) AS runner_up, coalesce(margin, 0) AS margin,
CASE WHEN score IS NULL THEN 'low' WHEN margin >= 1.8 THEN 'high' WHEN margin >= 1.25 THEN 'medium' ELSE 'low' END AS confidence FROM b i LEFT JOIN t ON t.id = i.book_id""",
)
def mood_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mood of every text."""
    b = L.texts(table(spark, sf_dir, "books"))
    return G.best_mood(b.select(F.concat_ws(":", "book_id", F.substring(F.md5("text"), 1, 8)).alias("id"), "text"), moods(spark, sf_dir))


CH = "c AS (SELECT DISTINCT book_id, idx, word_count AS words FROM chapters WHERE word_count IS NOT NULL)"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters").where("word_count is not null").select("book_id", "idx", F.col("word_count").alias("words")).distinct()


@register("allocate", f"""WITH RECURSIVE {CH}, g AS (SELECT book_id, list(idx ORDER BY idx) AS ids, list(words ORDER BY idx, words) AS w, CAST(floor(sum(words) / 10) AS BIGINT) AS total FROM c GROUP BY book_id),
r AS (SELECT book_id, 0 AS n, list_transform(w, lambda x: false) AS f, false AS done FROM g UNION ALL
 SELECT book_id, n + 1, nf, nf = f FROM (SELECT r.book_id, n, f, list_transform(range(1, len(w) + 1), lambda k: f[k] OR floor((total - 60 * len(list_filter(f, lambda x: x))) * w[k] * 1.0::DOUBLE / greatest(1, coalesce(list_sum(list_transform(range(1, len(w) + 1), lambda j: CASE WHEN f[j] THEN 0 ELSE w[j] END)), 0))) < 60) AS nf
 FROM r JOIN g USING (book_id) WHERE NOT done)),
l AS (SELECT book_id, arg_max(f, n) AS f FROM r GROUP BY book_id),
o AS (SELECT g.book_id, ids, w, f, total - 60 * len(list_filter(f, lambda x: x)) AS rest, coalesce(list_sum(list_transform(range(1, len(w) + 1), lambda j: CASE WHEN f[j] THEN 0 ELSE w[j] END)), 0) AS free FROM g JOIN l USING (book_id)),
u AS (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM o)
SELECT book_id, ids[k] AS idx, CAST(w[k] AS BIGINT) AS words, CAST(CASE WHEN f[k] THEN 60 WHEN free > 0 THEN floor(rest * w[k] * 1.0::DOUBLE / free) ELSE 0 END AS BIGINT) AS budget FROM u""")  # fmt: skip
def allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of each book's words over its chapters, 60 at least."""
    s = sections(spark, sf_dir)
    total = s.groupBy("book_id").agg(F.floor(F.sum("words") / 10).alias("total"))
    return B.allocate(s.join(total, "book_id"), "book_id", "idx", "words", "total", 60)


@register("absorb_small", f"""WITH RECURSIVE {CH}, o AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY idx) AS n, count(*) OVER (PARTITION BY book_id) AS m FROM c),
r AS (SELECT book_id, n, m, 0 AS k, CAST(words AS BIGINT) AS acc FROM o WHERE n = 1 UNION ALL
 SELECT o.book_id, o.n, o.m, CASE WHEN r.acc >= 300 THEN r.k + 1 ELSE r.k END, CASE WHEN r.acc >= 300 THEN o.words ELSE r.acc + o.words END FROM r JOIN o ON o.book_id = r.book_id AND o.n = r.n + 1),
f AS (SELECT r.book_id, r.n, r.k, arg_max(r2.acc, r2.n) AS last_acc, max(r2.k) AS last_k FROM r JOIN r r2 ON r2.book_id = r.book_id GROUP BY ALL),
g AS (SELECT o.book_id, o.idx, o.words, CASE WHEN f.k = f.last_k AND f.last_acc < 300 AND f.last_k > 0 THEN f.k - 1 ELSE f.k END AS k FROM o JOIN f ON f.book_id = o.book_id AND f.n = o.n)
SELECT book_id, CAST(k AS INTEGER) AS section, CAST(min(idx) AS INTEGER) AS first, CAST(count(*) AS INTEGER) AS parts, CAST(sum(words) AS BIGINT) AS words FROM g GROUP BY book_id, k""")  # fmt: skip
def absorb_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.absorb_small(sections(spark, sf_dir), "book_id", "idx", "words", 300)


@register("pack_units", f"""WITH RECURSIVE {CH}, o AS (SELECT *, CAST(words / 2 AS BIGINT) AS b0, CAST(floor(words / 2) AS BIGINT) AS b, row_number() OVER (PARTITION BY book_id ORDER BY idx) AS n FROM c),
r AS (SELECT book_id, idx, n, 0 AS u, CAST(words AS BIGINT) AS w, b, 1 AS k FROM o WHERE n = 1 UNION ALL
 SELECT o.book_id, o.idx, o.n, CASE WHEN r.w + o.words > 800 OR r.b + o.b > 1500 OR r.k >= 8 THEN r.u + 1 ELSE r.u END, CASE WHEN r.w + o.words > 800 OR r.b + o.b > 1500 OR r.k >= 8 THEN o.words ELSE r.w + o.words END,
 CASE WHEN r.w + o.words > 800 OR r.b + o.b > 1500 OR r.k >= 8 THEN o.b ELSE r.b + o.b END, CASE WHEN r.w + o.words > 800 OR r.b + o.b > 1500 OR r.k >= 8 THEN 1 ELSE r.k + 1 END FROM r JOIN o ON o.book_id = r.book_id AND o.n = r.n + 1)
SELECT book_id, idx, CAST(u AS INTEGER) AS unit FROM r""")  # fmt: skip
def pack_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections(spark, sf_dir).withColumn("budget", F.floor(F.col("words") / 2))
    return B.pack_units(s, "book_id", "idx", "words", "budget", 800)


@register("merge_sections", f"""WITH RECURSIVE {CH}, g AS (SELECT book_id, list(struct_pack(f := idx, p := 1, w := CAST(words AS BIGINT)) ORDER BY idx, words) AS s FROM c GROUP BY book_id),
r AS (SELECT book_id, s FROM g UNION ALL SELECT book_id, list_concat(list_concat(s[1:k - 1], [struct_pack(f := s[k].f, p := s[k].p + s[k + 1].p, w := s[k].w + s[k + 1].w)]), s[k + 2:]) FROM
 (SELECT *, list_position(sums, list_min(sums)) AS k FROM (SELECT *, list_transform(range(1, len(s)), lambda i: s[i].w + s[i + 1].w) AS sums FROM r WHERE len(s) > 2))),
d AS (SELECT book_id, arg_min(s, len(s)) AS s FROM r GROUP BY book_id), u AS (SELECT book_id, s, unnest(range(1, len(s) + 1)) AS k FROM d)
SELECT book_id, CAST(k - 1 AS INTEGER) AS section, s[k].f AS first, s[k].p AS parts, s[k].w AS words FROM u""")  # fmt: skip
def merge_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.merge_smallest(sections(spark, sf_dir), "book_id", "idx", "words", 2)


SQ = "list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"


@register("signal_levels", f"""SELECT vec_id, round(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS peak, round(sqrt({SQ} / len(embedding)), 6) AS rms, round(20 * log10(greatest(sqrt({SQ} / len(embedding)), 1e-12)), 4) AS dbfs,
CAST(len(list_filter(embedding, lambda x: abs(x) > 1)) AS INTEGER) AS clipped FROM embeddings""")  # fmt: skip
def signal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(S.peak("embedding"), 6).alias("peak"), F.round(S.rms("embedding"), 6).alias("rms"), F.round(S.dbfs(S.rms("embedding")), 4).alias("dbfs"), S.clipped("embedding").alias("clipped"))


@register("signal_bounds", """WITH x AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT vec_id, CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last FROM x WHERE abs(x) > CAST(0.2 AS DOUBLE) GROUP BY vec_id""")  # fmt: skip
def signal_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", S.bounds("embedding", 0.2).alias("b")).where("b is not null").select("vec_id", "b.first", "b.last")


@register("signal_envelope", """WITH x AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
f AS (SELECT vec_id, i // 8 AS k, 10 * log10(greatest(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) / 8, 1e-12)) AS l FROM x GROUP BY ALL HAVING count(*) = 8),
g AS (SELECT vec_id, count(*) AS n, avg(l) AS level, stddev_pop(l) AS flat, list_sort(list(l)) AS s FROM f GROUP BY vec_id)
SELECT vec_id, CAST(n AS INTEGER) AS frames, round(level, 6) AS level, round(flat, 6) AS flatness, round(s[CAST(floor((n - 1) * 0.95 + 0.5) AS BIGINT) + 1] - s[CAST(floor((n - 1) * 0.1 + 0.5) AS BIGINT) + 1], 6) AS range_db FROM g""")  # fmt: skip
def signal_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.envelope(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 4)


@register("signal_pauses", """WITH x AS (SELECT vec_id, len(embedding) AS n, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
q AS (SELECT vec_id, n, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM x WHERE abs(x) < CAST(0.1 AS DOUBLE)),
r AS (SELECT vec_id, n, min(i) AS a, max(i) AS b FROM q GROUP BY vec_id, n, g HAVING max(i) - min(i) + 1 >= 2),
p AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY vec_id ORDER BY a) - 1 <= 2 THEN 0 ELSE 1 END AS new FROM r), h AS (SELECT *, sum(new) OVER (PARTITION BY vec_id ORDER BY a) AS h FROM p)
SELECT vec_id, CAST(min(a) AS INTEGER) AS first, CAST(max(b) AS INTEGER) AS last FROM h GROUP BY vec_id, n, h HAVING max(b) - min(a) + 1 >= 4 AND min(a) > 0 AND max(b) < n - 1""")  # fmt: skip
def signal_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pauses(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.1, 2, 2, 4)


@register("signal_conditioned", f"""WITH g AS (SELECT vec_id, embedding, len(embedding) AS n, least(pow(10, (-20 - 20 * log10(greatest(sqrt({SQ} / len(embedding)), 1e-12))) / 20), pow(10, -1 / 20.0) / list_max(list_transform(embedding, lambda x: abs(x)))) AS gain FROM embeddings),
x AS (SELECT vec_id, n, gain, unnest(embedding) AS x, unnest(range(n)) AS i FROM g),
y AS (SELECT vec_id, greatest(-32768, least(32767, floor(CAST(x AS DOUBLE) * gain * least(1.0, (i + 1) / 8.0, (n - i) / 8.0) * 32767 + 0.5))) AS y FROM x)
SELECT vec_id, CAST(sum(y) AS BIGINT) AS total, CAST(max(y) AS INTEGER) AS top FROM y GROUP BY vec_id""")  # fmt: skip
def signal_conditioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", S.dbfs(S.rms("embedding")).alias("db"), S.peak("embedding").alias("peak"))
    e = e.withColumn("gain", M.gain_for(-20.0, F.col("db"), F.col("peak"), 10 ** (-1 / 20)))
    pcm = e.select("vec_id", S.gain_and_fade("embedding", F.col("gain"), 8).alias("pcm"))
    return pcm.select("vec_id", F.aggregate("pcm", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("pcm").alias("top"))


@register("weighted_mode", """WITH w AS (SELECT l_returnflag, floor(l_discount * 100 / 2 + 0.5) * 2 AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)
SELECT l_returnflag, arg_max(v, struct_pack(w := w, v := -v)) AS mode FROM w GROUP BY l_returnflag""")  # fmt: skip
def weighted_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value with the most weight, the smaller of two."""
    w = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", (F.floor(F.col("l_discount") * 100 / 2 + 0.5) * 2).alias("v")).agg(F.sum("l_quantity").alias("w"))
    return w.groupBy("l_returnflag").agg(F.max_by(F.col("v").cast("double"), F.struct("w", (-F.col("v")).alias("v"))).alias("mode"))


@register("upper_median", "SELECT l_returnflag, l_linestatus, list_sort(list(l_quantity))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM lineitem GROUP BY ALL")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median from a histogram of values, so that no group is gathered into one list."""
    from pyspark.sql import Window

    h = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_quantity").agg(F.count("*").alias("c"))
    w = Window.partitionBy("l_returnflag", "l_linestatus")
    r = h.withColumn("upto", F.sum("c").over(w.orderBy("l_quantity"))).withColumn("n", F.sum("c").over(w))
    return r.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("l_returnflag", "l_linestatus").agg(F.min("l_quantity").alias("median"))


@register("conditioned_sounds", """WITH l AS (SELECT vec_id, embedding, len(embedding) AS n, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) > 0.0031622776601683794::DOUBLE) AS loud FROM embeddings),
e AS (SELECT *, list_position(loud, true) AS a, n + 1 - list_position(list_reverse(loud), true) AS b FROM l), t AS (SELECT vec_id, embedding[greatest(1, a - 3):least(n, b + 10)] AS x, a FROM e)
SELECT vec_id, CAST(CASE WHEN a > 0 THEN len(x) ELSE 0 END AS INTEGER) AS samples, CASE WHEN a > 0 THEN round(list_max(list_transform(x, lambda v: abs(CAST(v AS DOUBLE)))), 6) ELSE 0 END AS raw_peak FROM t""")  # fmt: skip
def conditioned_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as sounds of 100 samples a second, trimmed, levelled, faded and padded: how much of each is speech, and its peak."""
    c = S.conditioned(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", 100, gap=0.5)
    return c.select("vec_id", (F.floor(F.length("pcm") / 2) - 50).cast("int").alias("samples"), F.round("raw_peak", 6).alias("raw_peak"))
