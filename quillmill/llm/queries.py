"""The pN_ queries of the training-data problems and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import chunking, leaks, mixing, normalise, packing, quality, scans, spans
from quillmill.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.same_look_pairs(table(spark, sf_dir, "books"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.look_classes(table(spark, sf_dir, "books"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.oversized_items(chunking.items_with_limits(spark, sf_dir)).select("field", "owner", "item_no", "piece_no").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.oversized_items(chunking.items_with_limits(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of which a second part was put into a container."""
    return packing.chapter_containers(spark, sf_dir).where("part > 0 and container is not null").select("book_id", "idx").distinct()


def p3_chapter_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.chapter_containers(spark, sf_dir)


def p3_piece_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_containers(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_faults(spark, sf_dir)


def p4_mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.mended_books(spark, sf_dir)


def p4_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.clean_titles(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.text_quality(table(spark, sf_dir, "books"), table(spark, sf_dir, "outline_entries"))
    return stats.where(F.col("shape").isin("list", "table", "junk")).select("book_id", "shape").distinct()


def p5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_quality(table(spark, sf_dir, "books"), table(spark, sf_dir, "outline_entries"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), seed=12)
    return tiles.where("longest >= 12").select("item_id", "doc_id").distinct()


def p6_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), seed=8)


def p7_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, sf_dir)[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents"), 400).select("doc_id").distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents"), 400)


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_classes": p1_classes, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_chapter_containers": p3_chapter_containers, "p3_piece_containers": p3_piece_containers, "p4_found": p4_found, "p4_mended": p4_mended, "p4_titles": p4_titles, "p5_found": p5_found, "p5_quality": p5_quality, "p6_found": p6_found, "p6_tiles": p6_tiles, "p7_chosen": p7_chosen, "p7_report": p7_report, "p8_found": p8_found, "p8_spans": p8_spans}

def _form_sql(x: str, look: bool = True) -> str:
    """The consistent form in SQL: characters of no width out, single characters replaced, composition by the database."""
    import unicodedata

    swap = {}
    for c in [*range(0x80, 0x3100), *range(0xAB30, 0xABC0), *range(0xFE00, 0xFFF0), *range(0x13A0, 0x1400)]:
        to = unicodedata.normalize("NFC", normalise._plain(chr(c), look))
        if len(to) == 1 and to != chr(c) and not any(a <= c <= b for a, b in normalise.NO_WIDTH):
            swap[chr(c)] = to
    hidden = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in normalise.NO_WIDTH if a != 0xAD) + "\\x{e0100}-\\x{e01ef}"
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    # a soft hyphen at the end of a line shows
    soft = f"regexp_replace(regexp_replace(regexp_replace({x}, '[{hidden}]', '', 'g'), '\\x{{ad}}(\\n|$)', chr(1) || '\\1', 'g'), '\\x{{ad}}', '', 'g')"
    return f"nfc_normalize(translate(replace({soft}, chr(1), chr(173)), {quote(''.join(swap))}, {quote(''.join(swap.values()))}))"


SQL: dict[str, str] = {
    "p1_found": f"""
WITH b AS (SELECT DISTINCT book_id, text FROM books WHERE text IS NOT NULL AND book_id IS NOT NULL), f AS (SELECT book_id, md5(text) AS raw, md5({_form_sql('text')}) AS form FROM b)
SELECT DISTINCT least(x.book_id, y.book_id) AS book_id_a, greatest(x.book_id, y.book_id) AS book_id_b FROM f x JOIN f y ON x.form = y.form AND x.raw < y.raw AND x.book_id <> y.book_id""",
    "p3_found": """
WITH lim AS (SELECT max_size FROM size_limits WHERE limit_name = 'chapter_container'),
c AS (SELECT DISTINCT book_id, idx, line_idx, word_count FROM chapters),
n AS (SELECT c.*, (SELECT min(d.line_idx) FROM c d WHERE d.book_id = c.book_id AND d.line_idx > c.line_idx) AS nxt FROM c WHERE word_count IS NULL),
b AS (SELECT book_id, arg_max(text, uploaded_at) AS text FROM books GROUP BY book_id),
w AS (SELECT book_id, idx, len(list_filter(regexp_split_to_array(array_to_string(list_slice(string_split(text, chr(10)), line_idx + 1, nxt), chr(10)), '[\\s\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '')) AS size
      FROM (SELECT book_id, idx, line_idx, coalesce(nxt, 1000000000) AS nxt FROM n) JOIN b USING (book_id)),
s AS (SELECT book_id, idx, word_count AS size FROM c WHERE word_count IS NOT NULL UNION ALL SELECT book_id, idx, size FROM w)
SELECT DISTINCT book_id, idx FROM s, lim WHERE size > max_size""",
    "p6_found": f"""
WITH i AS (SELECT DISTINCT item_id, text FROM eval_items WHERE text IS NOT NULL), d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower({_form_sql('text', False)}), '[\\p{{L}}\\p{{N}}\\p{{M}}]+') AS w FROM i), dw AS (SELECT doc_id, regexp_extract_all(lower({_form_sql('text', False)}), '[\\p{{L}}\\p{{N}}\\p{{M}}]+') AS w FROM d),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM iw WHERE len(w) >= 12)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM dw WHERE len(w) >= 12))
SELECT DISTINCT item_id, doc_id FROM ig JOIN dg ON ig.g = dg.g""",
    "p8_found": """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 400), k AS (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM d),
w AS (SELECT doc_id, hash(substring(text, i, 400)) AS h FROM k), s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id))
SELECT DISTINCT doc_id FROM w WHERE h IN (SELECT h FROM s)""",
    "p2_found": """
WITH lim AS (SELECT max_size FROM size_limits WHERE limit_name = 'book_line'),
v AS (SELECT voice_id, max(max_chars) AS m FROM voices GROUP BY voice_id),
p AS (SELECT job_key, i, voice_id, unnest(pieces) AS t, unnest(range(len(pieces))) AS n FROM chunks WHERE pieces IS NOT NULL),
l AS (SELECT book_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS n FROM books WHERE text IS NOT NULL)
SELECT DISTINCT 'pieces' AS field, job_key AS owner, i AS item_no, CAST(n AS INTEGER) AS piece_no FROM p JOIN v USING (voice_id) WHERE length(t) > m
UNION
SELECT DISTINCT 'text', book_id, CAST(n AS INTEGER), -1 FROM l, lim WHERE length(t) > max_size""",
}
