"""Sentences and chunks.

A boundary is decided from the text on both sides of it alone. ``sentences`` does so inside an expression,
for short texts; the table operators take whole texts, one Arrow batch after the other, find the boundaries
with one pass of a regular expression, and fold sentences into chunks while they are at it. Texts are not
shuffled, nothing is gathered again, and the work is linear in the length of a text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillmill.functions.text import ABBREVIATIONS, HEADING_WORD, WS, WS_CHARS, col, trim

CUT = "\x01"
SEGMENT = rf"((?s).*?[.!?]+[\"'’)\]]*{WS}+|(?s).+\z)"
END_RUN = r"([.!?]+)[\"'’)\]]*\z"


def _ends(segment: Column, following: Column) -> Column:
    """Whether a sentence ends with ``segment``."""
    body = F.regexp_replace(segment, f"{WS}+\\z", "")
    mark = F.regexp_extract(body, END_RUN, 1)
    core = F.regexp_replace(body, END_RUN, "")
    bare = F.lower(F.regexp_replace(F.regexp_extract(core, f"([^{WS[1:-1]}]*)\\z", 1), "[^A-Za-z]", ""))
    digits = core.rlike(r"\d\z") & following.rlike(r"^\d")
    short = bare.isin(ABBREVIATIONS) | (F.length(bare) == 1)
    return (mark != "") & ~((mark == ".") & (digits | short)) & following.rlike("^[\"'“‘(\\[A-Z0-9]")


def sentences(c: Column | str) -> Column:
    """The sentences of a text, trimmed, blanks left out; none for blank or empty text."""
    text = F.translate(col(c), CUT, " ")
    seg = F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(1))
    following = F.slice(seg, F.lit(2), F.greatest(F.size(seg) - 1, F.lit(0)))  # a lambda that named seg would compute it anew for each element
    marked = F.zip_with(seg, following, lambda s, n: F.when(n.isNotNull() & _ends(s, n), F.concat(s, F.lit(CUT))).otherwise(s))
    parts = F.transform(F.split(F.array_join(marked, ""), CUT), trim)
    return F.filter(parts, lambda s: s != "")


def paragraphs(c: Column | str) -> Column:
    """The blocks between blank lines, trimmed, blanks left out."""
    return F.filter(F.transform(F.split(col(c), "\n{2,}"), trim), lambda p: p != "")


BOUNDARY = re.compile(f"([.!?]+)[\"'’)\\]]*{WS}+")
LAST_WORD = re.compile(f"[^{WS[1:-1]}]*\\Z")
OPENER = re.compile("[\"'“‘(\\[A-Z0-9]")
PARAGRAPH = re.compile("\n{2,}")
HEADING = re.compile(HEADING_WORD, re.ASCII)
WORDS = re.compile(f"[^{WS[1:-1]}]+")
CLAUSE = re.compile(f"(?<=[,;:]){WS}+")
SHORT = frozenset(ABBREVIATIONS)
ASCII_DIGITS = frozenset("0123456789")


def sentence_list(text: str) -> list[str]:
    """The sentences of a text as ``sentences`` gives them."""
    text = text.replace(CUT, " ")
    out, start, n, seg = [], 0, len(text), 0
    for m in BOUNDARY.finditer(text):
        end = m.end()
        begin, seg = seg, end
        if end == n or not OPENER.match(text, end):
            continue
        if m[1] == ".":
            at = m.start()
            if at > begin and text[at - 1] in ASCII_DIGITS and text[end] in ASCII_DIGITS:
                continue
            k = at
            while k > begin and text[k - 1] not in WS_CHARS:
                k -= 1
            bare = "".join(c for c in text[k:at] if c.isascii() and c.isalpha()).lower()
            if len(bare) == 1 or bare in SHORT:
                continue
        if x := text[start:end].strip(WS_CHARS):
            out.append(x)
        start = end
    if x := text[start:].strip(WS_CHARS):
        out.append(x)
    return out


def paragraph_list(text: str) -> list[str]:
    return [x for p in PARAGRAPH.split(text) if (x := p.strip(WS_CHARS))]


def word_count(text: str) -> int:
    return len(WORDS.findall(text))


def clean_end(text: str) -> str:
    """Ends on a sentence mark, as ``end_cleanly`` has it."""
    t = text.strip(WS_CHARS)
    if not t or re.search("[.!?][\"'’”)\\]]?\\Z", t):
        return t
    return re.sub(r"[,;:]+\Z", "", t) + "."


def per_text(df: DataFrame, key: str, text: str, fields: str, rows: Callable[[str], list[tuple]]) -> DataFrame:
    """(key, fields): the rows that ``rows`` makes of each text; none for null texts. No shuffle."""
    schema = f"{key} {dict(df.dtypes)[key]}, {fields}"
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys, at = [], 0
            cols: list[list] = [[] for _ in wanted.names[1:]]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in rows(t):
                    keys.append(k)
                    for c, v in zip(cols, row):
                        c.append(v)
                if len(keys) - at > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([keys, *cols], wanted)], schema=wanted)
                    keys, cols = [], [[] for _ in cols]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([keys, *cols], wanted)], schema=wanted)

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, schema)


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, para_idx, sent_idx, sentence, words) of every text."""

    def rows(t: str) -> list[tuple]:
        return [(n, i, x, word_count(x)) for n, p in enumerate(paragraph_list(t)) for i, x in enumerate(sentence_list(p))]

    return per_text(df, key, text, "para_idx int, sent_idx int, sentence string, words int", rows)


def chunks_of(text: str, limit: int) -> list[tuple[str, int]]:
    """(text, chapter) of each chunk."""
    packs: list[tuple[list[str], int]] = []
    chapter, size = 0, 0
    for n, p in enumerate(paragraph_list(text)):
        chapter += n > 0 and 3 <= len(p) <= 80 and bool(HEADING.match(p))
        for s in sentence_list(p):
            w = word_count(s)
            if not packs or packs[-1][1] != chapter or size + w > limit:
                packs.append(([], chapter))
                size = 0
            packs[-1][0].append(s if s[-1] in ".!?,;:" else s + ".")
            size += w
    return [(clean_end(" ".join(x)), c) for x, c in packs]


def _chunk_rows(chunks: list[tuple[str, int]]) -> list[tuple]:
    follows = [c for _, c in chunks[1:]]
    return [(i, t, c, i < len(follows) and follows[i] > c, word_count(t)) for i, (t, c) in enumerate(chunks)]


CHUNK = "i int, text string, chapter_index int, ends_chapter boolean, words int"


def chunk_table(df: DataFrame, key: str, text: str, limit: int = 300) -> DataFrame:
    """(key, i, text, chapter_index, ends_chapter, words): sentences packed to ``limit`` words.

    A paragraph that opens like a chapter starts a new chapter and a new chunk; a longer sentence
    stands alone; a sentence without a closing mark gets a full stop; the last chunk never ends a
    chapter. Blank and null texts have no chunk.
    """
    return per_text(df, key, text, CHUNK, lambda t: _chunk_rows(chunks_of(t, limit)))


def chunk_lead(df: DataFrame, key: str, text: str, limit: int = 60, lead: int = 25) -> DataFrame:
    """The chunk table with its first chunk cut again to ``lead`` words, so that reading can start soon."""

    def rows(t: str) -> list[tuple]:
        made = _chunk_rows(chunks_of(t, limit))
        if not made or made[0][4] <= lead:
            return made
        _, first, chapter, ends, _ = made[0]
        led = chunks_of(first, lead)
        short = [(k, x, chapter, ends and k == len(led) - 1, word_count(x)) for k, (x, _) in enumerate(led)]
        return short + [(r[0] + len(short) - 1, *r[1:]) for r in made[1:]]

    return per_text(df, key, text, CHUNK, rows)


def packed(parts: list[str], limit: int) -> list[str]:
    """Parts joined by single blanks while the result stays within ``limit`` characters."""
    out: list[list[str]] = []
    size = 0
    for x in parts:
        if out and size + 1 + len(x) <= limit:
            out[-1].append(x)
            size += 1 + len(x)
        else:
            out.append([x])
            size = len(x)
    return [" ".join(x) for x in out]


def pack_parts(df: DataFrame, keys: list[str], parts: str, limit: int) -> DataFrame:
    """(keys, pack, packed): the parts of each row's array packed; null and empty arrays have none."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", pack int, packed string"
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = [packed(x or [], limit) for x in batch.column(len(keys)).to_pylist()]
            take = pa.array([r for r, x in enumerate(made) for _ in x], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(take) for n in range(len(keys))), pa.array([n for x in made for n in range(len(x))], pa.int32()), pa.array([t for x in made for t in x], pa.string())], schema=wanted)

    return df.select(*keys, parts).mapInArrow(run, schema)


def capped_pieces(df: DataFrame, key: str, text: str, limit: int = 400) -> DataFrame:
    """(key, piece_no, piece) within ``limit`` characters: sentences packed; longer ones by clauses, then
    words, then by force. Blank and null texts have no piece."""

    def rows(t: str) -> list[tuple]:
        t = t.strip(WS_CHARS)
        if len(t) <= limit:
            return [(0, t)] if t else []
        parts: list[str] = []
        for s in sentence_list(t):
            for c in [s] if len(s) <= limit else CLAUSE.split(s):
                for w in [c] if len(c) <= limit else WORDS.findall(c):
                    parts += [w[k : k + limit] for k in range(0, len(w), limit)]
        return list(enumerate(packed(parts, limit)))

    return per_text(df, key, text, "piece_no int, piece string", rows)
