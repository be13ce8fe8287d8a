"""Problem 1: one consistent form of text that looks the same.

Arrow text becomes one flat code-point array. Characters of no width go, every character is
replaced by its canonical pieces through lookup tables and expansion offsets, full-width forms,
non-breaking spaces and look-alike letters of other scripts are gathered from a table, marks are
put in canonical order and composed again, all as array operations over the whole batch.
Raised figures, ligatures, case and accents stay as they are.

Defined results: null stays null, the empty text stays empty, texts that are already in the form
come back unchanged, extra columns are kept (a clash with the new column's name raises ValueError).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.codepoints import batches, row_of, to_arrow, to_codepoints
from quillmill.session import cut

#: Code points above this have no entry in the tables.
TOP = 0x30000

# Characters of no width (Unicode), as inclusive ranges.
NO_WIDTH = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF)]

# Letters of other scripts with the shape of a Latin letter, and that letter.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j",
    "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ү": "y", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "Ӏ": "I", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Armenian
    "Ս": "U", "Օ": "O", "ս": "u", "օ": "o", "հ": "h", "ո": "n", "ց": "g", "զ": "q",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}


def _plain(ch: str, look: bool = True, fold: bool = False) -> str:
    """The character without full width or the ban on a line break, canonical pieces apart.

    look: letters of other scripts in Latin shape. fold: without case.
    """
    kind, _, pieces = unicodedata.decomposition(ch).partition(" ")
    if kind in ("<wide>", "<noBreak>"):
        ch = "".join(chr(int(x, 16)) for x in pieces.split())
    ch = unicodedata.normalize("NFD", ch)
    if fold:
        ch = unicodedata.normalize("NFD", ch.casefold())
    return "".join(LOOK_ALIKES.get(x, x) for x in ch) if look else ch


class Tables:
    """Lookup tables made by rule from the Unicode data: expansions, mark classes, compositions."""

    def __init__(self, look: bool = True, fold: bool = False) -> None:
        self.fold = fold
        hangul = range(0xAC00, 0xD7A4)
        self.start, self.length = np.zeros(TOP + 1, np.int64), np.ones(TOP + 1, np.uint8)
        pool = list(range(TOP + 1))
        self.start[:] = np.arange(TOP + 1)
        self.ccc, self.drop = np.zeros(TOP + 1, np.uint8), np.zeros(TOP + 1, bool)
        for a, b in NO_WIDTH:
            self.drop[a : b + 1] = True
        self.drop[TOP] = False
        pairs = {}
        for c in range(0x41 if fold else 0x80, TOP):
            if 0x3400 <= c < 0xA000 or c in hangul or 0xD800 <= c < 0xF900 or 0x17000 <= c < 0x1B000 or 0x20000 <= c < 0x2F800:
                continue
            ch = chr(c)
            self.ccc[c] = unicodedata.combining(ch)
            if (fold or unicodedata.decomposition(ch) or ch in LOOK_ALIKES) and (to := _plain(ch, look, fold)) != ch:
                self.start[c], self.length[c] = len(pool), len(to)
                pool += map(ord, to)
            d = unicodedata.decomposition(ch).split()
            if len(d) == 2 and d[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
                pairs[int(d[0], 16) << 21 | int(d[1], 16)] = c
        self.pool = np.array(pool, np.uint32)
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in sorted(pairs)], np.uint32)

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The composition of each pair, 0 where there is none."""
        key = a.astype(np.int64) << 21 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out = np.where(self.keys[at] == key, self.values[at], 0)
        a, b = a.astype(np.int64), b.astype(np.int64)
        lead = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        tail = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        out = np.where(lead, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, out)
        return np.where(tail, a + b - 0x11A7, out).astype(np.uint32)


@lru_cache(4)
def tables(look: bool = True, fold: bool = False) -> Tables:
    return Tables(look, fold)


def normalise_codes(codes: np.ndarray, offsets: np.ndarray, look: bool = True, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of flat code points, with the new row offsets."""
    if not len(codes) or not fold and codes.max() < 0x80:
        return codes, offsets
    t = tables(look, fold)
    row = row_of(offsets)
    low = np.minimum(codes, TOP)
    gone = t.drop[low] | ((codes >= 0xE0100) & (codes < 0xE01F0))
    soft = np.flatnonzero(codes == 0xAD)
    if len(soft):  # at the end of a line a soft hyphen shows
        nxt = np.minimum(soft + 1, len(codes) - 1)
        gone[soft] = ~((soft + 1 == len(codes)) | (codes[nxt] == 10) | (row[nxt] != row[soft]))
    keep = ~gone
    if not keep.all():
        codes, row, low = codes[keep], row[keep], low[keep]
    n = t.length[low]
    first = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    flat = np.arange(first[-1]) - np.repeat(first[:-1], n) if (n != 1).any() else 0
    src = np.repeat(t.start[low], n) + flat
    big = np.repeat(low == TOP, n)
    out = t.pool[np.minimum(src, len(t.pool) - 1)]
    out[big] = np.repeat(codes, n)[big]
    row = np.repeat(row, n)
    out, row = _compose(out, row, t)
    counts = np.bincount(row, minlength=len(offsets) - 1) if len(row) else np.zeros(len(offsets) - 1, np.int64)
    return out, np.concatenate([[0], np.cumsum(counts)])


def _compose(codes: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order of the marks, then composition of each base with its marks in turn."""
    ccc = t.ccc[np.minimum(codes, TOP)]
    mark = ccc > 0
    gone = np.zeros(len(codes), bool)
    if mark.any():
        new_row = np.concatenate([[True], row[1:] != row[:-1]])
        base = np.cumsum(~mark | new_row) - 1  # a mark at the start of a row is its own base
        head = np.flatnonzero(~mark | new_row)
        at = np.flatnonzero(mark)
        order = np.lexsort((at, ccc[at], base[at]))
        codes = codes.copy()
        codes[at] = codes[at[order]]
        ccc[at] = ccc[at[order]]
        at = at[~new_row[at]]
        b = base[at]
        nth = at - head[b]
        blocked = np.zeros(len(head), np.int16)
        for k in range(1, int(nth.max(initial=0)) + 1):
            pick = at[nth == k]
            if not len(pick):
                break
            h = base[pick]
            made = t.compose(codes[head[h]], codes[pick])
            ok = (made > 0) & (ccc[pick] > blocked[h]) & ~mark[head[h]]
            codes[head[h[ok]]] = made[ok]
            gone[pick[ok]] = True
            blocked[h[~ok]] = ccc[pick[~ok]]
    if gone.any():
        codes, row = codes[~gone], row[~gone]
    # pairs of bases: the vowel signs and syllables that some scripts write so
    while True:
        second = np.flatnonzero(codes[1:] >= 0x900) + 1
        if len(second):
            made = t.compose(codes[second - 1], codes[second])
            ok = (made > 0) & (row[second - 1] == row[second])
            second, made = second[ok], made[ok]
        if not len(second):
            return codes, row
        single = np.concatenate([[True], np.diff(second) > 1])
        second, made = second[single], made[single]
        codes = codes.copy()
        codes[second - 1] = made
        codes, row = np.delete(codes, second), np.delete(row, second)


def normalise_arrow(arr: pa.Array) -> pa.Array:
    """The consistent form of a string array."""
    null = arr.is_null().to_numpy(zero_copy_only=False)
    codes, offsets = normalise_codes(*to_codepoints(arr))
    return to_arrow(codes, offsets, null)


def normalise_text(df: DataFrame, column: str = "text", into: str = "text_norm") -> DataFrame:
    """``df`` with the consistent form of ``column`` in the new column ``into``."""
    if into in df.columns:
        raise ValueError(f"there is a column {into} already")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, column):
            yield pa.RecordBatch.from_arrays([*batch.columns, normalise_arrow(batch.column(column))], names=[*batch.schema.names, into])

    return df.mapInArrow(run, df.withColumn(into, F.lit(None).cast("string")).schema)


def same_look_pairs(df: DataFrame, key: str = "book_id", column: str = "text") -> DataFrame:
    """Pairs of different keys whose texts differ in code points but share the consistent form.

    Only digests travel: (key, digest of the text, digest of its form). Repeated rows count once,
    null keys and texts have no pair. Forms with a single spelling are dropped before the join, so a
    large group of exact copies never reaches it; the pairs of two spellings are as many as their rows multiplied,
    which is the result asked for (``look_classes`` gives one row per text instead).
    """
    digests = (
        normalise_text(df.select(key, column).where(F.col(key).isNotNull() & F.col(column).isNotNull()), column, "__form")
        .select(F.col(key).alias("k"), F.md5(column).alias("raw"), F.md5("__form").alias("form"))
        .distinct()
    )
    digests = cut(digests)  # else the texts would be normalised once for the forms and again for the pairs
    spelt = digests.select("form", "raw").distinct()
    forms = spelt.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    several = spelt.join(forms, "form", "left_semi")
    # spellings are paired, not rows; the rows of a spelling come in last, by its own digest
    a, b = several.select("form", F.col("raw").alias("raw_a")), several.select("form", F.col("raw").alias("raw_b"))
    spellings = a.join(b, "form").where("raw_a < raw_b").select("raw_a", "raw_b")
    ids = lambda c: digests.select(F.col("raw").alias(f"raw_{c}"), F.col("k").alias(f"k_{c}")).distinct()
    both = spellings.join(ids("a"), "raw_a").join(ids("b"), "raw_b").where("k_a <> k_b")
    return both.select(F.least("k_a", "k_b").alias(f"{key}_a"), F.greatest("k_a", "k_b").alias(f"{key}_b")).distinct()


def look_classes(df: DataFrame, key: str = "book_id", column: str = "text") -> DataFrame:
    """(key, class_id, n_forms): the class of texts that look alike and how many spellings it has."""
    digests = normalise_text(df.select(key, column).where(F.col(column).isNotNull()), column, "__form").select(key, F.md5(column).alias("raw"), F.md5("__form").alias("class_id")).distinct()
    spellings: Column = F.count("*").alias("n_spellings")
    count = digests.select("class_id", "raw").distinct().groupBy("class_id").agg(spellings)
    return digests.join(count, "class_id").select(key, "class_id", "n_spellings")
