"""Problem 6: evaluation passages inside training documents.

Greedy string tiling over words. Words are runs of letters and digits with case, full width, the
coding of accents and invisible characters taken away. Each word is a 64-bit polynomial hash made
by array operations; the words of the evaluation items are the vocabulary, and a document's word
outside it ends every match. Windows of ``seed`` words whose Karp-Rabin hash occurs in an item are
the seeds; a document is compared only with items it shares a seed with. There the longest common
run of unmarked words is found by Karp-Rabin over growing and shrinking window lengths, marked, and
so on until no run of ``min_tile`` words is left. The first tile is the longest common run.

A document leaks an item if the longest run has ``RUN`` words, or if its tiles cover ``COVERAGE`` of the item,
which also finds passages whose parts come in another order.

The items are broadcast in blocks of at most ``ITEM_BYTES`` of text, so their number is not bounded. The
documents are read and hashed once: a task looks a stretch of them up in one block after the other, and
keeps ``HELD_BLOCKS`` blocks ready. Documents are never shuffled.

Defined results: null and blank texts have no words and match nothing; items shorter than the seed
match nothing; repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.codepoints import batches, to_codepoints
from quillmill.llm.normalise import TOP, normalise_codes

#: Text of evaluation items held by a task at once.
ITEM_BYTES = 8_000_000
#: Blocks of items that a task keeps ready, and batches of documents that it looks up in each block in turn.
HELD_BLOCKS, STRETCH = 3, 8
#: Words in a row, or share of an item in tiles, from which a document leaks the item.
RUN, COVERAGE = 12, 0.5
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@lru_cache(1)
def _alnum() -> np.ndarray:
    flags = np.zeros(TOP + 1, bool)
    for c in range(TOP):
        ch = chr(c)
        flags[c] = ch.isalnum() or c >= 0x300 and unicodedata.category(ch)[0] == "M"
    flags[TOP] = True
    return flags


@lru_cache(4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.cumprod(np.full(n - 1, base, np.uint64))
    return out


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for reuse."""
    return _powers(1 << max(12, int(n).bit_length()), int(base))[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all rows in a row, and the n+1 offsets of the rows."""
    codes, offsets = normalise_codes(*to_codepoints(arr), look=False, fold=True)
    if not len(codes):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = _alnum()[np.minimum(codes, TOP)]
    edge = np.zeros(len(codes) + 1, bool)
    edge[offsets] = True  # a word doesn't go on in the next row
    start = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]) | word & edge[:-1])
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(word)
    counts = np.diff(np.concatenate([np.searchsorted(at, start), [len(at)]]))
    pos = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        terms = mix(codes[at].astype(np.uint64) + np.uint64(1)) * powers(int(pos.max()) + 1)[pos]
        hashes = mix(np.add.reduceat(terms, np.cumsum(counts) - counts) + counts.astype(np.uint64))
    return hashes, np.searchsorted(start, offsets)


def windows(ids: np.ndarray, k: int) -> np.ndarray:
    """The Karp-Rabin hash of every run of ``k`` ids, for any ``k``, from one running sum."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64)) * powers(len(ids), INVERSE))])
        return (run[k:] - run[:n]) * powers(n)


def _longest(a: np.ndarray, b: np.ndarray, least: int) -> tuple[int, int, int]:
    """Start in ``a``, start in ``b`` and length of the longest common run; length 0 below ``least``."""

    def common(k: int) -> tuple[int, int] | None:
        ha, hb = windows(a, k), windows(b, k)
        hit = np.flatnonzero(np.isin(hb, ha))
        for j in hit:
            for i in np.flatnonzero(ha == hb[j]):
                if np.array_equal(a[i : i + k], b[j : j + k]):
                    return int(i), int(j)
        return None

    best, lo, k = (0, 0, 0), least, least
    hi = min(len(a), len(b))
    while k <= hi and (found := common(k)):  # grow
        best, lo, k = (*found, k), k + 1, k * 2
    hi = min(hi, k - 1)
    while best[2] and lo <= hi:  # shrink between the last two
        k = (lo + hi) // 2
        if found := common(k):
            best, lo = (*found, k), k + 1
        else:
            hi = k - 1
    return best


def tile(item: np.ndarray, doc: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, words), longest first."""
    a, b, out = item.astype(np.int64), doc.astype(np.int64), []
    unique = -1
    while True:
        i, j, n = _longest(a, b, min_tile)
        if not n:
            return out
        out.append((i, j, n))
        a[i : i + n] = unique - 2 * np.arange(n)
        b[j : j + n] = unique - 1 - 2 * np.arange(n)
        unique -= 2 * n


class Items:
    """A block of evaluation items, ready to be matched against documents."""

    def __init__(self, ids: list[int], texts: list[str], seed: int) -> None:
        self.ids, self.seed = ids, seed
        hashes, offsets = word_hashes(pa.array(texts, pa.string()))
        self.vocabulary = np.unique(hashes)
        codes = self.code(hashes)
        self.words = [codes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        owners = defaultdict(set)
        for n, w in enumerate(self.words):
            for h in windows(w, seed).tolist():
                owners[h].add(n)
        self.seeds = np.array(sorted(owners), np.uint64)
        self.owners = owners

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """1.. for words of the items, 0 for all others."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def candidates(self, codes: np.ndarray, offsets: np.ndarray) -> dict[int, set[int]]:
        """For each row the items it shares a seed with."""
        out: dict[int, set[int]] = defaultdict(set)
        n = len(codes) - self.seed + 1
        if n <= 0 or not len(self.seeds):
            return out
        bad = np.concatenate([[0], np.cumsum(codes == 0)])
        ok = np.flatnonzero(bad[self.seed :] == bad[:n])
        row = np.searchsorted(offsets, ok, "right") - 1
        ok = ok[ok + self.seed <= offsets[row + 1]]
        h = windows(codes, self.seed)[ok]
        at = np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)
        hit = self.seeds[at] == h
        for r, k in set(zip((np.searchsorted(offsets, ok[hit], "right") - 1).tolist(), h[hit].tolist())):
            out[r] |= self.owners[k]
        return out


def leaks(documents: DataFrame, items: DataFrame, seed: int = 8, min_tile: int | None = None, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, doc_id, longest, n_tiles, matched, item_words, coverage, leaked) of every document that shares a seed with an item."""
    least = min_tile or seed
    spark = documents.sparkSession
    items = items.select(item_id, text).where(F.col(text).isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, math.ceil(size / ITEM_BYTES))
    names = ("item_id", "doc_id", "longest", "n_tiles", "matched", "item_words", "coverage", "leaked")
    schema = f"item_id {dict(items.dtypes)[item_id]}, doc_id {dict(documents.dtypes)[doc_id]}, longest int, n_tiles int, matched int, item_words int, coverage double, leaked boolean"
    wanted = _arrow_schema(spark, schema)
    shared = []
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64(item_id, text), F.lit(blocks)) == k).orderBy(item_id, text).collect()
        shared.append(spark.sparkContext.broadcast(([r[0] for r in block], [r[1] for r in block])))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(HELD_BLOCKS)
        def held(k: int) -> Items:
            return Items(*shared[k].value, seed)

        def look_up(waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for k in range(blocks):
                rows = []
                for keys, hashes, offsets in waiting:
                    codes = held(k).code(hashes)
                    for r, owners in held(k).candidates(codes, offsets).items():
                        for n in owners:
                            words = held(k).words[n]
                            tiles = tile(words, codes[offsets[r] : offsets[r + 1]], least)
                            if tiles:
                                matched = sum(t[2] for t in tiles)
                                cover = matched / len(words)
                                rows.append((held(k).ids[n], keys[r].as_py(), tiles[0][2], len(tiles), matched, len(words), cover, tiles[0][2] >= RUN or cover >= COVERAGE))
                if rows:
                    yield pa.RecordBatch.from_pydict({c: [x[i] for x in rows] for i, c in enumerate(names)}, schema=wanted)

        waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        for batch in batches(it, text):
            waiting.append((batch.column(0), *word_hashes(batch.column(1))))
            if len(waiting) >= STRETCH or blocks <= HELD_BLOCKS:
                yield from look_up(waiting)
                waiting = []
        yield from look_up(waiting)

    docs = documents.select(doc_id, text).where(F.col(text).isNotNull())
    return docs.mapInArrow(run, schema).distinct()


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
