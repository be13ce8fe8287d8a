"""Problem 2: cutting oversized items at natural boundaries.

Recursive bisection: a stretch that exceeds the limit minus the overlap is cut at the strongest
boundary near its midpoint (sentence end, clause end, word end), both halves are treated alike, and
at last each piece gets the overlap of the piece before it in front. The cores of the pieces tile
the text, so joining them without the overlaps gives the text back.

Nothing stands before the first piece, so it may fill the limit, and it is never shorter than the
overlap; so every later piece repeats the whole stated overlap.

Defined results: null text or limit and texts within the limit are one piece as they are (null text:
a null piece); a limit below 1 counts as 1; an overlap of the limit or more counts as one less than
the limit, as each piece must get on by a character; a text without any boundary is cut in the
middle, but not before a combining mark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.codepoints import batches, row_of, to_codepoints
from quillmill.session import table

ENDS = np.array([ord(c) for c in ".!?…"], np.uint32)
CLAUSES = np.array([ord(c) for c in ",;:–—"], np.uint32)
CLOSERS = np.array([ord(c) for c in "\"'’”»)]“"], np.uint32)
WIDE_ENDS = np.array([ord(c) for c in "。！？"], np.uint32)
SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def boundary_strength(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each position the strength of a cut before it: 3 sentence, 2 clause, 1 word, 0 none, -1 never."""
    n = len(codes)
    out = np.zeros(n, np.int8)
    if not n:
        return out
    space = np.isin(codes, SPACES)
    # the last character that is neither white space nor a closing mark, for every position
    idx = np.arange(n)
    solid = np.maximum.accumulate(np.where(~space & ~np.isin(codes, CLOSERS), idx, -1))
    last = np.maximum.accumulate(np.where(~space, idx, -1))
    after = np.flatnonzero(space[:-1] & ~space[1:]) + 1  # cut behind the run of white space
    s, e = solid[after - 1], last[after - 1]
    first = offsets[:-1][row_of(offsets)[after]]
    strength = np.ones(len(after), np.int8)
    strength[(e >= first) & np.isin(codes[np.maximum(e, 0)], CLAUSES)] = 2
    strength[(s >= first) & np.isin(codes[np.maximum(s, 0)], ENDS)] = 3
    out[after] = strength
    wide = np.flatnonzero(np.isin(codes[:-1], WIDE_ENDS)) + 1
    out[wide] = 3
    out[((codes >= 0x300) & (codes < 0x370)) | ((codes >= 0x200C) & (codes <= 0x200D)) | ((codes >= 0xFE00) & (codes < 0xFE10))] = -1
    return out


def overlap_within(limit: int, overlap: int) -> int:
    """The stated overlap, or what leaves a piece of ``limit`` one character of its own."""
    return max(0, min(overlap, limit - 1))


def bisect(strength: np.ndarray, limit: int, overlap: int) -> list[int]:
    """The cuts, first 0 and last the length: the first core is at most ``limit`` long, the others ``limit - overlap``."""
    n = len(strength)
    limit = max(1, limit)
    if n <= limit:
        return [0, n]
    least = max(1, overlap_within(limit, overlap))
    core = limit - overlap_within(limit, overlap)
    done, stack = [0], [(0, n)]
    while stack:
        a, b = stack.pop()
        if b - a <= (core if a else limit):
            done.append(b)
            continue
        mid, reach, start = (a + b) // 2, max(1, (b - a) // 4), max(a + 1, least)
        for lo, hi in ((max(start, mid - reach), min(b, mid + reach + 1)), (start, b)):
            window = strength[lo:hi]
            best = window.max(initial=-1)
            if best > 0:
                break
        if best < 0:
            lo, hi, window = start, b, strength[start:b]
        at = lo + np.flatnonzero(window == max(best, window.max()))
        cut = int(at[np.abs(at - mid).argmin()])
        stack += [(cut, b), (a, cut)]
    return done


PIECE = "array<struct<part:int,start:int,overlap:int,piece:string>>"


def cut_oversized(df: DataFrame, text: str, limit: Column | str, overlap: Column | str | int, whole: bool = True) -> DataFrame:
    """Every row of ``df`` with its pieces: ``n_parts``, ``part``, ``start``, ``overlap_len``, ``piece``.

    ``start`` is where the piece's core begins. Rows within the limit stay in the JVM, or are left out
    unless ``whole``; only the oversized ones are sent to Python, each partition on its own, with no shuffle.
    """
    lim, over = (F.col(limit) if isinstance(limit, str) else limit), (F.col(overlap) if isinstance(overlap, str) else F.lit(overlap))
    taken = {"n_parts", "part", "start", "overlap_len", "piece"} & set(df.columns)
    if taken:
        raise ValueError(f"columns of these names are there already: {sorted(taken)}")
    df = df.withColumns({"__limit": F.when(lim.isNotNull(), F.greatest(lim.cast("int"), F.lit(1))), "__overlap": F.greatest(F.coalesce(over.cast("int"), F.lit(0)), F.lit(0))})
    long = F.length(text) > F.col("__limit")
    small = df.where(~F.coalesce(long, F.lit(False))).withColumn("__p", F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("start"), F.lit(0).alias("overlap"), F.col(text).alias("piece"))))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, text):
            codes, offsets = to_codepoints(batch.column(text))
            strength = boundary_strength(codes, offsets)
            limits, overs = (batch.column(c).to_numpy() for c in ("__limit", "__overlap"))
            rows = []
            for k, t in enumerate(batch.column(text).to_pylist()):
                cuts = bisect(strength[offsets[k] : offsets[k + 1]], int(limits[k]), int(overs[k]))
                o = overlap_within(int(limits[k]), int(overs[k]))
                rows.append([{"part": j, "start": a, "overlap": min(o, a), "piece": t[a - min(o, a) : b]} for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))])
            made = pa.array(rows, pa.list_(pa.struct([("part", pa.int32()), ("start", pa.int32()), ("overlap", pa.int32()), ("piece", pa.string())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "__p"])

    large = df.where(long)
    large = large.mapInArrow(run, large.withColumn("__p", F.lit(None).cast(PIECE)).schema)
    both = small.unionByName(large) if whole else large
    return both.withColumn("n_parts", F.size("__p")).withColumn("__e", F.explode("__p")).withColumns({"part": F.col("__e.part"), "start": F.col("__e.start"), "overlap_len": F.col("__e.overlap"), "piece": F.col("__e.piece")}).drop("__p", "__e", "__limit", "__overlap")


def size_limit(spark: SparkSession, sf_dir: str, name: str) -> tuple[int | None, int]:
    """max_size and overlap of one limit; the table has one row per limit."""
    row = table(spark, sf_dir, "size_limits").where(F.col("limit_name") == name).select("max_size", "overlap").first()
    return (None, 0) if row is None else (row.max_size, row.overlap or 0)


def items_with_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, owner, item_no, piece_no, text, max_len, overlap): pieces of chunks and lines of books."""
    voices = table(spark, sf_dir, "voices").groupBy("voice_id").agg(F.max("max_chars").alias("max_len"))
    _, piece_overlap = size_limit(spark, sf_dir, "voice_piece")
    line_max, line_overlap = size_limit(spark, sf_dir, "book_line")
    pieces = (
        table(spark, sf_dir, "chunks")
        .select("job_key", "i", "voice_id", F.posexplode("pieces").alias("piece_no", "text"))
        .join(voices, "voice_id", "left")
        .select(F.lit("pieces").alias("field"), F.col("job_key").alias("owner"), F.col("i").alias("item_no"), "piece_no", "text", "max_len", F.lit(piece_overlap).alias("overlap"))
    )
    lines = table(spark, sf_dir, "books").select(F.lit("text").alias("field"), F.col("book_id").alias("owner"), F.posexplode(F.split("text", "\n", -1)).alias("item_no", "text"))
    lines = lines.select("field", "owner", "item_no", F.lit(-1).alias("piece_no"), "text", F.lit(line_max).cast("int").alias("max_len"), F.lit(line_overlap).alias("overlap"))
    return pieces.unionByName(lines)


def oversized_items(items: DataFrame) -> DataFrame:
    """The pieces of the items that had to be cut, each item once however often its rows are repeated."""
    return cut_oversized(items, "text", "max_len", "overlap", whole=False).drop("text").distinct()
