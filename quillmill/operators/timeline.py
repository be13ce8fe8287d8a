"""Timelines of spoken words: phrase breaks, pause alignment, segments, matching spoken to shown words.

Alignment is a dynamic programme with a cursor, one chunk at a time; it runs in Arrow-batched
functions over rows that already hold a chunk's arrays, so there is no shuffle.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Costs and limits of the alignment, in seconds.
SKIP, TYPE_PENALTY, TOLERANCE, SENTENCE_PAUSE, LOOK_AHEAD = 0.9, 0.35, 2.0, 0.38, 60


def breaks(text: str) -> list[tuple[int, float, bool]]:
    """(words so far, share of the weight so far, whether a sentence ends) at each phrase's end but the last."""
    parts = [p for p in re.split(r"(?<=[,;:.!?…])[ \t]+", text) if p.strip()]
    weights = [sum(len(w) + 1 for w in p.split()) for p in parts]
    total, out, words, run = sum(weights) or 1, [], 0, 0
    for p, w in zip(parts[:-1], weights):
        words += len(p.split())
        run += w
        out.append((words, run / total, bool(re.search(r"[.!?…]$", p.strip()))))
    return out


def align(expected: list[tuple[float, bool]], pauses: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """Pairs (break, pause) of the cheapest monotone matching.

    A skip on either side costs SKIP; a match costs the distance in time, more when the pause's length
    does not fit the kind of break; breaks and pauses over TOLERANCE apart never match.
    """
    n, m = len(expected), len(pauses)
    cost = [[0.0] * (m + 1) for _ in range(n + 1)]
    move = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == j == 0:
                continue
            options = []
            if i:
                options.append((cost[i - 1][j] + SKIP, 1))
            if j:
                options.append((cost[i][j - 1] + SKIP, 2))
            if i and j:
                (t, sentence), (at, length) = expected[i - 1], pauses[j - 1]
                if abs(t - at) <= TOLERANCE:
                    options.append((cost[i - 1][j - 1] + abs(t - at) + (TYPE_PENALTY if sentence != (length >= SENTENCE_PAUSE) else 0.0), 3))
            best = min(c for c, _ in options)
            cost[i][j], move[i][j] = best, next(k for c, k in options if c == best)
    out, i, j = [], n, m
    while i or j:
        k = move[i][j]
        if k == 3:
            out.append((i - 1, j - 1))
        i, j = i - (k in (1, 3)), j - (k in (2, 3))
    return out[::-1]


def segments(text: str, pauses: list[tuple[float, float]], seconds: float) -> list[tuple[float, float, int, int]]:
    """(start, end, first word, last word + 1) of the stretches between matched pauses; one segment without any."""
    words = len(text.split())
    if not words or seconds <= 0:
        return []
    b = breaks(text)
    pairs = [(i, i) for i in range(len(b))] if len(b) == len(pauses) else align([(share * seconds, s) for _, share, s in b], [((a + e) / 2, e - a) for a, e in pauses])
    out, at, word = [], 0.0, 0
    for i, j in pairs:
        start, end = pauses[j]
        if b[i][0] > word and start >= at:
            out.append((round(at, 2), round(start, 2), word, b[i][0]))
            at, word = end, b[i][0]
    out.append((round(at, 2), round(max(at, seconds), 2), word, words))
    return out


SEGMENT = "array<struct<s:double,e:double,a:int,b:int>>"


def with_segments(chunks: DataFrame) -> DataFrame:
    """chunks (text, pauses array<struct<start, end>>, seconds) with ``segments`` on the chunk's own clock."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            made = [segments(t or "", [(p["start"], p["end"]) for p in (ps if ps is not None else [])], s or 0.0) for t, ps, s in zip(pdf["text"], pdf["pauses"], pdf["seconds"])]
            yield pdf.assign(segments=[[dict(zip("seab", x)) for x in m] for m in made])

    return chunks.mapInPandas(run, chunks.withColumn("segments", F.lit(None).cast(SEGMENT)).schema)


def running_clock(chunks: DataFrame, key: str, order: str, block: int = 1000) -> DataFrame:
    """chunks with ``start_sec``: speech and gaps of all chunks before, to two places.

    Sums are made per block of ``block`` places in the order first, and then within blocks, so that no task sees a whole feed.
    """
    c = chunks.withColumn("__b", F.floor(F.col(order) / block)).withColumn("__w", (F.col("speech_sec") + F.col("gap_sec")).cast("decimal(28,6)"))
    per = c.groupBy(key, "__b").agg(F.sum("__w").alias("__w"))
    before = per.select(key, "__b", F.coalesce(F.sum("__w").over(Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    w = Window.partitionBy(key, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = c.withColumn("__in", F.coalesce(F.sum("__w").over(w), F.lit(0))).join(before, [key, "__b"])
    return out.withColumn("start_sec", F.round((F.col("__before") + F.col("__in")).cast("double"), 2)).drop("__b", "__w", "__in", "__before")


def _plain(word: str) -> str:
    return re.sub(r"[^a-z0-9']", "", word.lower().replace("‘", "'").replace("’", "'"))


def match_segments(segments: list[tuple[int, str]], shown: list[str], look: int = LOOK_AHEAD) -> list[tuple[int, int, int]]:
    """(number, first word, last word + 1) of the shown words that each segment of spoken text covers."""
    at = {}
    for i, w in enumerate(shown):
        at.setdefault(_plain(w), []).append(i)
    out: list[tuple[int, int, int]] = []
    cursor = 0
    for n, text in segments:
        tokens = [t for t in map(_plain, (text or "").split()) if t]
        if not tokens:
            continue
        hits, place = [], cursor
        for t in tokens:
            places = at.get(t, [])
            k = bisect_left(places, place)
            if k < len(places) and places[k] < place + look:
                hits.append(places[k])
                place = places[k] + 1
        first, last = (hits[0], hits[-1]) if hits else (out[-1][2],) * 2 if out else (cursor,) * 2
        out.append((n, first, max(first, last) + 1))
        cursor = last + 1
    return out


def match_words(spoken: list[str], shown: list[str], look: int = LOOK_AHEAD) -> list[int]:
    """For each spoken word the shown word it is, -1 where none follows within ``look`` words."""
    s, t, at, out = [_plain(w) for w in spoken], [_plain(w) for w in shown], 0, []
    for w in s:
        hit = next((k for k in range(at, min(len(t), at + look)) if w and t[k] == w), -1)
        out.append(hit)
        at = hit + 1 if hit >= 0 else at
    return out
