"""Problem 7: mixing sources to target shares.

The size of a document is its exact number of tokens under a public tokenizer. A source's budget is
its target share of all tokens of all documents, whatever their source. Whole repetitions of the source are taken while they fit and the
cap on repeats allows; what is left of the budget is filled from one more pass by subset sum over the
counts of documents by token length: each length gives its proportional part, and a bounded-knapsack
dynamic programme over the remaining counts fits the rest to the token where that can be done. The
documents of each length are then taken in the order of a seeded hash.

The table of counts by length is small (one row per source and distinct length); it is solved per
source in one task. Documents are ranked by hash in buckets by (source, length, leading hash bits),
so one length or source that holds a third of all rows is spread over many tasks.

Defined results: sources are compared without case and surrounding blanks; a source without a target
is not used, a target without documents contributes nothing and shows in the report, a source too
small for its share is used max_repeats times and falls short; null and blank texts have 0 tokens and
are not chosen; null max_repeats counts as 1, less than 1 as 0; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.codepoints import batches
from quillmill.session import cut, table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Size of the dynamic programme's table, in tokens.
EXACT_TOKENS = 200_000
BUCKET_BITS = 6


@lru_cache(2)
def encoder(path: str):
    """The byte-level tokenizer whose ranks are in ``path``."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, path: str = TOKENIZER, text: str = "text", into: str = "tokens") -> DataFrame:
    """``df`` with the number of tokens of ``text`` instead of the text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches(it, text):
            n = [0 if t is None else len(enc.encode_ordinary(t)) for t in batch.column(text).to_pylist()]
            rest = [i for i, c in enumerate(batch.schema.names) if c != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(n, pa.int32())], names=[*(batch.schema.names[i] for i in rest), into])

    return df.mapInArrow(run, df.drop(text).withColumn(into, F.lit(0)).schema)


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take for at most ``budget`` tokens, as close to it as can be.

    Proportional parts come first; the dynamic programme then works on a remainder of at most
    ``EXACT_TOKENS`` with the counts that are left. ``first[s]`` is the item by which sum ``s`` is
    first reached, in binary parts of the counts, so the choice can be walked back.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return take
    spare = min(budget, max(EXACT_TOKENS // 2, 4 * int(lengths.max())))
    take = np.minimum(counts, np.floor(counts * ((budget - spare) / total)).astype(np.int64))
    left = counts - take
    rest = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):  # greedy down to what the table holds
        over = rest - EXACT_TOKENS
        if over <= 0:
            break
        n = min(int(left[i]), over // int(lengths[i]))
        take[i] += n
        left[i] -= n
        rest -= n * int(lengths[i])
    rest = min(rest, EXACT_TOKENS + int(lengths.max()))
    first = np.full(rest + 1, -1, np.int32)
    reach = np.zeros(rest + 1, bool)
    reach[0] = True
    parts: list[tuple[int, int]] = []
    for i in range(len(lengths)):
        n, p = int(min(left[i], rest // int(lengths[i]))), 1
        while n > 0:
            p = min(p, n)
            size = p * int(lengths[i])
            if size <= rest:
                new = np.zeros(rest + 1, bool)
                new[size:] = reach[: rest + 1 - size]
                new &= ~reach
                first[new] = len(parts)
                reach |= new
                parts.append((i, p))
            n -= p
            p *= 2
        if reach[rest]:
            break
    s = int(np.flatnonzero(reach)[-1])
    while s > 0:
        i, p = parts[first[s]]
        take[i] += p
        s -= p * int(lengths[i])
    return take


def plan_mix(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, tokens, repeats, extra): for each source and length the whole repeats and how many documents get one more."""
    counts = sizes.where("tokens > 0").groupBy("source", "tokens").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    goal = targets.select("source", (F.coalesce("target_share", F.lit(0.0)) * total).cast("long").alias("budget"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap"))
    schema = "source string, tokens int, repeats int, extra bigint"

    def solve(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("tokens")
        lengths, n = pdf.tokens.to_numpy(np.int64), pdf.n.to_numpy(np.int64)
        budget, cap, size = int(pdf.budget.iloc[0]), int(pdf["cap"].iloc[0]), int((lengths * n).sum())
        whole = min(cap, budget // size)
        extra = fit(lengths, n, budget - whole * size) if whole < cap else np.zeros(len(n), np.int64)
        return pd.DataFrame({"source": key[0], "tokens": lengths.astype(np.int32), "repeats": np.int32(whole), "extra": extra})

    return counts.join(F.broadcast(goal) if goal.count() < 10_000 else goal, "source").groupBy("source").applyInPandas(solve, schema)


def mix(documents: DataFrame, targets: DataFrame, seed: int = 0, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(chosen, report): (doc_id, source, tokens, repeats) and per source the share aimed at and those reached,
    of all tokens of the documents and of the tokens chosen."""
    clean = lambda c: F.lower(F.trim(c))
    sizes = documents.select("doc_id", clean("source").alias("source"), F.when(F.trim("text") != "", F.col("text")).alias("text"))
    sizes = cut(token_counts(sizes, path).distinct())
    targets = targets.select(clean("source").alias("source"), "target_share", "max_repeats").where("source is not null")
    targets = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    plan = cut(plan_mix(sizes, targets))
    keyed = sizes.join(plan, ["source", "tokens"]).withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    keyed = keyed.withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS).cast("int"))
    some = keyed.where("extra > 0")
    per = some.groupBy("source", "tokens", "bucket").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("source", "tokens", "bucket").orderBy("h", "doc_id"))
    ranked = some.withColumn("place", place).join(before, ["source", "tokens", "bucket"])
    more = ranked.select("doc_id", "source", "tokens", (F.col("repeats") + (F.col("place") + F.col("before") <= F.col("extra")).cast("int")).alias("repeats"))
    chosen = more.unionByName(keyed.where("extra = 0").select("doc_id", "source", "tokens", "repeats")).where("repeats > 0")
    chosen = cut(chosen)
    used = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens").cast("long") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    held = sizes.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    total = max(1, sizes.agg(F.sum("tokens")).first()[0] or 0)
    everything = chosen.agg(F.sum(F.col("tokens").cast("long") * F.col("repeats"))).first()[0] or 0
    report = targets.join(held, "source", "full").join(used, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    report = report.select("source", "target_share", "max_repeats", zero("source_tokens"), zero("documents"), zero("mixed_tokens"), zero("most_repeats"), (F.coalesce("mixed_tokens", F.lit(0)) / F.lit(total)).alias("share_of_all"), (F.coalesce("mixed_tokens", F.lit(0)) / F.lit(max(1, everything))).alias("share_of_mix"))
    return chosen, report


def mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
