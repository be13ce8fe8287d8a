"""Budgets over ordered sections: allocation, folding small sections, batching into units.

Sections of one text are gathered into an array and folded inside the row (one shuffle by text);
only the allocation with a minimum, which repeats until stable, runs as a grouped Arrow function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_budget(weights: list[int], total: int, floor: int) -> list[int]:
    """Shares of ``total`` in proportion to the weights, rounded down, none under ``floor``."""
    out: dict[int, int] = {}
    free = set(range(len(weights)))
    left = total
    while free:
        size = sum(weights[i] for i in free)
        low = [i for i in free if (weights[i] * left // size if size else 0) < floor]
        if not low:
            out |= {i: weights[i] * left // size if size else 0 for i in free}
            break
        for i in low:
            out[i] = floor
            free.discard(i)
        left -= floor * len(low)
    return [out[i] for i in range(len(weights))]


def allocate(sections: DataFrame, key: str, order: str, weight: str, total: str, floor: int) -> DataFrame:
    """(key, order, weight, budget)."""
    kinds = dict(sections.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {weight} bigint, budget bigint"

    def run(pdf):
        pdf = pdf.sort_values(order)
        w = [int(x) for x in pdf[weight]]
        return pdf.assign(**{weight: w, "budget": split_budget(w, int(pdf[total].iloc[0]), floor)})[[key, order, weight, "budget"]]

    return sections.select(key, order, F.col(weight).cast("bigint").alias(weight), F.col(total).cast("bigint").alias(total)).groupBy(key).applyInPandas(run, schema)


def absorb_small(sections: DataFrame, key: str, order: str, words: str, least: int = 150) -> DataFrame:
    """(key, section, first, parts, words): sections carried forward until they have ``least`` words; a rest at the end joins the one before."""
    rows = sections.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(words).cast("long").alias("w")))).alias("x"))
    one = "struct<first:int,parts:int,words:bigint>"
    zero = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.lit(None).cast(one).alias("open"))

    def step(a, x):
        now = F.struct(F.coalesce(a["open"]["first"], x["o"].cast("int")).alias("first"), (F.coalesce(a["open"]["parts"], F.lit(0)) + 1).alias("parts"), (F.coalesce(a["open"]["words"], F.lit(0)) + x["w"]).cast("long").alias("words"))
        full = F.coalesce(a["open"]["words"], F.lit(0)) + x["w"] >= least
        return F.when(full, F.struct(F.concat(a["done"], F.array(now)).alias("done"), F.lit(None).cast(one).alias("open"))).otherwise(F.struct(a["done"].alias("done"), now.alias("open")))

    def close(a):
        last = F.get(a["done"], F.size(a["done"]) - 1)
        joined = F.struct(last["first"].alias("first"), (last["parts"] + a["open"]["parts"]).alias("parts"), (last["words"] + a["open"]["words"]).alias("words"))
        return F.when(a["open"].isNull(), a["done"]).when(F.size(a["done"]) == 0, F.array(a["open"])).otherwise(F.concat(F.slice(a["done"], F.lit(1), F.size(a["done"]) - 1), F.array(joined)))

    folded = rows.select(key, F.posexplode(F.aggregate("x", zero, step, close)).alias("section", "s"))
    return folded.select(key, "section", "s.first", "s.parts", "s.words")


def pack_units(items: DataFrame, key: str, order: str, words: str, budget: str, most_words: int, most_budget: int = 1500, most_items: int = 8) -> DataFrame:
    """(key, order, unit): next-fit batches within words, budget and number of items."""
    rows = items.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(words).cast("long").alias("w"), F.col(budget).cast("long").alias("b")))).alias("x"))
    zero = F.struct(F.array().cast("array<int>").alias("u"), F.lit(-1).alias("k"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("n"))

    def step(a, x):
        new = (a["k"] < 0) | (a["w"] + x["w"] > most_words) | (a["b"] + x["b"] > most_budget) | (a["n"] >= most_items)
        k = F.when(new, a["k"] + 1).otherwise(a["k"])
        keep = lambda c, v: F.when(new, v).otherwise(c + v)
        return F.struct(F.concat(a["u"], F.array(k)).alias("u"), k.alias("k"), keep(a["w"], x["w"]).cast("long").alias("w"), keep(a["b"], x["b"]).cast("long").alias("b"), keep(a["n"], F.lit(1)).alias("n"))

    zipped = F.zip_with("x", F.aggregate("x", zero, step, lambda a: a["u"]), lambda x, u: F.struct(x["o"].alias("o"), u.alias("u")))
    return rows.select(key, F.explode(zipped).alias("e")).select(key, F.col("e.o").alias(order), F.col("e.u").alias("unit"))


def merge_smallest(sections: DataFrame, key: str, order: str, words: str, most: int) -> DataFrame:
    """(key, section, first, parts, words): the neighbours with the least words together are merged until ``most`` sections are left; the first pair on ties."""
    kinds = dict(sections.dtypes)
    schema = f"{key} {kinds[key]}, section int, first int, parts int, words bigint"

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        s = [[int(o), 1, int(w)] for o, w in zip(pdf[order], pdf[words])]
        while len(s) > max(1, most):
            k = min(range(len(s) - 1), key=lambda i: s[i][2] + s[i + 1][2])
            s[k : k + 2] = [[s[k][0], s[k][1] + s[k + 1][1], s[k][2] + s[k + 1][2]]]
        return pd.DataFrame([(pdf[key].iloc[0], i, *x) for i, x in enumerate(s)], columns=[key, "section", "first", "parts", "words"])

    return sections.select(key, order, words).groupBy(key).applyInPandas(run, schema)
