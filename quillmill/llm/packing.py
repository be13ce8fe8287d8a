"""Problem 3: filling containers of fixed capacity.

A grouping genetic algorithm. An individual is a set of containers. Crossover puts well-filled
containers of one parent into the other, removes the containers there that hold one of their items,
swaps displaced items into containers which they fill better, and places the rest by best fit, largest
first. Populations are islands that exchange their best individuals; they evolve until they reach a
lower bound or for ``PATIENCE`` generations nothing gets better, however many items there are.

A block of items evolves in one task. A group of more than ``BLOCK_ITEMS`` items is spread over
blocks by hash, each an island of its own: its well-filled containers, the elite, are settled; the
others migrate, whole, to new and fewer blocks, where they are one parent of the population and a fresh
best fit of their items the other. When a group's blocks get no fewer, only the worst-filled container
of each migrates. So the rounds end with one block, and no task ever gets an unbounded group.

Items larger than a container are cut into full containers and a rest; nothing else is cut.

Defined results: sizes of 0 or less take no room and go into container 0.0.0 of their group; an item of
unknown size (null) gets no container; a capacity below 1 counts as 1; ties in size are broken by
the item's key; the outcome depends only on the rows, not on their order or partitions.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from random import Random
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.chunking import size_limit
from quillmill.session import cut, table

#: Items that one block packs; larger groups are spread over several.
BLOCK_ITEMS = 2048
ISLANDS, POPULATION, PATIENCE, MIGRATE = 2, 4, 10, 4
#: A container of a split group is kept in its block when filled to this share.
ELITE_FILL = 0.97

Bins = list[list[int]]


def lower_bound(sizes: list[int], cap: int) -> int:
    """Fewest containers that could do: by total size, and by items that exclude each other (Martello and Toth's second bound)."""
    if not sizes:
        return 0
    x = np.sort(np.asarray(sizes, np.int64))
    upto = np.concatenate([[0], np.cumsum(x)])
    k = np.unique(np.concatenate([[0], x[x <= cap // 2]]))
    half = np.searchsorted(x, cap // 2, "right")  # from here on more than half a container
    big = np.searchsorted(x, cap - k, "right")
    some = np.maximum(0, big - half)
    low = np.searchsorted(x, k, "left")
    rest = upto[half] - upto[np.minimum(low, half)]
    room = some * cap - (upto[np.maximum(big, half)] - upto[half])
    alone = len(x) - np.maximum(big, half)
    return int(max(-(-upto[-1] // cap), (alone + some + np.maximum(0, -(-(rest - room) // cap))).max()))


def best_fit(sizes: list[int], items: list[int], bins: Bins, load: list[int], cap: int) -> None:
    """Place ``items``, largest first, each where the least room is left; opens containers as needed."""
    room = sorted((cap - load[b], b) for b in range(len(bins)))
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            r, b = room.pop(at)
        else:
            r, b = cap, len(bins)
            bins.append([])
            load.append(0)
        bins[b].append(i)
        load[b] += sizes[i]
        insort(room, (r - sizes[i], b))


def fitness(sizes: list[int], bins: Bins, cap: int) -> float:
    """Mean square fill: more for fewer containers and for fuller ones among as many."""
    return sum((sum(sizes[i] for i in b) / cap) ** 2 for b in bins) / max(1, len(bins))


def swap_in(sizes: list[int], free: list[int], bins: Bins, load: list[int], cap: int) -> list[int]:
    """Displaced items for one or two items of a container which they fill better; the items then displaced."""
    free = sorted(free, key=lambda i: (-sizes[i], i))
    for b in sorted(range(len(bins)), key=lambda b: load[b]):
        room = cap - load[b]
        if not free or not room or len(bins[b]) > 12:
            continue
        pairs = [(sizes[x], [x]) for x in bins[b]] + [(sizes[x] + sizes[y], [x, y]) for n, x in enumerate(bins[b]) for y in bins[b][n + 1 :]]
        best = None
        by = sorted((sizes[i], i) for i in free)
        for size, out in pairs:
            at = bisect_left(by, (size + room + 1, -1)) - 1  # the largest displaced item that fits instead
            if at >= 0 and by[at][0] > size and (best is None or by[at][0] - size > best[0]):
                best = (by[at][0] - size, out, by[at][1])
        if best:
            gain, out, new = best
            bins[b] = [x for x in bins[b] if x not in out] + [new]
            load[b] += gain
            free.remove(new)
            free += out
    return free


def crossover(sizes: list[int], a: Bins, b: Bins, cap: int, rnd: Random) -> Bins:
    """Well-filled containers of ``a`` in ``b``."""
    loads = [sum(sizes[i] for i in x) for x in a]
    good = sorted(range(len(a)), key=lambda k: -loads[k])[: max(1, len(a) // 2)]
    rnd.shuffle(good)
    taken = [a[k] for k in good[: rnd.randint(1, len(good))]]
    inside = {i for x in taken for i in x}
    kept = [x for x in b if inside.isdisjoint(x)]
    bins = [list(x) for x in taken] + [list(x) for x in kept]
    have = inside.union(*kept) if kept else inside
    return settle(sizes, [i for x in b for i in x if i not in have], bins, cap)


def settle(sizes: list[int], free: list[int], bins: Bins, cap: int) -> Bins:
    """``bins`` with the displaced items swapped in or placed by best fit."""
    load = [sum(sizes[i] for i in x) for x in bins]
    best_fit(sizes, swap_in(sizes, free, bins, load, cap), bins, load, cap)
    return bins


def mutate(sizes: list[int], a: Bins, cap: int, rnd: Random) -> Bins:
    """Empty the worst-filled container and a few others, and place their items anew."""
    if len(a) < 2:
        return a
    worst = min(range(len(a)), key=lambda k: sum(sizes[i] for i in a[k]))
    out = {worst, *rnd.sample(range(len(a)), min(len(a), 1 + rnd.randint(1, 3)))}
    bins = [list(x) for k, x in enumerate(a) if k not in out]
    free = [i for k in out for i in a[k]]
    rnd.shuffle(free)
    return settle(sizes, free, bins, cap)


def pack(sizes: list[int], cap: int, seed: int = 0, arrived: Bins | None = None) -> Bins:
    """Containers of item numbers, no item larger than ``cap``; ``arrived``: containers that the items came in."""
    first: Bins = []
    best_fit(sizes, list(range(len(sizes))), first, [], cap)
    least = lower_bound(sizes, cap)
    score = lambda x: (-len(x), fitness(sizes, x, cap))
    if arrived and score(arrived) > score(first):
        first, arrived = arrived, first
    if len(first) <= least:
        return first
    rnd = Random(seed)
    islands = [[first, *([arrived] if arrived else [])] for _ in range(ISLANDS)]
    for pop in islands:
        pop += [mutate(sizes, pop[k % len(pop)], cap, rnd) for k in range(POPULATION - len(pop))]
    best, idle, gen = max(score(x) for pop in islands for x in pop), 0, 0
    while idle < PATIENCE:
        for pop in islands:
            a, b = rnd.sample(range(len(pop)), 2)
            child = mutate(sizes, crossover(sizes, pop[a], pop[b], cap, rnd), cap, rnd)
            worst = min(range(len(pop)), key=lambda k: score(pop[k]))
            if score(child) > score(pop[worst]):
                pop[worst] = child
            if len(child) <= least:
                return child
        if gen % MIGRATE == MIGRATE - 1:
            elite = [max(pop, key=score) for pop in islands]
            for n, pop in enumerate(islands):
                pop[min(range(len(pop)), key=lambda k: score(pop[k]))] = elite[n - 1]
        gen, now = gen + 1, max(score(x) for pop in islands for x in pop)
        # fewer containers, or the same ones fuller by half a container in all
        idle = 0 if now[0] > best[0] or now[1] - best[1] > 0.5 / max(1, -best[0]) else idle + 1
        best = max(best, now) if idle else now
    return max((x for pop in islands for x in pop), key=score)


def _pack_blocks(df: DataFrame, schema: str) -> DataFrame:
    """Pack each (grp, block) of rows (grp, block, item, part, size, cap, came); adds bin, fill and worst.

    came: the container that the item came in, null for none; worst: whether its container is the one with most room.
    """

    def flush(rows: list) -> Iterator[tuple]:
        rows.sort(key=lambda r: (-r[4], r[2], r[3]))
        cap = rows[0][5]
        came: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            came.setdefault(r[6], []).append(i)
        arrived = None if None in came else [came[k] for k in sorted(came)]
        bins = pack([r[4] for r in rows], cap, crc32(f"{rows[0][0]} {rows[0][1]}".encode()), arrived)
        loads = [sum(rows[i][4] for i in b) for b in bins]
        worst = min(range(len(bins)), key=lambda k: loads[k])
        of = {i: k for k, b in enumerate(bins) for i in b}
        for i, r in enumerate(rows):
            yield (*r, of[i], loads[of[i]] / cap, of[i] == worst)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        names = [*columns, "bin", "fill", "worst"]
        for batch in it:
            wanted = pa.schema([*batch.schema, ("bin", pa.int32()), ("fill", pa.float64()), ("worst", pa.bool_())])
            for r in zip(*(batch.column(c).to_pylist() for c in columns)):
                if (r[0], r[1]) != key and rows:
                    out += flush(rows)
                    rows = []
                    if len(out) > 20000:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema=wanted)
                        out = []
                key = (r[0], r[1])
                rows.append(r)
        if rows:
            out += flush(rows)
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema=wanted)

    columns = ["grp", "block", "item", "part", "size", "cap", "came"]
    return df.select(*columns).repartition("grp", "block").sortWithinPartitions("grp", "block").mapInArrow(run, schema)


def pack_items(items: DataFrame, capacity: int) -> DataFrame:
    """(grp, item, part, n_parts, size, container) of items (grp, item, size).

    ``item`` is a string without tabs that names an item within its group. A container's name is
    unique within its group: round, block and number, or the part that fills it. Repeated rows count
    once; the same item with two sizes counts as two items.
    """
    cap = max(1, int(capacity))
    items = items.select(F.col("grp").cast("string").alias("grp"), "item", F.col("size").cast("long").alias("size")).distinct()
    items = items.withColumn("item", F.concat("item", F.lit("\t"), F.coalesce(F.col("size").cast("string"), F.lit(""))))  # the whole size goes along
    parts = items.withColumn("n_parts", F.greatest(F.lit(1), F.ceil(F.col("size") / cap)).cast("int"))
    parts = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    parts = parts.withColumn("size", F.when(F.col("part") < F.col("n_parts") - 1, F.lit(cap)).otherwise(F.col("size") - cap * (F.col("n_parts") - 1)))
    parts = cut(parts)
    full = parts.where((F.col("size") >= cap) & (F.col("n_parts") >= 1))
    none = parts.where(F.col("size") <= 0).withColumn("container", F.lit("0.0.0"))
    unknown = parts.where(F.col("size").isNull()).withColumn("container", F.lit(None).cast("string"))
    loose = parts.where((F.col("size") > 0) & (F.col("size") < cap)).select("grp", "item", "part", "size", F.lit(cap).alias("cap"))
    schema = "grp string, block int, item string, part int, size bigint, cap int, came string, bin int, fill double, worst boolean"
    loose = loose.withColumn("came", F.lit(None).cast("string"))
    counts = loose.groupBy("grp").count()
    spread = counts.where(F.col("count") > BLOCK_ITEMS).select("grp", F.ceil(F.col("count") / BLOCK_ITEMS).cast("int").alias("blocks"))
    small = loose.join(spread, "grp", "left_anti").withColumn("block", F.lit(0))
    done = _pack_blocks(small, schema).withColumn("round", F.lit(0))
    blocked = loose.join(spread, "grp").withColumn("block", F.pmod(F.xxhash64("item", "part"), F.col("blocks")).cast("int"))
    columns = ["grp", "block", "item", "part", "size", "cap", "came"]
    left, step = cut(blocked.select(*columns)), 0
    while True:
        most = left.groupBy("grp").agg(F.max("block").alias("m")).agg(F.max("m")).first()[0]
        if most is None:
            break
        step += 1
        packed = cut(_pack_blocks(left, schema).withColumn("round", F.lit(step)))
        if most == 0:
            done = done.unionByName(packed)
            break
        rest = F.col("fill") < ELITE_FILL
        fewer = packed.groupBy("grp").agg((F.max("block") + 1).alias("had"), F.ceil(F.count_if(rest) / BLOCK_ITEMS).cast("int").alias("blocks"), F.ceil(F.count_if("worst") / BLOCK_ITEMS).cast("int").alias("least"))
        stuck = F.col("blocks") >= F.col("had")
        alone = F.col("had") == 1  # a group's last block settles
        marked = packed.join(fewer.select("grp", alone.alias("alone"), stuck.alias("stuck"), F.when(stuck, F.col("least")).otherwise(F.col("blocks")).alias("blocks")), "grp")
        moves = ~F.col("alone") & F.when(F.col("stuck"), F.col("worst")).otherwise(rest)
        done = done.unionByName(marked.where(~moves).select(*packed.columns))
        came = F.concat_ws(".", "block", "bin")
        left = cut(marked.where(moves).withColumn("came", came).withColumn("block", F.pmod(F.xxhash64("came", F.lit(step)), F.col("blocks")).cast("int")).select(*columns))
    name = F.concat_ws(".", "round", "block", "bin")
    placed = done.select("grp", "item", "part", "size", name.alias("container"))
    cutting = full.select("grp", "item", "part", "size", F.concat_ws(".", F.lit("full"), "item", "part").alias("container"))
    rest = placed.unionByName(cutting).unionByName(none.select("grp", "item", "part", "size", "container")).unionByName(unknown.select("grp", "item", "part", "size", "container"))
    cut_items = F.when(F.col("whole") > 0, F.greatest(F.lit(1), F.ceil(F.col("whole") / cap))).otherwise(F.lit(1)).cast("int")
    return rest.select("grp", F.split("item", "\t").alias("i"), "part", "size", "container").select("grp", F.col("i")[0].alias("item"), F.nullif(F.col("i")[1], F.lit("")).cast("long").alias("whole"), "part", "size", "container").withColumn("n_parts", cut_items).select("grp", "item", "part", "n_parts", "size", "container")


def sized_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, idx, size): word_count, or the words of the chapter's lines where that is null."""
    chapters = table(spark, sf_dir, "chapters").select("book_id", "idx", "line_idx", "word_count").distinct()
    spans = chapters.groupBy("book_id").agg(F.sort_array(F.collect_set("line_idx")).alias("starts"), F.max(F.col("word_count").isNull().cast("int")).alias("open"))
    words = lambda x: F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))
    lines = table(spark, sf_dir, "books").select("book_id", "uploaded_at", F.transform(F.split("text", "\n", -1), words).alias("w"))
    lines = lines.join(spans.where("open = 1").select("book_id"), "book_id", "left_semi").groupBy("book_id").agg(F.max_by("w", "uploaded_at").alias("w"))
    counted = chapters.where("word_count is null").join(spans.select("book_id", "starts"), "book_id", "left").join(lines, "book_id", "left")
    nxt = F.coalesce(F.array_min(F.filter("starts", lambda s: s > F.col("line_idx"))), F.size("w"))
    total = F.aggregate(F.slice("w", F.col("line_idx") + 1, F.greatest(nxt - F.col("line_idx"), F.lit(0))), F.lit(0), lambda a, x: a + x)
    counted = counted.select("book_id", "idx", total.cast("long").alias("size"))
    return chapters.where("word_count is not null").select("book_id", "idx", F.col("word_count").cast("long").alias("size")).unionByName(counted)


def chapter_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, idx, part, n_parts, size, container) of all chapters."""
    cap, _ = size_limit(spark, sf_dir, "chapter_container")
    items = sized_chapters(spark, sf_dir).select(F.col("book_id").alias("grp"), F.col("idx").cast("string").alias("item"), "size")
    return pack_items(items, cap).select(F.col("grp").alias("book_id"), F.col("item").cast("int").alias("idx"), "part", "n_parts", "size", "container")


def piece_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_key, i, piece_no, digest, part, n_parts, size, container) of all pieces of all jobs."""
    cap, _ = size_limit(spark, sf_dir, "piece_container")
    pieces = table(spark, sf_dir, "chunks").select("job_key", "i", F.posexplode("pieces").alias("piece_no", "piece"))
    items = pieces.select(F.col("job_key").alias("grp"), F.concat_ws(":", "i", "piece_no", F.md5("piece")).alias("item"), F.length("piece").alias("size"))
    at = F.split("item", ":")
    out = pack_items(items, cap)
    return out.select(F.col("grp").alias("job_key"), at[0].cast("int").alias("i"), at[1].cast("int").alias("piece_no"), at[2].alias("digest"), "part", "n_parts", "size", "container")
