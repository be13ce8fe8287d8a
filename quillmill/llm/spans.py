"""Problem 8: long spans that stand verbatim in more than one record.

1. Each text gets fingerprints by winnowing (hashes of ``k`` characters, the least of every ``w`` in a
   row, with k + w - 1 = the least span), so every span of the least length that two texts share holds
   a fingerprint that both have. Records with the same text are one class from here on.
2. Fingerprints of two classes or more name the places where a shared span can lie. Only the stretches
   of text around them are sent on. Every class is indexed once, in the shard of its most frequent
   shared fingerprint, and its stretches are queries to the shards that index a class with which it
   shares a fingerprint.
3. Per shard an FM-index is built over the stretches, and the queries are streamed through it:
   backward search over the wavelet matrix gives matching statistics, that is for an end the farthest
   start from which the text also stands in another record. That start never goes down as the end goes
   up, so ends are tested by bisection, and each test settles a whole range of ends.
4. The intervals of a class are merged over its shards.

A fingerprint that fills more than a shard is hot. Its classes don't meet one another: the windows of
the least length around it are counted by their hash (partial counts before the shuffle), and each
class asks, for every window that more than one class has, one other class that has it: the least of
them, or the greatest if it is the least itself. The classes asked are indexed, in shards by their own
key, and the FM-index decides as before. As the least of nested sets changes seldom, a class visits few
shards, and the work grows with the group, not with its square. No cap is set anywhere.

Defined results: null and short texts share nothing; repeated rows of a record count once; several
different texts under one id are compared like texts of different records; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.codepoints import batches, to_codepoints
from quillmill.llm.fmindex import FMIndex
from quillmill.llm.leaks import _arrow_schema, mix, windows
from quillmill.session import cut

#: Characters of text in one FM-index.
SHARD_CHARS = 2_000_000
#: Ends that one test may settle; long texts are tested in several places at once.
RANGE = 2048
#: Characters that visit one copy of an index, as a multiple of the above.
VISITS_PER_INDEX = 6
#: Characters of visitors searched at a time.
ASK_CHARS = 1_000_000


def winnow(codes: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the row, hash) of the fingerprints of every row."""
    k = max(1, least // 3)
    w = least - k + 1
    none = np.empty(0, np.int64)
    n = len(codes) - k + 1
    if n < w:
        return none, none, none
    h = mix(windows(codes, k))
    at = np.arange(n, dtype=np.uint64)
    key = h & ~np.uint64((1 << 21) - 1) | at & np.uint64((1 << 21) - 1)
    size, low = 1, key
    while size * 2 <= w:  # the least of w keys in a row, by doubling
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: n - w + 1], low[w - size : n - size + 1])
    start = np.arange(len(low), dtype=np.int64)
    row = np.searchsorted(offsets, start, "right") - 1
    inside = start + least <= offsets[row + 1]
    start, row, low = start[inside], row[inside], low[inside]
    pos = start + ((low.astype(np.int64) - start) & ((1 << 21) - 1))
    first = np.concatenate([[True], pos[1:] != pos[:-1]]) if len(pos) else np.empty(0, bool)
    pos, row = pos[first], row[first]
    return row, pos - offsets[row], h[pos].view(np.int64)


def fingerprints(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, digest, n_chars, fps array<struct<pos, fp>>) of texts of the least length or more."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, digest string, n_chars int, fps array<struct<pos:int,fp:bigint>>"
    wanted = _arrow_schema(docs.sparkSession, schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            codes, offsets = to_codepoints(batch.column("text"))
            row, pos, fp = winnow(codes, offsets, least)
            items = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array(fp)], names=["pos", "fp"])
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), items).cast(wanted.field("fps").type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), batch.column("n_chars"), lists], schema=wanted)

    long = docs.where(F.length("text") >= least).select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n_chars"), "text")
    return long.mapInArrow(run, schema)


STRETCHES = "array<struct<start:int,text:string>>"


def _stretches(docs: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """(rep, places, cold, hot): each class by its digest, its places, and the stretches of text around those that are not hot and those that are."""
    schema = f"rep binary, places array<struct<pos:int,fp:bigint,n:bigint,hot:boolean>>, cold {STRETCHES}, hot {STRETCHES}"
    wanted = _arrow_schema(docs.sparkSession, schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            made: tuple[list, list] = ([], [])
            for t, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                for hot in (False, True):
                    made[hot].append([{"start": a, "text": t[a:b]} for a, b, _ in _regions([p["pos"] for p in places if p["hot"] == hot], len(t), least)])
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("places").cast(wanted.field(1).type), *(pa.array(m, wanted.field(i).type) for i, m in enumerate(made, 2))], schema=wanted)

    texts = docs.where(F.length("text") >= least).join(places, "doc_id").withColumn("digest", F.md5("text")).where(F.xxhash64("digest") == F.col("h"))
    # a text's copies and a record's repeated rows give the same stretches again
    made = texts.select(F.unhex("digest").alias("rep"), "text", "places").mapInArrow(run, schema)
    return made.groupBy("rep").agg(*(F.first(c).alias(c) for c in ("places", "cold", "hot")))


def _chars(stretches: str) -> Column:
    return F.aggregate(stretches, F.lit(0).cast("long"), lambda a, r: a + F.length(r["text"]))


def _cold_visits(stretches: DataFrame) -> DataFrame:
    """(rep, shard, pos, home): the shards that a class goes to with the places it shares there; home: all its places are indexed there."""
    cold = F.filter("places", lambda p: ~p["hot"])
    homes = stretches.where(F.size("cold") > 0).select("rep", F.array_max(F.transform(cold, lambda p: F.struct(p["n"].alias("n"), p["fp"].alias("fp"))))["fp"].alias("home"), _chars("cold").alias("chars"))
    total = homes.agg(F.sum("chars")).first()[0] or 0
    shards = max(1, -(-total // SHARD_CHARS))
    # classes of one fingerprint that are too long for a shard together; hot ones, of very many classes, are not here
    large = homes.groupBy("home").agg(F.sum("chars").alias("chars")).where(F.col("chars") > SHARD_CHARS).select("home", F.ceil(F.col("chars") / SHARD_CHARS).cast("int").alias("blocks"))
    placed = homes.join(large, "home", "left").select(
        "rep", F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("home"), F.lit(shards))).otherwise(F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("blocks")))).alias("own")
    )
    shared = stretches.select("rep", F.explode(cold).alias("p")).select("rep", "p.fp", "p.pos")
    own = cut(shared.join(placed, "rep"))
    targets = own.select("fp", F.col("own").alias("shard")).distinct()
    visits = own.select("rep", "fp", "pos", "own").join(targets, "fp")
    return visits.groupBy("rep", "shard", (F.col("own") == F.col("shard")).alias("home")).agg(F.sort_array(F.collect_set("pos")).alias("pos"))


def _hot_visits(stretches: DataFrame, least: int) -> DataFrame:
    """(rep, other, ends): for each class the other classes it asks, and the ends of the windows it asks them for."""
    rows = stretches.where(F.size("hot") > 0).select("rep", "hot", F.transform(F.filter("places", lambda p: p["hot"]), lambda p: p["pos"]).alias("hot_pos"))
    schema = "rep binary, h1 bigint, h2 bigint, end int"
    wanted = _arrow_schema(stretches.sparkSession, schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for rep, hot, pos in zip(*(batch.column(c).to_pylist() for c in ("rep", "hot", "hot_pos"))):
                for r, (a, _, ends) in zip(hot, _regions(pos, hot[-1]["start"] + len(hot[-1]["text"]), least)):
                    codes = np.frombuffer(r["text"].encode("utf-32-le"), np.uint32)
                    end = np.concatenate([np.arange(lo, hi + 1) for lo, hi in ends])
                    h1, h2 = windows(codes, least)[end - least - a], windows(mix(codes.astype(np.uint64) + np.uint64(7)), least)[end - least - a]
                    yield pa.RecordBatch.from_arrays([pa.array([rep] * len(end), pa.binary()), pa.array(mix(h1).view(np.int64)), pa.array(mix(h2).view(np.int64)), pa.array(end.astype(np.int32))], schema=wanted)

    held = cut(rows.mapInArrow(run, schema))
    several = held.groupBy("h1", "h2").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    asked = held.join(several, ["h1", "h2"]).select("rep", F.when(F.col("rep") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other"), "end")
    return asked.groupBy("rep", "other").agg(F.sort_array(F.collect_set("end")).alias("ends"))


def _queries(stretches: DataFrame, least: int) -> DataFrame:
    """(rep, shard, home, stretches, ends array<struct<lo, hi>>): what goes to which shard; the ends are asked for."""
    k = max(1, least // 3)
    ends = F.transform("pos", lambda p: F.struct((F.greatest(p + k, F.lit(least))).alias("lo"), (p + least).alias("hi")))
    near = lambda r, p: (r["start"] <= p) & (p + k <= r["start"] + F.length(r["text"]))
    out = (
        _cold_visits(stretches)
        .withColumn("ends", ends)
        .join(stretches.select("rep", "cold"), "rep")
        .select("rep", "shard", "home", F.when(F.col("home"), F.col("cold")).otherwise(F.filter("cold", lambda r: F.exists("pos", lambda p: near(r, p)))).alias("stretches"), "ends")
    )
    if not stretches.where(F.size("hot") > 0).limit(1).count():
        return out
    asked = cut(_hot_visits(stretches, least))
    sized = stretches.where(F.size("hot") > 0).select("rep", _chars("hot").alias("chars"))
    homes = asked.select(F.col("other").alias("rep")).distinct()
    total = homes.join(sized, "rep").agg(F.sum("chars")).first()[0] or 0
    shard = lambda c: F.xxhash64(F.lit("hot"), F.pmod(F.xxhash64(c), F.lit(max(1, -(-total // SHARD_CHARS)))))
    no = F.array().cast("array<int>")
    both = asked.select("rep", shard("other").alias("shard"), F.lit(False).alias("home"), "ends").unionByName(homes.select("rep", shard("rep").alias("shard"), F.lit(True).alias("home"), no.alias("ends")))
    both = both.groupBy("rep", "shard").agg(F.max("home").alias("home"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("ends")))).alias("e"))
    hot = both.join(stretches.select("rep", "hot"), "rep")
    runs = F.transform("e", lambda e: F.struct(e.alias("lo"), e.alias("hi")))
    inside = lambda r: F.exists("e", lambda e: (r["start"] + least <= e) & (e <= r["start"] + F.length(r["text"])))
    hot = hot.select("rep", "shard", "home", F.when(F.col("home"), F.col("hot")).otherwise(F.filter("hot", inside)).alias("stretches"), runs.alias("ends"))
    return out.unionByName(hot)


def _in_copies(queries: DataFrame) -> DataFrame:
    """queries with ``copy`` and ``asks``: a shard that very many visit is indexed in several tasks, among which its visitors are spread."""
    load = queries.groupBy("shard").agg(F.ceil(F.sum(_chars("stretches")) / (VISITS_PER_INDEX * SHARD_CHARS)).cast("int").alias("copies"))
    spread = queries.join(load.where("copies > 1"), "shard", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    mine = F.pmod(F.xxhash64("rep"), F.col("copies")).cast("int")
    tasks = F.when(F.col("home"), F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(mine))
    return spread.withColumn("mine", mine).withColumn("copy", F.explode(tasks)).withColumn("asks", (F.col("copy") == F.col("mine")) & (F.size("ends") > 0)).drop("mine", "copies")


def _regions(pos: list[int], n: int, least: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Merged stretches of text around the places: (start, end, ranges of window ends to settle)."""
    k = max(1, least // 3)
    ends: list[list[int]] = []
    for p in pos:
        a, b = max(int(p) + k, least), min(int(p) + least, n)
        if ends and a <= ends[-1][1] + 1:
            ends[-1][1] = max(ends[-1][1], b)
        else:
            ends.append([a, b])
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for a, b in ends:
        if out and a - least <= out[-1][1]:
            out[-1] = (out[-1][0], b, [*out[-1][2], (a, b)])
        else:
            out.append((a - least, b, [(a, b)]))
    return out


def _joined(ends: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Ranges of ends as few as may be, none beyond ``limit``."""
    out: list[list[int]] = []
    for a, b in sorted(ends):
        b = min(b, limit)
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        elif a <= b:
            out.append([a, b])
    return [(a, b) for a, b in out]


Stretch = tuple[int, np.ndarray]


class Shard:
    """The index over the stretches of a shard's own texts, and the search for visitors' spans in it."""

    def __init__(self, homes: list[list[Stretch]], least: int) -> None:
        self.least = least
        codes, owner = [], []
        for r, stretches in enumerate(homes):
            for _, t in stretches:
                codes += [t + np.uint32(1), np.zeros(1, np.uint32)]
                owner.append(np.full(len(t) + 1, r, np.int32))
        self.fm = FMIndex(np.concatenate(codes), np.concatenate(owner)) if codes else None

    def ask(self, visitors: list[tuple[list[Stretch], list[tuple[int, int]], int]]) -> list[list[tuple[int, int]]]:
        """For each (stretches, ranges of ends, own) the spans of the least length that stand in an indexed text other than its own (-1: none is)."""
        found: list[list[tuple[int, int]]] = [[] for _ in visitors]
        flat = [(v, start, t) for v, (stretches, _, _) in enumerate(visitors) for start, t in stretches]
        base = np.concatenate([[0], np.cumsum([len(t) for _, _, t in flat])]).astype(np.int64)
        if self.fm is None or not base[-1]:
            return found
        least, fm = self.least, self.fm
        me = np.array([visitors[v][2] for v, _, _ in flat], np.int64)
        query = fm.symbols(np.concatenate([t for _, _, t in flat]) + np.uint32(1))
        ranges = []
        for r, (v, start, t) in enumerate(flat):
            shift = int(base[r]) - start
            for lo, hi in _joined([(max(a, start + least), b) for a, b in visitors[v][1]], start + len(t)):
                ranges += [(r, a + shift, min(a + RANGE - 1, hi) + shift, 0) for a in range(lo, hi + 1, RANGE)]
        todo = np.array(ranges, np.int64).reshape(-1, 4)
        # tests under way: stretch, range of ends, end under test, place reached, kind of test, range in the index
        live = np.empty((8, 0), np.int64)
        over: list[np.ndarray] = []
        waiting = 0
        while len(todo) or live.shape[1] or over:
            if len(todo):
                # first the last end, then the first one, which a bad test pushes far ahead, then near the last
                r, lo, hi, kind = todo.T
                end = np.where(kind == 0, hi, np.where(kind == 1, lo, lo + (hi - lo) * 8 // 10))
                new = np.stack([r, lo, hi, end, end, kind, np.zeros(len(r), np.int64), np.full(len(r), fm.n, np.int64)])
                live, todo = np.concatenate([live, new], 1), todo[:0]
            at = live[4]
            lo, hi, ok = fm.back(query[at - 1], live[6], live[7], me[live[0]])
            live[4] = at - ok
            live[6], live[7] = lo, hi
            more = ok & (live[4] > live[1] - least)
            if not more.all():
                over.append(live[:6, ~more])
                waiting += over[-1].shape[1]
                live = live[:, more]
            if over and (waiting * 8 > live.shape[1] or not live.shape[1]):
                r, lo, hi, end, start, kind = np.concatenate(over, 1)
                over, waiting = [], 0
                good = end - start >= least
                for a, s, e in zip(r[good].tolist(), start[good].tolist(), end[good].tolist()):
                    v, first, _ = flat[a]
                    found[v].append((s - int(base[a]) + first, e - int(base[a]) + first))
                # a good end settles all ends from start + least on; a bad one those up to start - 1 + least
                left = np.stack([r, lo, np.where(good, start + least - 1, end - 1), np.where(good | (kind == 0), 1, 2)], 1)
                right = np.stack([r, np.where(good, end + 1, start + least), hi, np.where(good | (kind == 1), 2, 1)], 1)
                todo = np.concatenate([left[left[:, 1] <= left[:, 2]], right[right[:, 1] <= right[:, 2]]])
        return [_merge(f) for f in found]


def match_shard(texts: list[np.ndarray], places: list, home: list[bool], least: int) -> list[list[tuple[int, int]]]:
    """The spans of all visitors of one shard, those at home among them."""
    regions = [_regions(p, len(t), least) for t, p in zip(texts, places)]
    stretches = [[(a, t[a:b]) for a, b, _ in rs] for t, rs in zip(texts, regions)]
    at = [r for r, h in enumerate(home) if h]
    number = {r: n for n, r in enumerate(at)}
    asked = [(stretches[r], [e for _, _, es in regions[r] for e in es], number.get(r, -1)) for r in range(len(texts))]
    return Shard([stretches[r] for r in at], least).ask(asked)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def shared_spans(documents: DataFrame, least: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, spans array<struct<start, end>>, shared_chars, share) of the records that share a span.

    Positions are code points from 0, ends exclusive; touching spans are merged.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    kind = dict(docs.dtypes)["doc_id"]
    marked = cut(fingerprints(docs, least))
    members = marked.select("digest", "doc_id", "n_chars").distinct()
    k = max(1, least // 3)
    # copies of a text count here by a short key of their digest; they become one class with their text
    at = marked.select("doc_id", F.xxhash64("digest").alias("h"), F.explode("fps").alias("f")).select("f.fp", "h", "doc_id", "f.pos")
    frequent = at.groupBy("fp").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("fp", "n")
    found = at.join(frequent, "fp").withColumn("hot", F.col("n") * (2 * least - k) > SHARD_CHARS)
    places = cut(found.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("pos", "fp", "n", "hot"))).alias("places")))
    stretches = cut(_stretches(docs, places, least))
    queries = _queries(stretches, least)
    queries = _in_copies(cut(queries))
    schema = "rep binary, spans array<struct<start:int,end:int>>"
    wanted = _arrow_schema(documents.sparkSession, schema)
    columns = ("shard", "copy", "home", "asks", "rep", "stretches", "ends")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, homes, asking, size = None, None, [], [], 0

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal shard, asking, size
            if shard is None:
                shard = Shard(homes, least)
                homes.clear()
            found = shard.ask([x[1:] for x in asking])
            kept = [(x[0], [{"start": a, "end": b} for a, b in f]) for x, f in zip(asking, found) if f]
            asking, size = [], 0
            if kept:
                yield pa.RecordBatch.from_pydict({"rep": [k for k, _ in kept], "spans": [f for _, f in kept]}, schema=wanted)

        for batch in it:
            for s, c, home, asks, rep, held, ends in zip(*(batch.column(x).to_pylist() for x in columns)):
                if (s, c) != key:
                    if asking:
                        yield from answer()
                    key, shard, n = (s, c), None, 0
                    homes.clear()
                mine = [(r["start"], np.frombuffer(r["text"].encode("utf-32-le"), np.uint32)) for r in held]
                if home:
                    homes.append(mine)
                    n += 1
                if asks:
                    asking.append((rep, mine, [(e["lo"], e["hi"]) for e in ends], n - 1 if home else -1))
                    size += sum(len(t) for _, t in mine)
                if not home and size > ASK_CHARS:
                    yield from answer()
        if asking:
            yield from answer()

    # those at home come first, so that the index stands before visitors stream through it
    matched = queries.select(*columns).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("home").desc()).mapInArrow(run, schema)
    per_class = matched.select("rep", F.explode("spans").alias("s")).groupBy("rep").agg(F.sort_array(F.collect_set("s")).alias("all"))
    start = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(-1).alias("a"), F.lit(-1).alias("b"))
    merged = F.aggregate(
        "all",
        start,
        lambda x, s: F.when(s["start"] <= x["b"], F.struct(x["done"].alias("done"), x["a"].alias("a"), F.greatest(x["b"], s["end"]).alias("b"))).otherwise(
            F.struct(F.when(x["b"] < 0, x["done"]).otherwise(F.concat(x["done"], F.array(F.struct(x["a"].alias("start"), x["b"].alias("end"))))).alias("done"), s["start"].alias("a"), s["end"].alias("b"))
        ),
        lambda x: F.concat(x["done"], F.array(F.struct(x["a"].alias("start"), x["b"].alias("end")))),
    )
    per_class = per_class.select(F.lower(F.hex("rep")).alias("digest"), merged.alias("spans"))
    copies = members.groupBy("digest").agg(F.count("*").alias("copies"))
    out = members.join(copies, "digest").join(per_class, "digest", "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_chars").alias("end")))
    out = out.withColumn("spans", F.when(F.col("copies") > 1, whole).otherwise(F.col("spans"))).where(F.col("spans").isNotNull())
    chars = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_chars", "spans", chars.alias("shared_chars")).withColumn("share", F.col("shared_chars") / F.col("n_chars"))
