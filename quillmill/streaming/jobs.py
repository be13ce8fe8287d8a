"""Jobs and requests as streams: life cycle, heartbeats, framing, windows of what is kept, carried text, patience."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From a state by a command to a state; what is not listed changes nothing.
MOVES = {
    ("idle", "start"): "starting", ("done", "start"): "starting", ("cancelled", "start"): "starting", ("error", "start"): "starting",
    ("starting", "progress"): "generating", ("generating", "progress"): "generating", ("generating", "merge"): "merging", ("merging", "end"): "done", ("generating", "end"): "done",
    **{(s, "cancel"): "cancelled" for s in ("starting", "generating", "merging")}, **{(s, "fail"): "error" for s in ("starting", "generating", "merging")},
}
ACTIVE = ("starting", "generating", "merging")


def moved(state: str, commands: list[str]) -> str:
    """The state after commands in order."""
    for c in commands:
        state = MOVES.get((state, c), state)
    return state


STATES = ("idle", *ACTIVE, "done", "cancelled", "error")


def lifecycle(commands: DataFrame, key: str = "job", at: str = "ts", span: str = "1 hour") -> DataFrame:
    """(key, state, commands): where each job stands after its commands (key, at, command, and ``ord`` on a tie).

    What the commands of one span of time do to every state is worked out first, span by span, and the spans of a job
    are then gone through; so a job with very many commands is spread over tasks, and one row per span meets.
    """
    steps = F.create_map(*[F.lit(x) for (s, c), t in MOVES.items() for x in (f"{s} {c}", t)])
    listed = F.transform(F.sort_array(F.collect_list(F.struct(at, "ord", "command"))), lambda x: x["command"])
    spans = commands.groupBy(key, F.date_trunc(span.split()[-1], F.col(at).cast("timestamp")).alias("__span")).agg(listed.alias("c"))
    after = lambda s0: F.aggregate("c", F.lit(s0), lambda s, c: F.coalesce(F.element_at(steps, F.concat(s, F.lit(" "), c)), s))
    done = spans.select(key, "__span", F.size("c").alias("n"), F.create_map(*[x for s in STATES for x in (F.lit(s), after(s))]).alias("to"))
    g = done.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__span", F.map_entries("to").alias("to")))).alias("x"), F.sum("n").alias("commands"))
    state = F.aggregate("x", F.lit("idle"), lambda s, x: F.element_at(F.map_from_entries(x["to"]), s))
    return g.select(key, state.alias("state"), "commands")


def lifecycle_stream(commands: DataFrame, key: str = "job", at: str = "ts") -> DataFrame:
    """(key, state, commands) as a stream: one row for a job whenever it gets commands; its state is kept between batches."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = dict(commands.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        now, seen = state.get if state.exists else ("idle", 0)
        rows = pd.concat(list(batches)).sort_values([at, "ord"])
        now, seen = moved(now, rows["command"].tolist()), seen + len(rows)
        state.update((now, seen))
        yield pd.DataFrame({key: [k[0]], "state": [now], "commands": [seen]})

    return commands.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string, commands long", "state string, commands long", "update", GroupStateTimeout.NoTimeout)


def heartbeats(events: DataFrame, key: str, at: str = "ts", every: int = 15) -> DataFrame:
    """(key, at, pings): how many pings fill the silence before each event."""
    w = Window.partitionBy(key).orderBy(at)
    gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))
    return events.select(key, at).distinct().withColumn("pings", F.floor(F.greatest(gap - 1, F.lit(0)) / (every * 1_000_000))).where("pings > 0")


def framed(reads: DataFrame, key: str, order: str = "ord", data: str = "data", ends: tuple[str, ...] = ("done", "error")) -> DataFrame:
    """(key, n, line): the lines of each stream of reads, whatever was cut where; nothing behind a line whose type ends it."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, data))), lambda x: x[data]), "")
    lines = reads.groupBy(key).agg(text.alias("t")).select(key, F.posexplode(F.filter(F.split("t", "\n"), lambda x: F.trim(x) != "")).alias("n", "line"))
    last = F.when(F.get_json_object("line", "$.type").isin(*ends), F.col("n"))
    return lines.withColumn("__stop", F.min(last).over(Window.partitionBy(key))).where(F.col("__stop").isNull() | (F.col("n") <= F.col("__stop"))).drop("__stop")


def kept_window(accesses: DataFrame, key: str, item: str, at: str, size: int = 8) -> DataFrame:
    """(key, item, place): the ``size`` items that were used last."""
    last = accesses.groupBy(key, item).agg(F.max(at).alias("__at"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("__at").desc(), item))).where(F.col("place") <= size).drop("__at")


def wanted_ahead(playing: DataFrame, key: str, item: str, total: str, ahead: int = 2) -> DataFrame:
    """(key, item): the items to fetch before they are needed."""
    nxt = F.filter(F.sequence(F.col(item) + 1, F.col(item) + ahead), lambda i: i < F.col(total))
    return playing.select(key, F.explode(nxt).alias(item)).distinct()


def lanes(units: DataFrame, order: list[str | Column], slots: int) -> DataFrame:
    """units with ``lane`` and ``turn``: dealt in order to a bounded number of slots."""
    n = F.row_number().over(Window.orderBy(*order)) - 1
    return units.withColumn("__n", n).withColumns({"lane": F.col("__n") % slots, "turn": F.floor(F.col("__n") / slots).cast("int")}).drop("__n")


def carried(results: DataFrame, key: str, order: str, text: str = "text", block: int = 1000) -> DataFrame:
    """results with ``tail``: the last paragraph of the unit before, of the last one that has any text.

    The last one of each block of ``block`` units is found first, so that no task sees a whole feed.
    """
    last = F.element_at(F.filter(F.split(text, "\n{2,}"), lambda p: F.trim(p) != ""), -1)
    some = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", F.struct(F.col(order).alias("o"), last.alias("p")))
    r = results.withColumns({"__b": F.floor(F.col(order) / block), "__p": some})
    per = r.groupBy(key, "__b").agg(F.max("__p").alias("__p"))
    before = per.select(key, "__b", F.max("__p").over(Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = F.max("__p").over(Window.partitionBy(key, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    out = r.withColumn("__in", inside).join(before, [key, "__b"])
    return out.withColumn("tail", F.coalesce(F.col("__in.p"), F.col("__before.p"), F.lit(""))).drop("__b", "__p", "__in", "__before")


def shown(states: DataFrame, now: Column, patience: int = 60, at: str = "last_at") -> DataFrame:
    """states with ``waiting``: whether a snapshot is older than one waits for the next."""
    return states.withColumn("waiting", F.unix_micros(now) - F.unix_micros(at) > patience * 1_000_000)
