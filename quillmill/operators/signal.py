"""Sound as arrays of samples in a column: levels, bounds, pauses, conditioning. All inside the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillmill.functions.text import col


def peak(c: Column | str) -> Column:
    """The largest magnitude, 0 of none."""
    return F.coalesce(F.array_max(F.transform(col(c), lambda x: F.abs(x))).cast("double"), F.lit(0.0))


def rms(c: Column | str) -> Column:
    """Root mean square, 0 of none."""
    total = F.aggregate(col(c), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(col(c)) > 0, F.sqrt(total / F.size(col(c)))).otherwise(F.lit(0.0))


def dbfs(level: Column, floor: float = 1e-12) -> Column:
    """Decibels below full scale."""
    return F.lit(20.0) * F.log10(F.greatest(level, F.lit(floor)))


def clamp(c: Column | str) -> Column:
    """Samples between -1 and 1; what is no number becomes 0."""
    return F.transform(col(c), lambda x: F.when(F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double")))))


def clipped(c: Column | str) -> Column:
    """How many samples lie outside -1 to 1."""
    return F.size(F.filter(col(c), lambda x: F.abs(x) > 1))


def bounds(c: Column | str, floor: float) -> Column:
    """struct<first, last>: where the signal first and last exceeds the floor; null for silence."""
    idx = F.filter(F.transform(col(c), lambda x, i: F.when(F.abs(x) > floor, i)), lambda i: i.isNotNull())
    return F.when(F.size(idx) > 0, F.struct(F.array_min(idx).alias("first"), F.array_max(idx).alias("last")))


def frame_levels(c: Column | str, hop: int) -> Column:
    """The level in decibels of each whole frame of ``hop`` samples."""
    n = F.floor(F.size(col(c)) / hop).cast("int")
    frames = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(col(c), k * hop + 1, F.lit(hop)))).otherwise(F.array().cast("array<array<float>>"))
    return F.transform(frames, lambda f: F.lit(10.0) * F.log10(F.greatest(F.aggregate(f, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")) / hop, F.lit(1e-12))))


def envelope(df: DataFrame, key: str, samples: str, hop: int, least: int) -> DataFrame:
    """(key, frames, level, flatness, range_db): mean, deviation and the span from P10 to P95 of frame levels; null under ``least`` frames."""
    e = df.select(key, frame_levels(samples, hop).alias("l")).withColumn("s", F.array_sort("l"))
    n = F.size("l")
    mean = F.aggregate("l", F.lit(0.0).cast("double"), lambda a, x: a + x) / n
    e = e.withColumn("level", mean)
    dev = F.sqrt(F.aggregate("l", F.lit(0.0).cast("double"), lambda a, x: a + (x - F.col("level")) * (x - F.col("level"))) / n)
    at = lambda p: F.element_at("s", F.floor((n - 1) * p + 0.5).cast("int") + 1)
    ok = n >= least
    return e.select(key, n.alias("frames"), *(F.when(ok, x).alias(a) for a, x in (("level", F.round("level", 6)), ("flatness", F.round(dev, 6)), ("range_db", F.round(at(0.95) - at(0.1), 6)))))


def pauses(df: DataFrame, key: str, samples: str, floor: float, least_run: int, bridge: int, least: int) -> DataFrame:
    """(key, first, last): quiet stretches strictly inside the signal.

    Runs of ``least_run`` quiet samples or more are kept, runs at most ``bridge`` samples apart are
    one, and those of ``least`` samples or more that touch neither end are pauses. Runs are found on the
    array of each sound, so no sample becomes a row.
    """
    schema = f"{key} {dict(df.dtypes)[key]}, first int, last int"
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows, first, last = [], [], []
            sounds = batch.column(1)
            for r in range(batch.num_rows):
                if not sounds[r].is_valid:
                    continue
                found = quiet_runs(sounds[r].values.to_numpy(zero_copy_only=False), floor, least_run, bridge, least)
                rows += [r] * len(found)
                first += [a for a, _ in found]
                last += [b for _, b in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(first, pa.int32()), pa.array(last, pa.int32())], schema=wanted)

    return df.select(key, samples).mapInArrow(run, schema)


def quiet_runs(x: np.ndarray, floor: float, least_run: int, bridge: int, least: int) -> list[tuple[int, int]]:
    """(first, last) of the pauses of one sound."""
    quiet = np.zeros(len(x) + 2, np.int8)
    quiet[1:-1] = np.abs(x) < floor
    step = np.diff(quiet)
    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
    long = b - a + 1 >= least_run
    a, b = a[long], b[long]
    if not len(a):
        return []
    parted = np.concatenate([[True], a[1:] - b[:-1] - 1 > bridge])
    a, b = a[parted], b[np.append(np.flatnonzero(parted)[1:] - 1, len(b) - 1)]
    ok = (b - a + 1 >= least) & (a > 0) & (b < len(x) - 1)
    return list(zip(a[ok].tolist(), b[ok].tolist()))


# Level aimed at and ceiling in decibels, and spans in seconds, of a conditioned sound.
TARGET_DB, CEILING_DB, FLOOR_DB, FADE, LEAST_PAUSE = -20.0, -1.0, -50.0, 0.01, 0.12


def condition(x: np.ndarray, rate: int, lead: float = 0.03, tail: float = 0.1, gap: float = 0.0, floor_db: float = FLOOR_DB) -> tuple[np.ndarray, dict]:
    """16-bit samples of a sound trimmed to its speech, levelled, faded and followed by ``gap`` seconds of silence; what was measured.

    ``lead`` and ``tail`` seconds stay around the speech; the gain brings the level to the target unless the peak would pass
    the ceiling. A silent sound keeps its gap alone.
    """
    x = np.nan_to_num(np.asarray(x, np.float64))
    floor, quiet = 10 ** (floor_db / 20), np.zeros(round(gap * rate), np.int16)
    loud = np.flatnonzero(np.abs(x) > floor)
    if not len(loud):
        return quiet, {"speech_sec": 0.0, "gap_sec": gap, "gain_db": 0.0, "raw_peak": 0.0, "pauses": []}
    x = x[max(0, loud[0] - round(lead * rate)) : loud[-1] + 1 + round(tail * rate)]
    level, top = np.sqrt((x**2).mean()), np.abs(x).max()
    gain = min(10 ** (TARGET_DB / 20) / level, 10 ** (CEILING_DB / 20) / top)
    runs = quiet_runs(x, floor, max(1, rate // 100), max(1, rate // 200), round(LEAST_PAUSE * rate))
    n, fade = len(x), max(1, round(FADE * rate))
    ramp = np.minimum(1.0, np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)) / fade)
    pcm = np.clip(np.floor(x * gain * ramp * 32767 + 0.5), -32768, 32767).astype(np.int16)
    measured = {"speech_sec": n / rate, "gap_sec": gap, "gain_db": float(20 * np.log10(gain)), "raw_peak": float(top), "pauses": [(a / rate, (b + 1) / rate) for a, b in runs]}
    return np.concatenate([pcm, quiet]), measured


def conditioned(df: DataFrame, keys: list[str], samples: str, rate: int, gap: float = 0.0) -> DataFrame:
    """(keys, pcm binary, speech_sec, gap_sec, gain_db, raw_peak, pauses) of every sound; null sounds have no row."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", pcm binary, speech_sec double, gap_sec double, gain_db double, raw_peak double, pauses array<struct<start:double,end:double>>"
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sounds = batch.column(len(keys))
            made = [condition(sounds[r].values.to_numpy(zero_copy_only=False), rate, gap=gap) for r in range(batch.num_rows)]
            cols = {"pcm": [p.astype("<i2").tobytes() for p, _ in made], "pauses": [[{"start": a, "end": b} for a, b in m["pauses"]] for _, m in made]}
            cols |= {c: [m[c] for _, m in made] for c in ("speech_sec", "gap_sec", "gain_db", "raw_peak")}
            yield pa.RecordBatch.from_arrays([batch.column(k) if k in keys else pa.array(cols[k], wanted.field(k).type) for k in wanted.names], schema=wanted)

    return df.select(*keys, samples).where(F.col(samples).isNotNull()).mapInArrow(run, schema)


def gain_and_fade(c: Column | str, gain: Column, fade: int) -> Column:
    """Samples times gain with a linear fade at both ends, as 16-bit numbers."""
    n = F.size(col(c))

    def one(x: Column, i: Column) -> Column:
        ramp = F.least(F.lit(1.0), (i + 1) / F.lit(float(fade)), (n - i) / F.lit(float(fade)))
        y = x.cast("double") * gain * ramp * 32767
        return F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(y + 0.5))).cast("int")

    return F.transform(col(c), one)


def concat_waves(parts: Column, gap: int) -> Column:
    """Sounds one after the other with ``gap`` silent samples between them."""
    silence = F.array_repeat(F.lit(0.0).cast("float"), gap)
    return F.flatten(F.transform(parts, lambda x, i: F.when(i > 0, F.concat(silence, x)).otherwise(x)))


def length_mask(length: Column, longest: Column) -> Column:
    """1 for places within a length, 0 for padding."""
    return F.transform(F.sequence(F.lit(0), longest - 1), lambda j: F.when(j < length, 1).otherwise(0))


def code_units(c: Column | str, width: int) -> Column:
    """Code points of a text padded with 0 to ``width``."""
    points = F.transform(F.filter(F.split(col(c), ""), lambda x: x != ""), lambda x: F.ascii(x))
    return F.slice(F.concat(points, F.array_repeat(F.lit(0), width)), 1, width)
