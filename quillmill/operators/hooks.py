"""Places for external speech and language models, with deterministic stand-ins.

A hook gets a batch of texts and returns a batch of results; it runs in ``mapInPandas`` and may load
its model once per worker. Without an engine of that name the call fails before any work starts.
"""

import subprocess
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Speech = Callable[[list[str], list[float]], list[np.ndarray]]
ENGINES: dict[str, Speech] = {}


def register_engine(name: str, speak: Speech) -> None:
    """Make an engine known by name."""
    ENGINES[name] = speak


def stand_in(texts: list[str], speeds: list[float], rate: int = 100) -> list[np.ndarray]:
    """A tone per text: 0.38 seconds a word at speed 1, its pitch from the text's checksum, silence at full stops."""
    out = []
    for t, s in zip(texts, speeds):
        words = (t or "").split()
        n = int(round(len(words) * 0.38 * rate / max(s, 0.5)))
        x = np.sin(np.arange(n) * (0.5 + zlib.crc32((t or "").encode()) % 100 / 100)) * 0.3
        for k, w in enumerate(words):
            if w[-1] in ".!?":
                at = int((k + 1) * n / len(words))
                x[max(0, at - rate // 5) : at] = 0
        out.append(x.astype(np.float32))
    return out


register_engine("stand-in", stand_in)


def program_engine(command: list[str], rate: int) -> Speech:
    """An engine that is a program: text on its input, 16-bit samples on its output; ``{scale}`` in the command is the length scale."""

    def speak(texts: list[str], speeds: list[float]) -> list[np.ndarray]:
        out = []
        for t, s in zip(texts, speeds):
            done = subprocess.run([a.replace("{scale}", f"{1 / s:.3f}") for a in command], input=(t or "").encode(), capture_output=True, check=True)
            out.append(np.frombuffer(done.stdout[: len(done.stdout) // 2 * 2], "<i2").astype(np.float32) / 32768)
        return out

    del rate
    return speak


def model_engine(load: Callable[[], Callable[[str, float], np.ndarray]], pieces: Callable[[str], list[str]] | None = None, gap: int = 0) -> Speech:
    """An engine that is a model in the process: loaded once per worker; a text's pieces are spoken and joined with ``gap`` silent samples."""
    held: list[Callable[[str, float], np.ndarray]] = []

    def speak(texts: list[str], speeds: list[float]) -> list[np.ndarray]:
        if not held:
            held.append(load())
        out = []
        for t, s in zip(texts, speeds):
            parts = [np.asarray(held[0](p, s), np.float32) for p in (pieces(t or "") if pieces else [t or ""])]
            quiet = np.zeros(gap, np.float32)
            out.append(np.concatenate([x for n, p in enumerate(parts) for x in ([quiet, p] if n else [p])]) if parts else np.zeros(0, np.float32))
        return out

    return speak


def synthesise(chunks: DataFrame, engine: str = "stand-in") -> DataFrame:
    """chunks (text, speed, ...) with ``samples``."""
    speak = ENGINES[engine]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(samples=[x.tolist() for x in speak(pdf["text"].tolist(), pdf["speed"].astype(float).tolist())])

    return chunks.mapInPandas(run, chunks.withColumn("samples", F.lit(None).cast("array<float>")).schema)


def durations(chunks: DataFrame, engine: str = "stand-in", rate: int = 100) -> DataFrame:
    """chunks (text, speed, ...) with ``seconds`` counted from the engine's samples in place of the text."""
    speak = ENGINES[engine]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            samples = speak(pdf["text"].tolist(), pdf["speed"].astype(float).tolist())
            yield pdf.drop(columns="text").assign(seconds=[len(x) / rate for x in samples])

    return chunks.mapInPandas(run, chunks.drop("text").withColumn("seconds", F.lit(0.0)).schema)


def stale(measured: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Keys whose recorded size in bytes differs from the file's, or that have no file."""
    return measured.join(files.select(key, F.col("bytes").alias("__now")), key, "left").where(~F.col("bytes").eqNullSafe(F.col("__now"))).select(key)


def cache_action(version: Column, pauses: Column, current: int = 2) -> Column:
    """What a cached chunk needs: nothing, a new timeline from its pauses, or to be rendered anew."""
    return F.when(version == current, "hit").when(pauses.isNotNull(), "retime").otherwise("render")
