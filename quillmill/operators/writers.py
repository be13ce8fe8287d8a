"""Language models behind one interface, with a deterministic stand-in: limits, retries, answers checked and put together."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators.sentences import sentence_list, word_count
from quillmill.plans import summary as P


class WriterError(Exception):
    """What a service says instead of an answer."""

    def __init__(self, code: str, retry_after: float | None = None) -> None:
        super().__init__(code)
        self.code, self.retry_after = code, retry_after

    @property
    def retryable(self) -> bool:
        return self.code in ("RATE_LIMITED", "SERVER", "TIMEOUT", "BAD_JSON")


@dataclass(frozen=True)
class Writer:
    """A provider: ``generate`` takes one request (a dict) and returns JSON text."""

    name: str
    generate: Callable[[dict], str]
    most_input_words: int = 30_000
    concurrency: int = 1


WRITERS: dict[str, Writer] = {}


def register_writer(writer: Writer) -> None:
    """Make a provider known by name."""
    WRITERS[writer.name] = writer


# Words of input a provider takes.
INPUT_WORDS = {"gemini": 60_000, "claude": 60_000, "mistral": 50_000, "openrouter": 50_000, "deepseek": 30_000}


def input_words(provider: str, tokens_per_minute: int = 12_000, context: int = 16_384) -> int:
    """What fits into one request; two providers tell by their quota or context."""
    if provider == "groq":
        return max(1000, int((tokens_per_minute - 4500) / 1.4))
    if provider == "ollama":
        return max(2000, int((context - 6000) / 1.4))
    return INPUT_WORDS.get(provider, 30_000)


def strict_schema(schema: object, unknown: tuple[str, ...] = ("additionalProperties", "$schema")) -> object:
    """A JSON schema without the keys that a dialect does not know, at any depth."""
    if isinstance(schema, dict):
        return {k: strict_schema(v, unknown) for k, v in schema.items() if k not in unknown}
    return [strict_schema(x, unknown) for x in schema] if isinstance(schema, list) else schema


def stand_in(request: dict) -> str:
    """The first sentences of the source that the budget holds."""
    out, words = [], 0
    for s in sentence_list(request["source"]):
        if words + word_count(s) > request["budget"]:
            break
        out.append(s)
        words += word_count(s)
    return json.dumps({"paragraphs": [" ".join(out)] if out else []})


register_writer(Writer("stand-in", stand_in))


def ask(writer: Writer, request: dict, attempts: int = 6, base: float = 5.0, cap: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> tuple[dict | None, str | None, int]:
    """(answer, error code, attempts made): asked again while the failure may pass, with growing waits or as told."""
    for n in range(1, attempts + 1):
        try:
            answer = json.loads(writer.generate(request))
            return answer, None, n
        except ValueError:
            error = WriterError("BAD_JSON")
        except WriterError as e:
            error = e
        if not error.retryable or n == attempts:
            return None, error.code, n
        sleep(min(cap, max(1.0, base * 2 ** (n - 1) if error.retry_after is None else error.retry_after)))
    return None, "CANCELLED", 0


def answers(items: DataFrame, writer: str = "stand-in", attempts: int = 6) -> DataFrame:
    """items (book_id, section, part, titles, source, budget) with ``text``, ``error`` and ``attempts``; a hook over partitions, no shuffle."""
    chosen = WRITERS[writer]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = [ask(chosen, {"source": s or "", "budget": int(b)}, attempts) for s, b in zip(pdf["source"], pdf["budget"])]
            texts = ["\n\n".join(p for x in a.get("paragraphs", []) for p in x.split("\n\n") if p.strip()) if a else None for a, _, _ in got]
            yield pdf.assign(text=texts, error=[e for _, e, _ in got], attempts=[n for _, _, n in got])

    schema = items.withColumns({"text": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "attempts": F.lit(0).cast("long")}).schema
    return items.mapInPandas(run, schema)


def trimmed(text: str | None, budget: int) -> str | None:
    """Whole sentences from the start while they fit; one at least."""
    if text is None or word_count(text) <= budget:
        return text
    out, words = [], 0
    for p in text.split("\n\n"):
        kept = []
        for s in sentence_list(p):
            if (out or kept) and words + word_count(s) > budget:
                return "\n\n".join([*out, " ".join(kept)] if kept else out)
            kept.append(s)
            words += word_count(s)
        out.append(" ".join(kept))
    return "\n\n".join(out)


def summaries(books: DataFrame, levels: DataFrame, minutes: float, writer: str = "stand-in") -> DataFrame:
    """(book_id, section, titles, text, missing): every book planned, written by a provider, trimmed and put together."""
    plans = P.plan_summaries(books, levels, minutes, most_input=WRITERS[writer].most_input_words).where("code is null")
    items = plans.select("book_id", F.explode("items").alias("i")).select("book_id", "i.section", "i.part", "i.titles", "i.source", "i.budget")
    written = answers(items, writer)
    cut = F.pandas_udf(lambda t, b: pd.Series([trimmed(x, int(y)) for x, y in zip(t, b)]), "string")
    kept = written.select("book_id", "section", "part", "titles", cut("text", "budget").alias("text"))
    return P.reassembled(kept.select("book_id", "section", "part", "titles"), kept.where(T.trim("text") != "").select("book_id", "section", "part", "text"))


def suggestion(texts: DataFrame, suggested: DataFrame, lexicon: DataFrame, key: str = "id") -> DataFrame:
    """(key, mood, by): the mood a provider suggests (key, mood) where it is a known one, else that of the words."""
    from quillmill.operators.grounding import best_mood

    known = lexicon.select("mood").distinct()
    s = suggested.join(known, "mood", "left_semi").select(key, F.col("mood").alias("__m"))
    local = best_mood(texts, lexicon, key).select(key, "mood")
    return local.join(s, key, "left").select(key, F.coalesce("__m", "mood").alias("mood"), F.when(F.col("__m").isNotNull(), "provider").otherwise("words").alias("by"))
