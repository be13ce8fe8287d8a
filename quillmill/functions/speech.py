"""Text as a speech engine takes it: its own cleaning, and packing by characters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmill.functions.text import WS, col, trim

# Languages of the engine, signs it cannot say, and what others become.
LANGUAGES = "en ko ja ar bg cs da de el es et fi fr hi hr hu id it lt lv nl pl pt ro ru sk sl sv tr uk vi na".split()
PICTURES = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F8FF}\\x{1F900}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}]+"
SIGNS = {"–": "-", "‑": "-", "—": "-", "_": " ", "“": '"', "”": '"', "‘": "'", "’": "'", "´": "'", "`": "'", "[": " ", "]": " ", "|": " ", "/": " ", "#": " ", "→": " ", "←": " "}
UNSAID = "[♥☆♡©\\\\]"
SPELT = {"@": " at ", "e.g.,": "for example, ", "i.e.,": "that is, "}
ENDING = "[.!?;:,'\"')\\]}…。」』】〉》›»]\\z"
# Abbreviations behind which no sentence ends for this engine.
NO_END = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "Ph.D.", "etc.", "e.g.", "i.e.", "vs.", "Inc.", "Ltd.", "Co.", "Corp.", "St.", "Ave.", "Blvd."]


@F.pandas_udf(StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def compatible(c: Column | str) -> Column:
    """Compatibility pieces; ASCII texts stay in the JVM."""
    plain = ~col(c).rlike("[^\\x00-\\x7F]")
    return F.when(plain, col(c)).otherwise(_compatible(F.when(~plain, col(c))))


def engine_text(c: Column | str, lang: Column) -> Column:
    """The text between language marks, with nothing the engine stumbles over and a mark at its end; null for other languages."""
    t = F.regexp_replace(compatible(c), PICTURES, "")
    t = F.translate(t, "".join(SIGNS), "".join(SIGNS.values()))
    t = F.regexp_replace(t, UNSAID, "")
    for k, v in SPELT.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    for mark in ",.!?;:'":
        t = F.replace(t, F.lit(f" {mark}"), F.lit(mark))
    t = F.regexp_replace(F.regexp_replace(t, '"{2,}', '"'), "'{2,}", "'")
    t = trim(F.regexp_replace(t, f"{WS}+", " "))
    t = F.when(t.rlike(ENDING), t).otherwise(F.concat(t, F.lit(".")))
    return F.when(lang.isin(LANGUAGES), F.concat(F.lit("<"), lang, F.lit(">"), t, F.lit("</"), lang, F.lit(">")))


def engine_chunks(text: str, most: int = 300) -> list[str]:
    """Sentences of each paragraph packed to ``most`` characters; a longer one stands alone."""
    import re

    ends = re.compile("".join(f"(?<!{re.escape(a)})" for a in NO_END) + r"(?<!\b[A-Z]\.)(?<=[.!?])\s+")
    out: list[str] = []
    for p in re.split(r"\n\s*\n+", text.strip()):
        held = ""
        for s in ends.split(p.strip()) if p.strip() else []:
            if len(held) + len(s) + 1 <= most:
                held += (" " if held else "") + s
                continue
            if held:
                out.append(held.strip())
            held = s
        if held:
            out.append(held.strip())
    return out
