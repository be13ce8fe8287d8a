"""Grounding checks: numbers, quotations and names of a claim against its source, and vocabularies."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from quillmill.functions import text as T
from quillmill.operators import sentences as S
from quillmill.session import spread

# Fixed value: a quoted span.
QUOTE = "[“\"]([^”\"]{3,600})[”\"]"
# Words with a capital for other reasons than being a name.
CAPITALISED_ANYWAY = "i monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december english".split()


def number_issues(claims: DataFrame, sources: DataFrame, key: str = "id") -> DataFrame:
    """(key, number): numerals of two digits or more that no source holds. One shuffle by numeral."""
    said = claims.select(key, F.explode(T.numbers_in("text")).alias("number")).where(F.length(F.regexp_replace("number", r"\D", "")) >= 2).distinct()
    held = sources.select(F.explode(T.numbers_in("text")).alias("number")).distinct()
    return said.join(held, "number", "left_anti").select(key, "number")


def quotes(claims: DataFrame, key: str = "id") -> DataFrame:
    """(key, quote, norm): quoted spans of three words or more."""
    q = claims.select(key, F.explode(F.regexp_extract_all("text", F.lit(QUOTE), F.lit(1))).alias("quote")).distinct()
    return q.withColumn("norm", T.norm_text("quote")).where(F.size(F.split("norm", " ")) >= 3)


@F.pandas_udf(ArrayType(LongType()))
def _grams(s: pd.Series) -> pd.Series:
    """Hashes of the runs of three words of normalised texts, each once."""

    def one(text: str) -> list[int]:
        w = text.split(" ")
        runs = {" ".join(x).encode() for x in zip(w, w[1:], w[2:])}
        return [zlib.crc32(r) | zlib.adler32(r) << 31 for r in runs]

    return s.map(one, na_action="ignore")


def quote_issues(claims: DataFrame, sources: DataFrame, key: str = "id") -> DataFrame:
    """(key, quote): quotations that no source holds word for word.

    No source is compared with every quotation: sources are cut into runs of three words, and only
    those that have a quotation's first three words are looked at. What is shuffled are hashes of those
    runs with a hash of their text; a text itself travels only if it is a candidate.
    """
    asked = quotes(claims, key).withColumn("gram", F.get(_grams(F.array_join(F.slice(F.split("norm", " "), 1, 3), " ")), F.lit(0)))
    norm = spread(sources.select("text")).select(T.norm_text("text").alias("n")).where("n <> ''").withColumn("h", F.xxhash64("n"))
    grams = norm.select("h", F.explode(_grams("n")).alias("gram"))
    near = grams.join(asked.select("gram").distinct(), "gram", "left_semi")
    texts = norm.select("h", "n").join(near.select("h").distinct(), "h", "left_semi").distinct()
    found = asked.join(near, "gram").join(texts, "h").where(F.concat(F.lit(" "), F.col("n"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("norm"), F.lit(" "))))
    return asked.join(found.select(key, "quote").distinct(), [key, "quote"], "left_anti").select(key, "quote")


def vocabulary(sources: DataFrame) -> DataFrame:
    """(word): the distinct normalised words."""
    return sources.select(F.explode(F.array_distinct(F.split(T.norm_text("text"), " "))).alias("word")).where("word <> ''").distinct()


def names_in(claims: DataFrame, key: str = "id") -> DataFrame:
    """(key, name, sentence): capitalised words inside a sentence, each once with the first sentence that has it.

    The first word of a sentence, words after a colon, semicolon, dash or opening quote, and quoted
    words themselves are left out, and words with a capital anyway.
    """
    s = S.split_sentences(claims.select(key, T.collapse("text").alias("text")), key, "text")
    t = s.select(key, "sent_idx", "sentence", F.posexplode(F.split("sentence", f"{T.WS}+")).alias("i", "raw"), F.split("sentence", f"{T.WS}+").alias("all")).where("i > 0")
    before = F.get("all", F.col("i") - 1)
    t = t.where(~before.rlike("[:;—–-]\\z|^[“\"(]") & ~F.col("raw").rlike("^[“\"(]"))
    word = F.regexp_replace(F.regexp_replace("raw", "^[^A-Za-z]+|[^A-Za-z'’-]+\\z", ""), "['’]s\\z", "")
    names = t.select(key, word.alias("name"), "sent_idx", "sentence").where(F.col("name").rlike("^[A-Z][a-zA-Z'’-]{2,}\\z"))
    names = names.groupBy(key, "name").agg(F.min(F.struct("sent_idx", "sentence"))["sentence"].alias("sentence"))
    parts = F.filter(F.split(T.norm_text("name"), " "), lambda p: p != "")
    return names.withColumn("parts", parts).where((F.size("parts") > 0) & ~F.forall("parts", lambda p: p.isin(CAPITALISED_ANYWAY)))


def name_issues(claims: DataFrame, sources: DataFrame, key: str = "id") -> DataFrame:
    """(key, name): names of which some part is in no source; each is reported once."""
    names = names_in(claims, key)
    unknown = names.select(key, "name", F.explode("parts").alias("part")).join(vocabulary(sources).withColumnRenamed("word", "part"), "part", "left_anti")
    return unknown.select(key, "name").distinct()


def with_sentence(found: DataFrame, claims: DataFrame, needle: str, key: str = "id") -> DataFrame:
    """found (key, needle) with ``sentence``: the first of the claim's sentences that holds the needle, else the needle itself."""
    s = S.per_text(claims.join(found.select(key).distinct(), key, "left_semi"), key, "text", "n int, s string", lambda t: list(enumerate(S.sentence_list(t))))
    asked = found.select(key, needle).distinct()
    hit = asked.join(s, key).where(F.col("s").contains(F.col(needle))).groupBy(key, needle).agg(F.min(F.struct("n", "s"))["s"].alias("sentence"))
    return found.join(hit, [key, needle], "left").withColumn("sentence", F.coalesce("sentence", F.col(needle)))


def passage_issues(claims: DataFrame, passages: DataFrame, books: DataFrame, allowed: DataFrame) -> DataFrame:
    """(id, kind, detail, sentence) of claims (id, book, text) against their own passage.

    passages: (id, text), what a claim is about; books: (book, text), the whole books; allowed: (id, text), titles
    and names that a claim may use. Quotations and numbers must stand in the passage, numbers of two digits or more
    or in the allowed text; the parts of names in the book or in the allowed text. All joins are by id, number or word.
    """
    told = claims.select("id", "text").join(passages.select("id", F.concat(F.lit(" "), T.norm_text("text"), F.lit(" ")).alias("n")), "id")
    q = told.select("id", "text", "n", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(QUOTE), F.lit(0)).alias("whole"), F.regexp_extract_all("text", F.lit(QUOTE), F.lit(1)).alias("quote"))).alias("q"))
    q = q.withColumn("norm", T.norm_text("q.quote")).where((F.size(F.split("norm", " ")) >= 3) & ~F.col("n").contains(F.concat(F.lit(" "), F.col("norm"), F.lit(" "))))
    q = with_sentence(q.select("id", F.col("q.whole").alias("whole"), T.trim("q.quote").alias("detail")), claims, "whole")
    quote = q.select("id", F.lit("quote").alias("kind"), "detail", "sentence")
    numbers = lambda df: df.select("id", F.explode(T.numbers_in("text")).alias("detail")).distinct()
    said = claims.select("id", F.explode(T.numbers_in("text")).alias("detail")).where(F.length(F.regexp_replace("detail", r"\D", "")) >= 2)
    number = said.join(numbers(passages.select("id", "text").unionByName(allowed.select("id", "text"))), ["id", "detail"], "left_anti")
    number = with_sentence(number, claims, "detail").select("id", F.lit("number").alias("kind"), "detail", "sentence")
    parts = names_in(claims).join(claims.select("id", "book").distinct(), "id").select("id", "book", "name", "sentence", F.explode("parts").alias("word"))
    words = lambda df, k: df.select(k, F.explode(F.array_distinct(F.split(T.norm_text("text"), " "))).alias("word")).distinct()
    unknown = parts.join(words(books, "book"), ["book", "word"], "left_anti").join(words(allowed, "id"), ["id", "word"], "left_anti")
    name = unknown.select("id", F.lit("name").alias("kind"), F.col("name").alias("detail"), "sentence")
    return quote.unionByName(number).unionByName(name).distinct()


def still_there(issues: DataFrame, kept: DataFrame) -> DataFrame:
    """The issues whose sentence the kept text (id, text) still holds."""
    return issues.join(kept.select("id", F.col("text").alias("__kept")), "id").where(F.col("__kept").contains(F.col("sentence"))).drop("__kept")


def better_of(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, text, issues): of two drafts (id, text, issues) the second where it has text and is not worse."""
    both = first.join(second.select("id", F.col("text").alias("__t"), F.col("issues").alias("__n")), "id", "left")
    wins = (F.trim(F.coalesce("__t", F.lit(""))) != "") & (F.col("__n") <= F.col("issues"))
    return both.select("id", F.when(wins, F.col("__t")).otherwise(F.col("text")).alias("text"), F.when(wins, F.col("__n")).otherwise(F.col("issues")).alias("issues"))


def describe(kind: Column, detail: Column) -> Column:
    """The line that tells a writer what is wrong."""
    return (
        F.when(kind == "quote", F.format_string('The quotation "%s" does not appear word for word in the passage.', detail))
        .when(kind == "number", F.format_string("The number %s does not appear in the passage.", detail))
        .otherwise(F.format_string('"%s" is not mentioned anywhere in the book.', detail))
    )


def all_issues(claims: DataFrame, sources: DataFrame, key: str = "id") -> DataFrame:
    """(key, kind, detail, message) of all three checks."""
    parts = [("quote", quote_issues, "quote"), ("number", number_issues, "number"), ("name", name_issues, "name")]
    out = None
    for kind, f, c in parts:
        p = f(claims, sources, key).select(key, F.lit(kind).alias("kind"), F.col(c).alias("detail"))
        out = p if out is None else out.unionByName(p)
    return out.withColumn("message", describe(F.col("kind"), F.col("detail")))


def lexicon_words(entries: DataFrame, column: str = "entry") -> DataFrame:
    """(word): entries in small letters, parted at blanks and dashes, letters and apostrophes only, two or more."""
    e = entries.select(T.trim(F.lower(column)).alias("e")).where("e <> '' and not startswith(e, '#')")
    parts = e.select(F.explode(F.split("e", f"({T.WS}|-)+")).alias("p"))
    return parts.select(F.regexp_replace("p", "[^a-z']", "").alias("word")).where(F.length("word") >= 2).distinct()


def known_tokens(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, known): numbers and roman numerals, or a base form among the words or abbreviations.

    words: the union of the vocabularies that count, common words, the user's and the book's.
    """
    t = tokens.select("token").distinct().withColumn("w", T.normalise_token("token"))
    plain = F.col("token").rlike(r"(?i)^\d[\d.,:%-]*(st|nd|rd|th)?\z") | ((F.length("w") >= 2) & T.is_roman("w"))
    forms = t.select("token", F.explode(T.base_forms("w")).alias("word")).where("word <> ''")
    short = forms.sparkSession.createDataFrame([(a,) for a in T.ABBREVIATIONS], "word string")
    hit = forms.join(words.unionByName(short).distinct(), "word", "left_semi").select("token").distinct().withColumn("__hit", F.lit(True))
    return t.join(hit, "token", "left").select("token", (plain | F.coalesce("__hit", F.lit(False))).alias("known"))


def mood_scores(texts: DataFrame, lexicon: DataFrame, key: str = "id") -> DataFrame:
    """(key, mood, score): the weights of all keywords that a word's stems match; a word scores in every mood that lists it.

    lexicon: (mood, ord, keyword, weight). Partial sums are made before the shuffle.
    """
    w = texts.select(key, F.explode(F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda x: F.length(x) >= 3)).alias("w"))
    w = w.groupBy(key, "w").agg(F.count("*").alias("n"))
    forms = w.select(key, "n", F.explode(T.stems("w")).alias("keyword"))
    return forms.join(lexicon, "keyword").groupBy(key, "mood", "ord").agg(F.sum(F.col("n") * F.col("weight")).alias("score"))


def best_mood(texts: DataFrame, lexicon: DataFrame, key: str = "id") -> DataFrame:
    """(key, mood, score, runner_up, margin, confidence): the best of each text; without any hit the first mood, low."""
    s = mood_scores(texts, lexicon, key)
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "ord")
    top = s.withColumns({"rn": F.row_number().over(w), "second": F.coalesce(F.lead("score").over(w), F.lit(0))}).where("rn = 1")
    margin = F.when(F.col("second") == 0, 3.0).otherwise(F.round(F.col("score") / F.col("second"), 6))
    scored = top.select(key, "mood", "score", F.col("second").alias("runner_up"), margin.alias("margin"))
    first = lexicon.agg(F.min_by("mood", "ord").alias("__first"))
    out = texts.select(key).distinct().join(scored, key, "left").join(F.broadcast(first))
    level = F.when(F.col("score").isNull(), "low").when(F.col("margin") >= 1.8, "high").when(F.col("margin") >= 1.25, "medium").otherwise("low")
    return out.select(key, F.coalesce("mood", "__first").alias("mood"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("runner_up", F.lit(0)).alias("runner_up"), F.coalesce("margin", F.lit(0.0)).alias("margin"), level.alias("confidence"))
