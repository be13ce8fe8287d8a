"""Text columns: white space, words, line shapes, titles, tokens.

Every function takes and returns Columns, so Catalyst sees through it. Null text gives null unless
a docstring says otherwise.
"""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white space of the upload format, as a regex class body.
WS_BODY = r"\t\n\x0B\f\r    -     　﻿"
WS = f"[{WS_BODY}]"
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
NOT_WS = f"[^{WS_BODY}]"

# Patterns of structured lines.
LIST_MARKER = r"^([•·●○▪◦‣*–—-][ \t]+|\(?\d{1,3}[.)][ \t]+|\(?[a-z][.)][ \t]+)"
HEADING_WORD = r"(?i)^(chapter|part|book|section|prologue|epilogue|introduction|foreword|preface|afterword|conclusion)\b"
NOT_THE_BOOK = (
    r"(?i)^(contents|table of contents|index|notes|endnotes|bibliography|selected bibliography|references|works cited|sources|acknowledge?ments"
    r"|about the authors?|also by\b.*|copyright|dedication|title page|permissions|credits|glossary|further reading|praise for\b.*"
    r"|a note on (the )?sources|list of illustrations)\z"
)
FOLIO = r"(?i)^[\[(]?\s*(\d{1,4}|[ivxlc]{1,8})\s*[\])]?\z"
ROMAN = r"(?i)^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})\z"
# Abbreviations that don't end a sentence.
ABBREVIATIONS = (
    "mr mrs ms dr prof rev hon st sr jr vs etc eg ie cf al fig no vol ch pp inc ltd co corp dept est approx min max "
    "jan feb mar apr jun jul aug sep sept oct nov dec"
).split()
# Words written small inside a title, and words that names don't hold.
SMALL_TITLE_WORD = r"(?i)^(a|an|and|at|by|for|in|of|on|or|the|to|with)\z"
NOT_IN_NAMES = r"(?i)^(of|the|and|a|an|to|in|on|for|with)\z"
# A heading that ends on one of these goes on in the next line.
FUNCTION_WORDS = "a an the of into to by or and for with in on from at as upon over under than toward towards within without is are not your their our its his her my vs".split()
STRUCTURAL = r"(?i)^(chapter|part|book|section|prologue|epilogue|introduction|foreword|preface|afterword|conclusion|contents|index|notes|appendix|glossary|bibliography|acknowledge?ments)\z"
# Tags of tracks with a voice in them.
VOCAL_TAGS = ("vocals", "vocal", "lyrics", "rap", "song", "singing", "acappella", "a_capella", "spoken_word", "male_vocals", "female_vocals", "choir")
TRAILING_WORD = r"(?i)\b(a|an|the|of|into|to|by|or|and|for|with|in|on|from|at|as|upon|over|under|than|toward|towards|within|without|your|their|our|its|his|her|my)\z"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """Without white space at both ends; looks at the ends alone, not at every character."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def words(c: Column | str) -> Column:
    """The runs of other characters between white space; none for blank text."""
    return F.filter(F.split(col(c), f"{WS}+"), lambda w: w != "")


def count_words(c: Column | str) -> Column:
    """Number of words, 0 for blank text."""
    return F.size(words(c))


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n", -1)


def collapse(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return trim(F.regexp_replace(col(c), f"{WS}+", " "))


def is_heading_like(c: Column | str) -> Column:
    """3 to 80 characters, no closing mark, a letter, and a structural word first or all capitals in at most 12 words."""
    t = trim(c)
    capitals = (t == F.upper(t)) & (F.size(F.split(t, f"{WS}+")) <= 12)
    return F.length(t).between(3, 80) & ~t.rlike(r"[.,;:]\z") & t.rlike("[A-Za-z]") & (t.rlike(HEADING_WORD) | capitals)


def line_kind(c: Column | str) -> Column:
    """blank, list, heading or paragraph; a list marker wins over the shape of a heading."""
    t = trim(c)
    return F.when(t == "", "blank").when(t.rlike(LIST_MARKER), "list").when(is_heading_like(t), "heading").otherwise("paragraph")


def list_marker(c: Column | str) -> Column:
    """The marker that opens a list item, null for other lines."""
    m = trim(F.regexp_extract(trim(c), LIST_MARKER, 1))
    return F.when(m != "", m)


def is_ordered_marker(c: Column | str) -> Column:
    return col(c).rlike("(?i)[0-9a-z]")


def heading_key(c: Column | str) -> Column:
    """Small ASCII letters, digits and single blanks; a blank before dropped marks stays at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(trim(c)), "[^a-z0-9 ]+", ""), f"{WS}+", " ")


def is_chapter_heading(c: Column | str) -> Column:
    t = trim(c)
    return F.length(t).between(3, 80) & t.rlike(HEADING_WORD)


def title_like(c: Column | str) -> Column:
    """A line that could be a title: short, with letters or digits, no closing mark, no quote first, no list item."""
    t = trim(c)
    return F.length(t).between(1, 80) & t.rlike("[A-Za-z0-9]") & ~t.rlike("[.!?,;:\"”’]\\z") & ~t.rlike("^[\"“‘'(]") & ~t.rlike(LIST_MARKER)


def text_has_letters(c: Column | str) -> Column:
    return col(c).rlike(r"\p{L}")


def is_real_heading(c: Column | str) -> Column:
    """Not a quotation, a sentence, two sentences, an index entry or an alphabet strip."""
    t = col(c)
    no = t.rlike("^[\"“‘']") | t.rlike("[.!][\"”’]?\\z") | t.rlike(f"[.!?]{WS}+[A-Z]") | (t.rlike(r"\d") & t.contains(",")) | t.rlike(f"^A{WS}?B{WS}?C{WS}?D")
    return F.length(t).between(1, 100) & ~no


def is_not_the_book(c: Column | str) -> Column:
    """A heading of front or back matter."""
    return trim(c).rlike(NOT_THE_BOOK)


def is_folio(c: Column | str) -> Column:
    """A page number, in digits or roman."""
    return trim(c).rlike(FOLIO)


def is_prose_line(c: Column | str) -> Column:
    """Twelve words or more, or a sentence's end."""
    return (count_words(c) >= 12) | trim(c).rlike("[.!?][\"”’)]?\\z")


def is_name_like(c: Column | str) -> Column:
    """Two to four capitalised words, none of them a function word."""
    w = words(c)
    return F.size(w).between(2, 4) & F.forall(w, lambda x: x.rlike(r"^[A-Z][a-zA-Z'’.-]*\z") & ~x.rlike(NOT_IN_NAMES))


def clean_title(c: Column | str) -> Column:
    """White space collapsed, closing marks dropped."""
    return trim(F.regexp_replace(collapse(c), r"[.,;:]+\z", ""))


def stem_of_filename(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\.[^.]+\z", "")


def title_from_name(c: Column | str) -> Column:
    """A file's name as a title: blanks for dashes and underscores, capitals but for small words."""
    base = collapse(F.regexp_replace(stem_of_filename(c), "[_-]+", " "))
    made = F.transform(F.split(base, " "), lambda w, i: F.when((i > 0) & w.rlike(SMALL_TITLE_WORD), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10**6))))
    return F.array_join(made, " ")


def meta_from_filename(c: Column | str) -> Column:
    """struct<title, author> of names like ``Title - Author``, either way round; null for others."""
    base = stem_of_filename(c)
    base = F.regexp_replace(base, r"(?i)_[^_]*\.(com|org|net)[^_]*_", " ")
    base = F.regexp_replace(base, r"\[[^\]]*\]|\([^)]*\)", " ")
    base = collapse(F.regexp_replace(base, "_", " "))
    parts = F.transform(F.split(base, f"{WS}+[-–—]{WS}+"), trim)
    a, b = parts[0], parts[1]
    pair = lambda t, w: F.struct(t.alias("title"), w.alias("author"))
    ok = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    return F.when(ok & is_name_like(F.get(parts, F.lit(1))), pair(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).when(ok & is_name_like(F.get(parts, F.lit(0))), pair(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))


def download_name(c: Column | str, fallback: str = "audiobook") -> Column:
    """A file's name without extension and odd characters, blanks as dashes, at most 80 characters."""
    base = F.regexp_replace(stem_of_filename(c), r"[^\w\s-]", "")
    base = F.substring(F.regexp_replace(trim(base), f"{WS}+", "-"), 1, 80)
    return F.coalesce(F.nullif(base, F.lit("")), F.lit(fallback))


def safe_name(c: Column | str, cap: int) -> Column:
    """The first ``cap`` characters with all but letters and digits as underscores."""
    return F.regexp_replace(F.substring(col(c), 1, cap), r"[^\p{L}\p{N}]", "_")


def straight_quotes(c: Column | str) -> Column:
    return F.translate(col(c), "‘’", "''")


def normalise_token(c: Column | str) -> Column:
    """Small ASCII letters and inner apostrophes."""
    return F.regexp_replace(F.regexp_replace(straight_quotes(F.lower(col(c))), "[^a-z']", ""), r"^'+|'+\z", "")


def normalise_word(c: Column | str) -> Column:
    """Small ASCII letters, digits and apostrophes, for matching spoken and shown words."""
    return F.regexp_replace(straight_quotes(F.lower(col(c))), "[^a-z0-9']", "")


def without(c: Column, n: int, extra: str = "") -> Column:
    base = F.substring(c, F.lit(1), F.length(c) - n)
    return F.concat(base, F.lit(extra)) if extra else base


def base_forms(c: Column | str) -> Column:
    """The forms a word may be derived from, itself first: plurals, tenses, degrees, doubled consonants undone."""
    word = col(c)
    w = F.regexp_replace(word, r"'s\z", "")
    keep = lambda cond, x: F.when(cond & (F.length(x) >= 3), x)
    stem = F.regexp_replace(w, r"(ing|ed)\z", "")
    double = (stem != w) & (F.length(stem) >= 4) & (F.substring(stem, -1, 1) == F.substring(stem, -2, 1))
    end = w.endswith
    forms = [
        word, F.when(w != word, w),
        keep(end("ies"), without(w, 3, "y")),
        keep(end("es"), without(w, 1)), keep(end("es"), without(w, 2)),
        keep(end("s") & ~end("ss"), without(w, 1)),
        keep(end("ed"), without(w, 1)), keep(end("ed"), without(w, 2)),
        keep(end("ing"), without(w, 3)), keep(end("ing"), without(w, 3, "e")),
        keep(end("ly"), without(w, 2)),
        keep(end("er"), without(w, 1)), keep(end("er"), without(w, 2)),
        keep(end("est"), without(w, 2)), keep(end("est"), without(w, 3)),
        keep(end("ness"), without(w, 4)), keep(end("ment"), without(w, 4)),
        keep(double, without(stem, 1)),
    ]
    return F.array_compact(F.array(*forms))


def stems(c: Column | str) -> Column:
    """A word and what is left without s, es, ed, ing, ies; no forms under 3 letters."""
    w = col(c)
    keep = lambda cond, x: F.when(cond & (F.length(x) >= 3), x)
    forms = [w, keep(w.endswith("s"), without(w, 1)), keep(w.endswith("es"), without(w, 2)), keep(w.endswith("ed"), without(w, 2)), keep(w.endswith("ing"), without(w, 3)), keep(w.endswith("ies"), without(w, 3, "y"))]
    return F.when(F.length(w) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(*forms))))


def is_roman(c: Column | str) -> Column:
    t = trim(c)
    return (F.length(t) > 0) & t.rlike(ROMAN)


def roman_value(c: Column | str) -> Column:
    """The value of a roman numeral, 0 for anything else."""
    t = F.lower(trim(c))
    value = F.create_map(*[F.lit(x) for kv in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in kv])
    values = F.transform(F.filter(F.split(t, ""), lambda x: x != ""), lambda x: F.element_at(value, x))
    total = F.aggregate(F.reverse(values), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, x: F.struct((a["sum"] + F.when(x < a["last"], -x).otherwise(x)).alias("sum"), x.alias("last")), lambda a: a["sum"])
    return F.when(is_roman(t), total).otherwise(F.lit(0))


def numbers_in(c: Column | str) -> Column:
    """The distinct numerals of a text, thousands commas dropped."""
    found = F.regexp_extract_all(col(c), F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), r"\.\z", "")))


def end_cleanly(c: Column | str) -> Column:
    """Ends on a sentence mark: adds a full stop, dropping commas and colons; blank stays empty."""
    t = trim(c)
    done = t.rlike("[.!?][\"'’”)\\]]?\\z")
    return F.when(t == "", "").when(done, t).otherwise(F.concat(F.regexp_replace(t, r"[,;:]+\z", ""), F.lit(".")))


def spoken_paragraph(c: Column | str) -> Column:
    """Collapsed, outer quotes dropped, ending on a sentence mark."""
    t = trim(F.regexp_replace(collapse(c), "^[\"“”]+|[\"“”]+\\z", ""))
    return F.when(t == "", "").when(t.rlike(r"[.!?]\z"), t).otherwise(F.concat(F.regexp_replace(t, r"[,;:]+\z", ""), F.lit(".")))


def flatten_marks(c: Column | str) -> Column:
    """A model's line as plain speech: no list marker, no emphasis marks; text without letters is empty."""
    t = F.regexp_replace(trim(c), LIST_MARKER, "")
    t = collapse(F.regexp_replace(t, "[*_#`>]+", ""))
    return F.when(~t.rlike("[A-Za-z]"), "").otherwise(end_cleanly(t))


def phrases(c: Column | str) -> Column:
    """The stretches between phrase marks and blanks."""
    return F.filter(F.split(col(c), "(?<=[,;:.!?…])[ \\t]+"), lambda x: trim(x) != "")


def count_matches(text: Column | str, needle: Column | str) -> Column:
    """Occurrences that don't overlap, without regard to case; 0 for needles under 2 characters."""
    t, n = F.lower(col(text)), F.lower(trim(needle))
    return F.when(F.length(n) < 2, 0).otherwise(((F.length(t) - F.length(F.replace(t, n, F.lit("")))) / F.length(n)).cast("int"))


def head_words(c: Column | str, n: int | Column) -> Column:
    """The first ``n`` words, joined by blanks."""
    return F.array_join(F.slice(words(c), F.lit(1), F.lit(n) if isinstance(n, int) else n), " ")


def excerpts(c: Column | str, head: int = 4000, tail: int = 2000) -> Column:
    """struct<opening, closing>: the first and the last characters, the closing from a word's start; null closing for short texts."""
    t = col(c)
    closing = F.regexp_replace(F.substring(t, -tail, tail), f"^{NOT_WS}*{WS}+", "")
    return F.struct(F.substring(t, 1, head).alias("opening"), F.when(F.length(t) > head + tail, closing).alias("closing"))


def sample_text(c: Column | str, limit: int = 20_000) -> Column:
    """The whole text up to ``limit`` characters, else three slices of a third: start, middle, end."""
    t, third = col(c), limit // 3
    middle = F.floor(F.length(t) / 2 - third / 2).cast("int")
    cut = F.concat_ws("\n", F.substring(t, 1, third), F.substring(t, middle + 1, F.lit(third)), F.substring(t, -third, third))
    return F.when(F.length(t) <= limit, t).otherwise(cut)


def initials(c: Column | str) -> Column:
    """The first letters of the first two words, as capitals."""
    return F.upper(F.array_join(F.transform(F.slice(words(c), 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def voice_title(label: Column | str, fallback: Column | str) -> Column:
    """What stands before the bar in a label."""
    t = trim(F.split_part(col(label), F.lit("|"), F.lit(1)))
    return F.coalesce(F.nullif(t, F.lit("")), col(fallback))


def voice_subtitle(label: Column | str, fallback: Column | str) -> Column:
    """What stands behind the first bar in a label."""
    t = trim(F.split_part(col(label), F.lit("|"), F.lit(2)))
    return F.coalesce(F.nullif(t, F.lit("")), col(fallback))


def split_fused_heading(c: Column | str, rest_words: int = 12) -> Column:
    """struct<title, rest>: a heading and the paragraph run into it, cut at the first small content word."""
    w = words(c)
    n = F.size(w)
    at = F.filter(F.sequence(F.lit(2), F.greatest(n - rest_words, F.lit(2))), lambda i: (i <= n - rest_words) & F.get(w, i).rlike("^[a-z]") & ~F.get(w, i).isin(FUNCTION_WORDS) & ~F.get(w, i).contains("-"))
    cut = F.when(n >= rest_words + 2, F.get(at, F.lit(0)))
    whole = F.struct(col(c).alias("title"), F.lit("").alias("rest"))
    return F.when(cut.isNotNull(), F.struct(F.array_join(F.slice(w, F.lit(1), cut), " ").alias("title"), F.array_join(F.slice(w, cut + 1, n), " ").alias("rest"))).otherwise(whole)


def continues_heading(title: Column | str, following: Column | str) -> Column:
    """Whether the next line belongs to the heading: after a function word, in small letters, or one capitalised word."""
    t, n = col(title), col(following)
    small = n.rlike("^[a-z]")
    runs_on = (count_words(n) <= 5) & ~n.rlike(f"^[b-hj-z]({WS}|\\z)")
    single = n.rlike("^[A-Z][a-z'’]+\\z") & (count_words(t) >= 2) & ~n.rlike(STRUCTURAL)
    return t.rlike(TRAILING_WORD) | F.when(small, runs_on).otherwise(single)


def has_vocal_tag(tags: Column | str, vocal: tuple[str, ...] = VOCAL_TAGS) -> Column:
    """Whether some tag of a track names a voice."""
    t = F.lower(F.coalesce(col(tags), F.lit("")))
    return F.exists(F.array(*[F.lit(v) for v in vocal]), lambda v: F.contains(t, v))


def highlight(text: Column | str, needles: Column) -> Column:
    """array<struct<text, hit>>: the text cut around the needles, again and again at the one that stands first; the earlier in the list on a tie."""
    t = F.translate(col(text), "\x02\x03", "  ")
    quoted = F.transform(F.filter(needles, lambda n: F.length(n) > 0), lambda n: F.concat(F.lit(r"\Q"), F.replace(n, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    mark = F.when(F.size(quoted) > 0, F.regexp_replace(t, F.concat(F.lit("("), F.array_join(quoted, "|"), F.lit(")")), F.lit("\x02$1\x03"))).otherwise(t)
    parts = F.filter(F.split(mark, "(?=\x02)|(?<=\x03)"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.translate(p, "\x02\x03", "").alias("text"), p.startswith("\x02").alias("hit")))


def norm_text(c: Column | str) -> Column:
    """Small letters without accents, everything but letters and digits as one blank (for grounding checks).

    One Arrow UDF, as there is no built-in for accents; its result is computed once however often it is used.
    """
    return _norm_text(col(c))


@F.pandas_udf(StringType())
def _norm_text(s: pd.Series) -> pd.Series:
    return s.map(plain_words, na_action="ignore")


#: Combining accents, to be dropped.
MARKS = dict.fromkeys(range(0x300, 0x370))
PLAIN = re.compile("[a-z0-9]+")


def plain_words(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(MARKS)
    return " ".join(PLAIN.findall(text))
