"""Planning a summary of a book: title and body, headings made whole, sections, their budgets, items and units.

Headings swallow lines, sections are folded and merged until they fit: each text is planned on its own, in one Arrow
pass without a shuffle of texts. Patterns and word lists are the library's own columns' (``functions.text``).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillmill.functions import narration as N
from quillmill.functions import text as T
from quillmill.operators.sentences import sentence_list, word_count
from quillmill.plans.budget import split_budget


def _re(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\z", r"\Z"), re.ASCII)


# Limits of a plan, in words, shares and numbers.
SMALL, LEAST_SECTION, LEAST_TARGET = 150, 60, 450
MOST_BUDGET, MOST_ITEMS, LONG_LINE = 1500, 8, 2000
SHARE, HEADING_SHARE, PER_MINUTE = 0.6, 0.35, 165
# A heading that names no more than its kind, and the numbers that follow one.
BARE = _re(r"(?i)^(chapter|part|book|section|volume|canto)\z")
NUMERAL = _re(r"(?i)^([IVXLC]+|\d{1,3}|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty)[.:)]?\z")
MARKER, WORD, NOT_BOOK, TRAILING, STRUCTURAL = (_re(p) for p in (T.LIST_MARKER, T.HEADING_WORD, T.NOT_THE_BOOK, T.TRAILING_WORD, T.STRUCTURAL))
NO_TITLE = _re("[.!?,;:\"”’]\\z|^[\"“‘'(]")
NO_HEADING = _re("^[\"“‘']|[.!][\"”’]?\\z|[.!?]\\s+[A-Z]|^A\\s?B\\s?C\\s?D")
PROSE_END = _re("[.!?][\"”’)]?\\z")
EXPLICIT = _re(r"(?i)^(chapter|part|book)\b")


def key_of(line: str) -> str:
    """The key that makes headings comparable."""
    return re.sub(r"\s+", " ", re.sub("[^a-z0-9 ]+", "", line.strip().lower()))


def titled(line: str) -> bool:
    t = line.strip()
    return 0 < len(t) <= 80 and bool(re.search("[A-Za-z0-9]", t)) and not NO_TITLE.search(t) and not MARKER.match(t)


def unfused(line: str, least: int = 12) -> tuple[str, str]:
    """A heading and the paragraph run into it."""
    w = line.split()
    for i in range(2, len(w) - least + 1 if len(w) >= least + 2 else 0):
        if w[i][:1].islower() and w[i][0].isascii() and w[i] not in T.FUNCTION_WORDS and "-" not in w[i]:
            return " ".join(w[:i]), " ".join(w[i:])
    return line, ""


def goes_on(title: str, after: str) -> bool:
    """Whether the next line belongs to the heading."""
    if TRAILING.search(title):
        return True
    if re.match("[a-z]", after):
        return len(after.split()) <= 5 and not re.match(r"[b-hj-z](\s|\Z)", after)
    return bool(re.match(r"[A-Z][a-z'’]+\Z", after)) and len(title.split()) >= 2 and not STRUCTURAL.match(after)


def whole_headings(at: list[int], lines: list[str], ahead: int = 4) -> list[tuple[str, str, int, int]]:
    """(title, text run into it, first line, last line) of headings that start on the lines ``at``.

    A bare heading takes the number and the title below it, a wrapped one up to two lines more; a line that was
    taken starts no heading of its own.
    """

    def following(i: int) -> int:
        return next((k for k in range(i + 1, min(len(lines), i + 1 + ahead)) if lines[k].strip()), -1)

    out: list[tuple[str, str, int, int]] = []
    for start in sorted(set(at)):
        if out and start <= out[-1][3]:
            continue
        (title, rest), end = unfused(lines[start].strip()), start
        if BARE.match(title):
            if (k := following(end)) >= 0 and NUMERAL.match(lines[k].strip()):
                title, end = f"{title} {re.sub('[.:)]$', '', lines[k].strip())}", k
            if (k := following(end)) >= 0 and titled(lines[k]) and not BARE.match(lines[k].strip()):
                title, end = f"{title}: {lines[k].strip()}", k
        for _ in range(2):
            k = following(end)
            if rest or k < 0 or not titled(lines[k]):
                break
            more, tail = unfused(lines[k].strip())
            if not goes_on(title, more):
                break
            title, rest, end = f"{title} {more}", tail, k
        out.append((title, rest, start, end))
    return out


def segmented(word: str, vocabulary: set[str]) -> list[str] | None:
    """The fewest known words of three letters or more (or a, i, of, to, in, is, we) that make up ``word``."""
    small = {"a", "i", "of", "to", "in", "is", "we", "it", "on", "or", "by", "an", "at", "as", "be"}
    best: list[list[str] | None] = [[]] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            w = word[start:end]
            if best[start] is not None and (w in small or (len(w) >= 3 and w in vocabulary)) and (best[end] is None or len(best[start]) + 1 < len(best[end])):
                best[end] = [*best[start], w]
    return best[-1]


def repaired(title: str, vocabulary: set[str]) -> str:
    """A heading with split words joined and fused words parted by the book's own words."""
    parts, out = title.split(), []
    while parts:
        w = parts.pop(0)
        if parts and re.fullmatch("[A-Za-z]+", w + parts[0]) and w.lower() not in vocabulary and (w + parts[0]).lower() in vocabulary:
            w += parts.pop(0)
        if re.fullmatch("[A-Za-z]{10,}", w) and w.lower() not in vocabulary and (cut := segmented(w.lower(), vocabulary)) and len(cut) > 1:
            w = " ".join(c.upper() if w.isupper() else c.capitalize() if not k or len(c) > 3 else c for k, c in enumerate(cut))
        out.append(w)
    return " ".join(out)


@dataclass
class Section:
    titles: list[str]
    lines: list[str]
    words: int = 0
    context: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.words = self.words or sum(map(word_count, self.lines))
        self.context = self.context or list(self.titles)

    def __add__(self, other: Section) -> Section:
        return Section(self.titles + other.titles, self.lines + other.lines, self.words + other.words, self.context + other.context)


def is_prose(lines: list[str]) -> bool:
    return bool(lines) and sum(word_count(x) >= 12 or bool(PROSE_END.search(x.strip())) for x in lines) >= 0.4 * len(lines)


def cut_sections(lines: list[str], at: list[int], vocabulary: set[str]) -> list[Section]:
    """The text between headings that start on ``at``, without front and back matter and lists at both ends."""
    marks = []
    for title, rest, start, end in whole_headings(at, lines):
        t = re.sub("[.,;:]+$", "", " ".join(repaired(title, vocabulary).split())).strip()
        if t and len(t) <= 100 and not NO_HEADING.search(t) and not ("," in t and re.search(r"\d", t)):
            marks.append((t, rest, start, end))
    times = Counter(key_of(m[0]) for m in marks)
    last = {key_of(m[0]): n for n, m in enumerate(marks)}
    marks = [m for n, m in enumerate(marks) if times[key_of(m[0])] < 3 and last[key_of(m[0])] == n]
    ends = [m[2] for m in marks[1:]] + [len(lines)]
    full = lambda xs: [x for x in xs if x.strip()]
    sections = [Section([], full(lines[: marks[0][2] if marks else len(lines)]))]
    sections += [Section([t], full([rest, *lines[end + 1 : stop]])) for (t, rest, _, end), stop in zip(marks, ends)]
    total, before, kept = sum(s.words for s in sections) or 1, 0, []
    for s in sections:
        start, before = before / total, before + s.words
        named = any(NOT_BOOK.match(t) for t in s.titles)
        listed = s.words >= SMALL and not is_prose(s.lines)
        if start >= 0.8 and (named or listed):
            break
        if not named and not (listed and start < 0.1) and (s.titles or s.words):
            kept.append(s)
    return kept or [Section([], full(lines))]


def absorbed(sections: list[Section]) -> list[Section]:
    """Sections carried on until they have enough words; a rest joins the last."""
    out: list[Section] = []
    held: Section | None = None
    for s in sections:
        held = held + s if held else s
        if held.words >= SMALL:
            out.append(held)
            held = None
    return out if not held else [*out[:-1], out[-1] + held] if out else [held]


def choose(options: list[list[Section]], most: int) -> int:
    """The number of the option to plan by: explicit chapters, else the most sections that fit, else the fewest."""
    if sum(any(EXPLICIT.match(t) for t in s.titles) for s in options[0]) >= 3:
        return 0
    fit = [n for n, o in enumerate(options) if len(o) <= most]
    return max(fit, key=lambda n: (len(options[n]), -n)) if fit else min(range(len(options)), key=lambda n: (len(options[n]), n))


def headings(lines: list[str], levels: dict[str, int]) -> list[list[int]]:
    """Lines that may start a section: chapter words, measured headings of the first level, and of the first two."""
    chapters, first, second = [], [], []
    for i, x in enumerate(lines):
        t = x.strip()
        if not t or MARKER.match(t):
            continue
        word = 3 <= len(t) <= 80 and bool(WORD.match(t))
        capitals = 3 <= len(t) <= 80 and t == t.upper() and re.search("[A-Za-z]", t) and len(t.split()) <= 12 and t[-1] not in ".,;:"
        key = key_of(x)
        level = levels.get(key) if key else None
        if word:
            chapters.append(i)
        if level is not None or (word and t[-1] not in ".,;:") or capitals:
            if (level or 2) <= 1:
                first.append(i)
            if (level or 2) <= 2:
                second.append(i)
    return [chapters, first, second]


def pieces_of(lines: list[str], count: int) -> list[list[str]]:
    """A run of lines in ``count`` pieces of about equal words; very long lines are cut at sentences first."""
    if count <= 1:
        return [lines]
    atoms = [a for x in lines for a in (sentence_list(x) if word_count(x) > LONG_LINE else [x])]
    size, out, now, words = sum(map(word_count, atoms)) / count, [], [], 0
    for a in atoms:
        now.append(a)
        words += word_count(a)
        if words >= size * (len(out) + 1) and len(out) < count - 1:
            out.append(now)
            now = []
    return [*out, now] if now else out


def plan(body: str, reserve: int, levels: dict[str, int], minutes: float, speed: float = 1.0, chapters: bool = True, most_input: int = 30_000) -> dict:
    """code (null when there is a plan), book_words, target, heading_words, and the items in order with their unit."""
    words, target = word_count(body), math.floor(minutes * PER_MINUTE * speed)
    head = {"book_words": words, "target": target, "heading_words": 0, "items": []}
    code = "NO_TEXT" if words < 200 else "SUMMARY_TOO_SHORT" if target < LEAST_TARGET else "SUMMARY_TOO_LONG" if target > words * SHARE else None
    if code:
        return head | {"code": code}
    lines = body.split("\n")
    vocabulary = known_words(body)
    options = [absorbed(cut_sections(lines, at, vocabulary)) for at in headings(lines, levels)]
    sections = options[choose(options, max(1, (target - reserve) // SMALL))]
    if not chapters:
        sections = [Section([], s.lines, s.words, s.titles) for s in sections]
    spoken = sum(word_count(t) for s in sections for t in s.titles)
    head["heading_words"] = spoken
    if chapters and spoken > (target - reserve) * HEADING_SHARE:
        return head | {"code": "SUMMARY_TOO_SHORT"}
    budget = target - reserve - spoken
    while len(sections) > 1 and len(sections) * LEAST_SECTION > budget:
        k = min(range(len(sections) - 1), key=lambda i: sections[i].words + sections[i + 1].words)
        sections[k : k + 2] = [sections[k] + sections[k + 1]]
    items: list[dict] = []
    for n, (s, b) in enumerate(zip(sections, split_budget([s.words for s in sections], budget, LEAST_SECTION))):
        parts = pieces_of(s.lines, max(-(-s.words // most_input), -(-b // MOST_BUDGET), 1))
        sizes = [sum(map(word_count, p)) for p in parts]
        shares = split_budget(sizes, b, min(LEAST_SECTION, b // max(1, len(parts))))
        items += [{"section": n, "part": k, "parts": len(parts), "titles": s.titles, "context": s.context, "source": "\n".join(p), "words": w, "budget": x} for k, (p, w, x) in enumerate(zip(parts, sizes, shares))]
    unit, held = -1, (0, 0, 0)
    for it in items:
        more = (held[0] + it["words"], held[1] + it["budget"], held[2] + 1)
        if unit < 0 or more[0] > most_input or more[1] > MOST_BUDGET or more[2] > MOST_ITEMS:
            unit, more = unit + 1, (it["words"], it["budget"], 1)
        it["unit"], held = unit, more
    return head | {"code": None, "items": items}


def sections_of(books: DataFrame, marks: DataFrame) -> DataFrame:
    """(book_id, section, title, words) of texts (book_id, text) cut at headings that start on the lines of marks (book_id, line_idx).

    Headings are made whole and repaired by the book's own words first; front and back matter and lists at both ends go.
    """
    at = marks.groupBy("book_id").agg(F.sort_array(F.collect_set("line_idx")).alias("at"))
    both = books.select("book_id", "text").where("text is not null").join(at, "book_id", "left")
    schema = f"book_id {dict(books.dtypes)['book_id']}, section int, title string, words int"
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for book, text, starts in zip(*(batch.column(c).to_pylist() for c in ("book_id", "text", "at"))):
                lines = text.split("\n")
                cut = cut_sections(lines, [i for i in starts or [] if 0 <= i < len(lines) and lines[i].strip()], known_words(text))
                rows += [(book, n, s.titles[0] if s.titles else None, s.words) for n, s in enumerate(cut)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(wanted)], schema=wanted)

    return both.mapInArrow(run, schema)


def known_words(text: str) -> set[str]:
    """The words that a text has twice or more."""
    return {w for w, n in Counter(re.findall("[a-z]+", text.lower())).items() if n >= 2 and len(w) > 1}


def prepared(books: DataFrame) -> DataFrame:
    """(book_id, title, author, certain, body) of books (book_id, text, filename): what a summary starts from.

    Title and author are those of a spoken opening, else of the file's name, else of the text; a fused title gives way
    to the file's name. The body is without spoken opening and closing. Each book counts once, with its last text by order.
    """
    one = books.where("text is not null").groupBy("book_id").agg(F.max(F.struct("text", "filename")).alias("b")).select("book_id", "b.text", "b.filename")
    guess = N.book_meta(one).select("book_id", F.struct("title", "author").alias("guess"))
    b = one.withColumns({"said": N.meta_of_opening("text"), "named": T.meta_from_filename("filename"), "body": T.trim(N.without_narration("text"))}).join(guess, "book_id")
    certain = F.col("said").isNotNull() | F.col("named").isNotNull()
    meta = F.coalesce("said", "named", "guess")
    name = T.title_from_name("filename")
    fused = ~certain & meta["title"].rlike(r"^\S{12,}\z") & (F.coalesce(name, F.lit("")) != "")
    return b.select("book_id", F.when(fused, name).otherwise(meta["title"]).alias("title"), F.coalesce(meta["author"], F.lit("")).alias("author"), certain.alias("certain"), "body")


ITEM = "struct<section:int,part:int,parts:int,titles:array<string>,context:array<string>,source:string,words:int,budget:int,unit:int>"


def plan_summaries(books: DataFrame, levels: DataFrame, minutes: float, speed: float = 1.0, chapters: bool = True, most_input: int = 30_000) -> DataFrame:
    """(book_id, title, author, certain, code, book_words, target, reserve, heading_words, items) of every book.

    levels: (book_id, key, level), the measured headings.
    """
    held = levels.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "level"))).alias("levels"))
    ready = prepared(books).withColumn("reserve", N.reserve(F.col("title"), F.col("author")).cast("int")).join(held, "book_id", "left")
    schema = f"book_id {dict(books.dtypes)['book_id']}, title string, author string, certain boolean, reserve int, code string, book_words int, target int, heading_words int, items array<{ITEM}>"
    wanted = to_arrow_schema(StructType.fromDDL(schema))
    first = ["book_id", "title", "author", "certain", "reserve"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = [plan(b, r, dict(x or {}), minutes, speed, chapters, most_input) for b, r, x in zip(*(batch.column(c).to_pylist() for c in ("body", "reserve", "levels")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in first), *(pa.array([m[f.name] for m in made], f.type) for f in list(wanted)[len(first) :])], schema=wanted)

    return ready.select(*first, "body", "levels").mapInArrow(run, schema)


def public(plans: DataFrame) -> DataFrame:
    """The plan as it is shown: sections with their words, budgets and parts, and no text of the book."""
    one = lambda s: F.struct(F.array_max(F.transform(s, lambda i: i["parts"])).alias("parts"), F.aggregate(s, F.lit(0), lambda a, i: a + i["words"]).alias("words"), F.aggregate(s, F.lit(0), lambda a, i: a + i["budget"]).alias("budget"), F.get(s, F.lit(0))["context"].alias("titles"))
    numbers = F.array_distinct(F.transform("items", lambda i: i["section"]))
    sections = F.transform(numbers, lambda n: one(F.filter("items", lambda i: i["section"] == n)))
    units = F.coalesce(F.array_max(F.transform("items", lambda i: i["unit"])) + 1, F.lit(0))
    return plans.select("book_id", "title", "author", "certain", "code", "book_words", "target", sections.alias("sections"), units.alias("units"))


def reassembled(items: DataFrame, answers: DataFrame) -> DataFrame:
    """(book_id, section, titles, text, missing): answers (book_id, section, part, text) of items (book_id, section, part, titles) put back in reading order."""
    both = items.join(answers, ["book_id", "section", "part"], "left")
    parts = F.sort_array(F.collect_list(F.struct("part", F.coalesce("text", F.lit("")).alias("text"))))
    text = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t != ""), "\n\n")
    return both.groupBy("book_id", "section").agg(F.first("titles").alias("titles"), text.alias("text"), F.count_if(F.col("text").isNull()).alias("missing"))
