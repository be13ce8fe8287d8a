"""Problem 4: repairing text from scanned pages.

Per book: is it a scan (wrapped lines of prose that go on in one another); which lines are page furniture
(page numbers that count up, and lines that come again near them, however badly read); which line ends cut
a word (a hyphen, soft hyphen or not sign that is not part of the word); which words were misread. Words are
corrected by a noisy channel: for each word that the lexicon does not know, the lexicon words from which
character confusions lead to it are the candidates; a Viterbi search over the words of the line takes the
probabilities of the confusions times the likelihood of neighbouring words. Both are counted over the whole
corpus: the neighbours directly, the confusions by expectation maximisation over the unknown words of all
scans, each weighed by the likelihood of its candidates. Names and numbers have no candidate and stay.

One pass over the books counts words and pairs and writes the scans down; the rest reads those alone. The
lexicon is broadcast; it is a fixed vocabulary and is refused above ``MAX_LEXICON`` words. Counts of pairs are
kept in a count-min sketch of ``SKETCH`` cells in two rows, so what is broadcast has one size at most, however
large the corpus.

Defined results: null and empty texts have no fault; books that are not scans come back as they are;
repeated rows (same id and text) count once; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.codepoints import batches, to_codepoints
from quillmill.llm.leaks import INVERSE, _alnum, _arrow_schema, mix, powers
from quillmill.llm.normalise import TOP
from quillmill.session import cut, table

MAX_LEXICON = 200_000
#: Cells in each of the two rows of the sketch of word pairs.
SKETCH = 1 << 19
MARKS = "-‐¬\xad"

# What a scanner reads, and what was printed; small letters and digits, then capitals.
READ_SMALL = [("c", "e"), ("f", "t"), ("b", "h"), ("0", "o"), ("5", "s"), ("l", "i"), ("1", "l"), ("1", "i"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("rn", "m"), ("6", "b"), ("vv", "w"), ("9", "g"), ("m", "in"), ("m", "rn"), ("h", "li"), ("e", "c"), ("h", "b"), ("d", "cl"), ("i", "l")]
READ_CAPITAL = [("F", "E"), ("N", "H"), ("5", "S"), ("0", "O"), ("6", "G"), ("8", "B"), ("1", "I"), ("l", "I"), ("O", "D"), ("M", "RN"), ("VV", "W"), ("f", "t")]
RULES = [*dict.fromkeys(READ_SMALL + [(a, b.lower()) for a, b in READ_CAPITAL])]
#: What a confusion counts as before any is seen, and how many printed places that belief is worth.
PRIOR, BELIEF, ROUNDS = 0.005, 200.0, 3

WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
DIGITS = str.maketrans("lI|!OoSsBZzGg", "1111005582266")
NUMBER = re.compile(r"^\W{0,2}\s*(P[ao0][g9][ec]\s)?\s*([\dlI|!OoSsBZzGg]{1,4})\s*\W{0,2}$")
SMALL_ROMAN = re.compile(r"^\W{0,2}\s*(?:P[ao0][g9][ec]\s)?\s*([ivxlI1|]{1,7})\s*\W{0,2}$")
ROMAN_FORM = re.compile(r"^(x{0,3})(ix|iv|v?i{0,3})$")
BESIDE = re.compile(r"^(?:([\dlI|!OoSsBZzGg]{1,4})\s{2,}(\S.*)|(\S.*?)\s{2,}([\dlI|!OoSsBZzGg]{1,4}))$")
CUT = re.compile(r"([^\W\d_](?:[^\W_]|-(?=\w))*|[^\W_]+)([" + re.escape(MARKS) + r"])\s*$")
FIRST = re.compile(r"^\s*([^\W_]+(?:-[^\W_]+)*)")
STRAY = re.compile(r"\s+[.,:;'·-]$|^[.,:;'·-]\s+")
ROMAN = re.compile(r"^[IVXLC]+$")
MERGE = [("RN", "M"), ("RI", "N"), ("CL", "D"), ("II", "U"), ("VV", "W")]
SHAPE = str.maketrans("0915628FCHBTDQLJ", "OOISGZBEENNEOOII")


def _cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The two cells of the sketch for each pair of word numbers."""
    with np.errstate(over="ignore"):
        h = mix((a.astype(np.uint64) << np.uint64(32)) + b.astype(np.uint64) + np.uint64(1))
    return np.stack([h % np.uint64(SKETCH), (h >> np.uint64(32)) % np.uint64(SKETCH) + np.uint64(SKETCH)]).astype(np.int64)


class Channel:
    """Candidates for words and the Viterbi search over them.

    unigrams: how often each lexicon word stands in the corpus, in the lexicon's order; sketch: the
    counts of pairs; costs: minus the log of each rule's probability, in the order of ``RULES``.
    """

    def __init__(self, lexicon: list[str], unigrams: np.ndarray | None = None, sketch: np.ndarray | None = None, costs: list[float] | None = None) -> None:
        self.number = {w: n for n, w in enumerate(lexicon)}
        self.prefixes = {w[:k] for w in lexicon for k in range(len(w) + 1)}
        self.unigrams = np.zeros(len(lexicon), np.int64) if unigrams is None else unigrams
        self.sketch = sketch
        self.total = int(self.unigrams.sum()) + len(lexicon) + 1
        self.memo: dict[str, list[tuple[str, float, int, tuple[int, ...]]]] = {}
        self.pair_memo: dict[tuple[str, str], float] = {}
        self.rules: dict[str, list[tuple[str, str, int, float]]] = defaultdict(list)
        for n, (a, b) in enumerate(RULES):
            self.rules[a[0]].append((a, b, n, costs[n] if costs else -math.log(PRIOR)))

    def knows(self, word: str) -> bool:
        w = word.lower()
        return w in self.number or ("-" in w and all(p in self.number for p in w.split("-")))

    def candidates(self, word: str) -> list[tuple[str, float, int, tuple[int, ...]]]:
        """(lexicon word, cost of the confusions, place of the first one, the rules) for a word the lexicon lacks."""
        if (found := self.memo.get(word)) is not None:
            return found
        out: dict[str, tuple[float, int, tuple[int, ...]]] = {}
        stack: list[tuple[str, int, float, int, tuple[int, ...]]] = [("", 0, 0.0, -1, ())]
        while stack:
            made, at, cost, first, used = stack.pop()
            if at == len(word):
                if used and made in self.number and (made not in out or out[made][0] > cost):
                    out[made] = (cost, first, used)
                continue
            same = made + word[at].lower()
            if same in self.prefixes:
                stack.append((same, at + 1, cost, first, used))
            for a, b, n, c in self.rules.get(word[at], ()):
                if word.startswith(a, at) and made + b in self.prefixes:
                    stack.append((made + b, at + len(a), cost + c, at if first < 0 else first, (*used, n)))
        found = sorted((w, *x) for w, x in out.items())
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[word] = found
        return found

    def suspect(self, word: str) -> bool:
        """Whether the word may be a misreading."""
        return len(word) > 1 and not word.isdigit() and not self.knows(word) and not ROMAN.match(word) and bool(self.candidates(word))

    def count(self, word: str) -> int:
        n = self.number.get(word, -1)
        return int(self.unigrams[n]) if n >= 0 else 0

    def likelihood(self, prev: str | None, word: str) -> float:
        """Log of the probability of ``word`` after ``prev``, backed off to its own frequency."""
        own = (self.count(word) + 1) / self.total
        if prev is None:
            return math.log(own)
        if (known := self.pair_memo.get((prev, word))) is None:
            a, b = self.number.get(prev, -1), self.number.get(word, -1)
            both = 0 if self.sketch is None or a < 0 or b < 0 else int(self.sketch[_cells(np.array([a]), np.array([b]))].min())
            known = self.pair_memo[prev, word] = math.log((both + 5 * own) / (self.count(prev) + 5))
            if len(self.pair_memo) > 500_000:
                self.pair_memo.clear()
        return known

    def decode(self, words: list[str]) -> list[str | None]:
        """For each word its correction, or None where it stays."""
        options: list[list[tuple[str | None, str, float]]] = [[(c[0], c[0], c[1]) for c in self.candidates(w)] if self.suspect(w) else [(None, w.lower(), 0.0)] for w in words]
        if all(o[0][0] is None for o in options):
            return [None] * len(words)
        scores, back = [(-cost + self.likelihood(None, w)) for _, w, cost in options[0]], []
        for before, now in zip(options, options[1:]):
            best = [max(range(len(before)), key=lambda k: scores[k] + self.likelihood(before[k][1], w)) for _, w, _ in now]
            scores = [scores[k] + self.likelihood(before[k][1], w) - cost for k, (_, w, cost) in zip(best, now)]
            back.append(best)
        k = max(range(len(scores)), key=scores.__getitem__)
        out = [options[-1][k][0]]
        for n in range(len(back) - 1, -1, -1):
            k = back[n][k]
            out.append(options[n][k][0])
        return out[::-1]


def like(word: str, correct: str) -> str:
    """``correct`` in the case of ``word``."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return correct.upper()
    return correct[:1].upper() + correct[1:] if letters and word[:1] == letters[0] and letters[0].isupper() else correct


ENDS = ".!?…\"»“”"


def wrapped(lines: list[str]) -> bool:
    """Lines of about one width, of several words, few of them ending a sentence, many going on in the next."""
    full = [x for x in map(str.strip, lines) if x]
    if len(full) < 2:
        return False
    sizes = sorted(map(len, full))
    width = sizes[len(sizes) * 3 // 4]
    if sum(0.7 * width <= n <= 1.3 * width for n in sizes) < 0.4 * len(full) or sum(x[-1] in ENDS for x in full) >= 0.55 * len(full):
        return False
    several = [len(x.split()) >= 4 for x in full]
    if sum(m and sum(map(str.isalpha, x)) >= 0.6 * len(x) for x, m in zip(full, several)) < 0.5 * len(full):
        return False
    pairs = [(a, b) for a, b, m, n in zip(full, full[1:], several, several[1:]) if m and n]
    return sum(a[-1] not in ENDS and b[0].islower() for a, b in pairs) >= 0.2 * len(pairs) > 0


def is_scan(lines: list[str], knows: Callable[[str], bool]) -> bool:
    """Wrapped lines of which most words are known."""
    if not wrapped(lines):
        return False
    words = [w for x in lines for w in WORD.findall(x)]
    return sum(map(knows, words)) * 2 >= len(words) > 0


def shape(line: str) -> str:
    """The letters of a line with those alike to a scanner made equal."""
    s = "".join(c for c in unicodedata.normalize("NFD", line.upper()) if c.isalnum())
    for a, b in MERGE:
        s = s.replace(a, b)
    return s.translate(SHAPE)


def near(a: str, b: str) -> bool:
    """Equal but for a few characters in place."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 6:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= max(1, len(a) // 6)
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return sum(x != y for x, y in zip(a[k:], b[k + 1 :])) <= len(a) // 8


def small_roman(s: str) -> int:
    """The value of a page number in small roman letters, an i perhaps read as l or 1; 0 for anything else."""
    m = SMALL_ROMAN.match(s)
    m = m and ROMAN_FORM.match(re.sub("[lI1|]", "i", m[1]))
    if not m:
        return 0
    return 10 * len(m[1]) + {"ix": 9, "iv": 4}.get(m[2], 5 * m[2].count("v") + m[2].count("i"))


def furniture(lines: list[str], title: str | None = None) -> set[int]:
    """Numbers of the lines that are running headers or page numbers."""
    numbers: list[tuple[int, int, bool]] = []
    decked: set[int] = set()  # numbers that look like nothing but page numbers
    for i, raw in enumerate(lines):
        s = raw.strip()
        if not s:
            continue
        bare = len(s.replace(" ", "")) <= 14  # longer lines are no number alone
        if bare and (v := small_roman(s)):
            numbers.append((i, v, True))
            decked.add(i)
            continue
        if bare and (m := NUMBER.match(s)):
            if any(c.isdigit() for c in m[2]) or m[1] or s != m[2]:
                v = m[2].translate(DIGITS)
                if v.isdigit():
                    numbers.append((i, int(v), True))
                    if m[1] or not s[0].isalnum():
                        decked.add(i)
                    continue
        if ("  " in s or "\t" in s) and (m := BESIDE.match(s)) and (any(c.isdigit() for c in (m[1] or m[4]))):
            v = (m[1] or m[4]).translate(DIGITS)
            if v.isdigit():
                numbers.append((i, int(v), False))
    values = {i: v for i, v, _ in numbers}
    order = [i for i, _, _ in numbers]
    out: set[int] = set()
    for k, (i, v, alone) in enumerate(numbers):
        around = [values[order[j]] - v == j - k or 0 < (values[order[j]] - v) * (1 if j > k else -1) <= 2 * abs(j - k) for j in range(max(0, k - 3), min(len(order), k + 4)) if j != k]
        if any(around) or (alone and (len(numbers) <= 2 or (i in decked and len(decked) >= 2))):
            out.add(i)
    full = [i for i, x in enumerate(lines) if x.strip()]
    place = {i: n for n, i in enumerate(full)}
    edges = {full[0]} if full else set()
    for i in out:
        n = place[i]
        edges.update(full[j] for j in (n - 1, n + 1) if 0 <= j < len(full))
    keys: dict[int, str] = {}
    for i in full:
        s = STRAY.sub("", lines[i].strip())
        if i in out or not s or s[-1] in ".!?,;…”»" + MARKS:
            continue
        first = next((c for c in s if c.isalpha()), "")
        if first.isupper() and sum(map(str.isalpha, s)) >= 4:
            keys[i] = shape(s)
    counts = Counter(keys.values())
    known = [k for k, n in counts.most_common() if n >= 2]
    names = [shape(title)] if title and len(title) > 3 else []
    for i, k in keys.items():
        capital = lines[i].strip().upper() == lines[i].strip()
        if counts[k] >= 2 and (capital or "·" in lines[i] or counts[k] >= 3) or any(near(k, h) for h in known if counts[h] >= 3):
            if i in edges or counts[k] >= 3 or any(near(k, h) for h in known if counts[h] >= 3):
                out.add(i)
        elif i in edges and capital and (any(near(k, h) for h in known) or any(near(k, h) for h in names)):
            out.add(i)
    return out


def title_of(filename: str | None) -> str | None:
    """The title in a file's name."""
    if not filename:
        return None
    name = re.sub(r"\.\w{1,5}$", "", filename).replace("_", " ")
    if " " not in name:
        name = name.replace("-", " ")
    return re.split(r" - | by ", name)[0].strip()


def examine(text: str, channel: Channel, title: str | None = None, mend: bool = False, suspects: set[int] | None = None) -> tuple[list[tuple[int, str]], str | None]:
    """The faults of a scanned book as (line, fault), and its mended text if asked for.

    suspects: the lines with a word that may be misread, where the caller knows them.
    """
    lines = text.split("\n")
    odd = furniture(lines, title)
    faults: set[tuple[int, str]] = {(i, "furniture") for i in odd}
    running = [i for i, x in enumerate(lines) if x.strip() and i not in odd]
    joined: dict[int, tuple[str, bool, int]] = {}  # line: whole word, whether it may be misread, next line
    for i, j in zip(running, running[1:]):
        if lines[i].rstrip()[-1] not in MARKS:
            continue
        m = CUT.search(lines[i])
        if not m or not (n := FIRST.match(lines[j])):
            continue
        a, b, mark = m[1], n[1], m[2]
        if b.isdigit() or not any(c.isalpha() for c in a):
            continue
        whole, hyphened = a + b, f"{a}-{b}"
        known = hyphened.lower() in channel.number
        if mark == "-" and not channel.knows(whole) and (known or (not channel.candidates(whole) and channel.candidates(hyphened))):
            joined[i] = (hyphened, not known, j)
        else:
            faults.add((i, "broken"))
            joined[i] = (whole, True, j)
    heads = {j: i for i, (_, _, j) in joined.items()}
    fixed: dict[int, list[str]] = {}
    words_of: dict[int, list[tuple[str, int]]] = {}
    for i in running:
        if suspects is not None and i not in suspects and i not in joined and i not in heads:
            continue
        words_of[i] = [(m.group(), m.start()) for m in WORD.finditer(lines[i])]
        tokens = [w for w, _ in words_of[i]]
        if not tokens:
            continue
        if i in joined:
            tokens[-1] = joined[i][0]
        skip = 1 if i in heads else 0
        answer = channel.decode(tokens[skip:])
        fixed[i] = [like(w, c) if c else w for w, c in zip(tokens[skip:], answer)]
        for k, c in enumerate(answer):
            if c is None:
                continue
            if i in joined and k == len(answer) - 1:
                whole, _, j = joined[i]
                first = next((x[2] for x in channel.candidates(whole) if x[0] == c), 0)
                faults.add((i if first < len(words_of[i][-1][0]) else j, "misread"))
            else:
                faults.add((i, "misread"))
    return sorted(faults), _mended(lines, running, words_of, joined, heads, fixed) if mend else None


def _mended(lines: list[str], running: list[int], words_of: dict, joined: dict, heads: dict, fixed: dict) -> str:
    """Continuous paragraphs: no furniture, words whole and corrected, one line each."""
    paragraphs: list[str] = []
    before = -1
    for i in running:
        line, tokens = lines[i], words_of.get(i, [])
        made, at = [], 0
        skip = 1 if i in heads else 0
        for n, (w, start) in enumerate(tokens):
            if n < skip:
                at = start + len(w)
                continue
            made += [line[at:start], fixed[i][n - skip]]
            at = start + len(w)
        rest = line[at:].rstrip()
        made.append("" if i in joined else rest)
        body = "".join(made).strip()
        gap = any(not lines[k].strip() for k in range(before + 1, i)) and not (i in heads)
        flows = bool(paragraphs) and before >= 0 and paragraphs[-1][-1:] not in ".!?…”»" and body[:1].islower()
        new = not paragraphs or ((gap or line[:1].isspace()) and not flows) or not (paragraphs[-1][-1:].islower() or paragraphs[-1][-1:] in ",;–-" or flows or len(lines[before].strip()) > 30)
        if i in heads and paragraphs:
            paragraphs[-1] += body if body[:1] in ".,;:!?”»)" else " " + body
        elif new:
            paragraphs.append(body)
        else:
            paragraphs[-1] += " " + body
        before = i
    return "\n\n".join(p for p in paragraphs if p)


def known_words(lexicon: DataFrame) -> list[str]:
    """The lexicon's words: no comments, no blanks, small letters, each once. Refused beyond the bound."""
    word = F.lower(F.trim("entry"))
    rows = lexicon.select(word.alias("w")).where("w <> '' and not startswith(w, '#')").distinct().orderBy("w").limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"a lexicon of more than {MAX_LEXICON} words can't be broadcast")
    return [unicodedata.normalize("NFC", r.w) for r in rows]


KINDS = ["word", "cell", "printed", "unknown", "book"]


def corpus(books: DataFrame, words: list[str], whole: bool = False) -> DataFrame:
    """What one pass over the books gives, written once: rows of the kinds

    word, cell: counts ``n`` of a lexicon word and of a cell of the sketch, by ``id``; printed: counts of
    words of scans; unknown: counts of other words of scans; book: the scans (id 1), or all books if ``whole``.
    """
    spark = books.sparkSession
    shared = spark.sparkContext.broadcast(words)
    schema = f"kind int, id int, word string, n bigint, book_id {dict(books.dtypes)['book_id']}, filename string, digest string, text string"
    wanted = _arrow_schema(spark, schema)

    def counts(kind: int, n: np.ndarray) -> pa.RecordBatch:
        ids = np.flatnonzero(n)
        cols = {"kind": np.full(len(ids), kind, np.int32), "id": ids.astype(np.int32), "n": n[ids]}
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name]) if f.name in cols else pa.nulls(len(ids), f.type) for f in wanted], schema=wanted)

    def others(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"kind": 3, "word": w, "n": c} for w, c in seen.items()], schema=wanted)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        held, near = Held(words), rivals(words)
        marked = np.array([w in near for w in words] + [False], bool)
        total = [np.zeros(n, np.int64) for n in (len(words), 2 * SKETCH, len(words))]
        other: Counter = Counter()
        for batch in batches(it, "text"):
            texts = [t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in batch.column("text").to_pylist()]
            h, row, start, size = _hash_words(pa.array(texts, pa.string()))
            ids = held.ids(h)
            total[0] += np.bincount(ids[ids >= 0], minlength=len(words))
            ok = (ids[:-1] >= 0) & (ids[1:] >= 0) & (row[1:] == row[:-1]) & (marked[ids[:-1]] | marked[ids[1:]])
            total[1] += np.bincount(_cells(ids[:-1][ok], ids[1:][ok]).ravel(), minlength=2 * SKETCH)
            scan = np.array([wrapped(t.split("\n")) for t in texts], bool)
            n = np.bincount(row, minlength=len(texts))
            scan &= (np.bincount(row, weights=ids >= 0, minlength=len(texts)) * 2 >= n) & (n > 0)
            inside = scan[row] if len(row) else np.empty(0, bool)
            total[2] += np.bincount(ids[inside & (ids >= 0)], minlength=len(words))
            begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            at = np.flatnonzero(inside & (ids < 0))
            for r, s, z in zip(row[at].tolist(), (start[at] - begin[row[at]]).tolist(), size[at].tolist()):
                other[texts[r][s : s + z]] += 1
            if len(other) > 100_000:
                yield others(other)
                other.clear()
            take = np.flatnonzero(scan) if not whole else np.arange(len(texts))
            rows = [{"kind": 4, "id": int(scan[r]), "text": texts[r] if scan[r] else batch.column("text")[r].as_py(), **{c: batch.column(c)[r].as_py() for c in ("book_id", "filename", "digest")}} for r in take.tolist()]
            yield pa.RecordBatch.from_pylist(rows, schema=wanted)
        yield others(other)
        for kind in range(3):
            yield counts(kind, total[kind])

    digest = F.md5("text") if whole else F.lit(None).cast("string")
    return cut(books.select("book_id", F.col("filename").cast("string").alias("filename"), digest.alias("digest"), "text").where("text is not null").mapInArrow(run, schema))


def rivals(words: list[str]) -> set[str]:
    """Words that share a reading with another word, for which alone the neighbours matter."""
    shapes = defaultdict(set)
    flat = str.maketrans("cefthbo0s5il1b6g9", "eettbboossiiibbgg")
    for w in words:
        s = w.replace("rn", "m").replace("in", "m").replace("ri", "n").replace("cl", "d").replace("ii", "u").replace("vv", "w").translate(flat)
        shapes[s].add(w)
    return {w for g in shapes.values() if len(g) > 1 for w in g}


class Held:
    """The lexicon's words by their hashes."""

    def __init__(self, words: list[str]) -> None:
        hashes = _hash_words(pa.array(words, pa.string()))[0] if words else np.empty(0, np.uint64)
        if len(hashes) != len(words):  # an entry of several words, or of none, is no word of a text
            hashes = np.array([h[0] if len(h := _hash_words(pa.array([w]))[0]) == 1 else 0 for w in words], np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The number of each word in the lexicon, -1 for those it lacks."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)


def fit_channel(rows: DataFrame, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[float]]:
    """The arguments of the channel: counts of words and pairs, and confusions fitted to the unknown words of all scans.

    Each round weighs the candidates of every distinct unknown word by the channel so far, and takes the
    expected uses of each rule over the places where its letters were printed. What reaches the driver is one
    row per word of the lexicon, per cell of the sketch and per rule.
    """
    spark = rows.sparkSession
    totals = rows.where("kind < 3").groupBy("kind", "id").agg(F.sum("n").alias("n")).collect()
    one, two, printed = np.zeros(len(words), np.int64), np.zeros(2 * SKETCH, np.int64), np.zeros(len(words), np.int64)
    for r in totals:
        (one, two, printed)[r.kind][r.id] = r.n
    places = np.array([sum(int(printed[n]) * w.count(b) for n, w in enumerate(words) if b in w) for _, b in RULES], float)
    unknown = cut(rows.where("kind = 3").groupBy("word").agg(F.sum("n").alias("n")))
    costs = [-math.log(PRIOR)] * len(RULES)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((words, one, costs))

        def weigh(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, one, costs = shared.value
            channel = Channel(words, one, None, costs)
            uses = np.zeros(len(RULES))
            for batch in it:
                for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                    if not channel.suspect(w):
                        continue
                    found = channel.candidates(w)
                    weight = np.array([channel.count(c[0]) + 1 for c in found]) * np.exp(-np.array([c[1] for c in found]))
                    for c, x in zip(found, weight / weight.sum()):
                        for rule in c[3]:
                            uses[rule] += n * x
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(RULES), dtype=np.int32)), pa.array(uses)], names=["rule", "uses"])

        uses = {r.rule: r.uses for r in unknown.mapInArrow(weigh, "rule int, uses double").groupBy("rule").agg(F.sum("uses").alias("uses")).collect()}
        costs = [-math.log(min(0.5, (uses.get(k, 0.0) + BELIEF * PRIOR) / (places[k] + BELIEF))) for k in range(len(RULES))]
    return words, one, two, costs


def _hash_words(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs of letters, digits and hyphens within words: hashes of the small letters, rows, starts and lengths."""
    codes, offsets = to_codepoints(arr)
    none, n = np.empty(0, np.int64), len(codes)
    if not n:
        return np.empty(0, np.uint64), none, none, none
    terms, wordy = _letters()
    at = np.minimum(codes, TOP)
    word = np.zeros(n + 2, bool)
    word[1:-1] = wordy[at]
    dash = np.flatnonzero(codes == 45) + 1
    word[dash[word[dash - 1] & word[dash + 1]]] = True
    step = np.flatnonzero(word[1:] != word[:-1])
    start, end = step[::2], step[1::2]
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < n)])
    if len(split := inner[word[inner] & word[inner + 1]]):  # a word doesn't go on in the next row
        start, end = np.sort(np.concatenate([start, split])), np.sort(np.concatenate([end, split]))
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms[at] * powers(n, INVERSE))])
        h = mix((run[end] - run[start]) * powers(n)[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(offsets, start, "right") - 1, start, end - start


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point what its small letter adds to a hash, and whether it belongs to words."""
    low = np.arange(TOP + 1, dtype=np.uint64)
    for c in range(0x41, 0x600):
        if len(x := chr(c).lower()) == 1:
            low[c] = ord(x)
    return mix(low + np.uint64(1)), _alnum()[low.astype(np.int64)]


def examined(books: DataFrame, lexicon: DataFrame, mend: bool = False) -> DataFrame:
    """(book_id, digest, faults array<struct<line_idx, fault>>, mended) of every scan, with ``mend`` of every book; ``mended`` is null unless asked for."""
    spark = books.sparkSession
    words = known_words(lexicon)
    rows = corpus(books, words, mend)
    shared = spark.sparkContext.broadcast(fit_channel(rows, words))
    schema = f"book_id {dict(books.dtypes)['book_id']}, digest string, faults array<struct<line_idx:int,fault:string>>, mended string"
    wanted = _arrow_schema(spark, schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, held = Channel(*shared.value), Held(shared.value[0])
        for batch in batches(it, "text"):
            texts = batch.column("text").to_pylist()
            h, row, start, size = _hash_words(batch.column("text"))
            begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            suspects: list[set[int]] = [set() for _ in texts]
            for r, s, z in zip(*(x[held.ids(h) < 0].tolist() for x in (row, start - begin[row], size))):
                if channel.suspect(texts[r][s : s + z]):
                    suspects[r].add(texts[r].count("\n", 0, s))
            out = [examine(t, channel, title_of(f), mend, x) if scan else ([], t if mend else None) for t, f, scan, x in zip(texts, batch.column("filename").to_pylist(), batch.column("id").to_pylist(), suspects)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("book_id"), batch.column("digest"), pa.array([[{"line_idx": i, "fault": f} for i, f in faults] for faults, _ in out], wanted.field("faults").type), pa.array([m for _, m in out], pa.string())], schema=wanted
            )

    return rows.where("kind = 4").select("book_id", "filename", "digest", "text", "id").mapInArrow(run, schema)


def scan_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, line_idx, fault), each once."""
    out = examined(table(spark, sf_dir, "books"), table(spark, sf_dir, "lexicon"))
    return out.select("book_id", F.explode("faults").alias("f")).select("book_id", "f.line_idx", "f.fault").distinct()


def mended_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, mended, n_faults): every book's text as continuous paragraphs."""
    out = examined(table(spark, sf_dir, "books"), table(spark, sf_dir, "lexicon"), mend=True)
    return out.dropDuplicates(["book_id", "digest"]).select("book_id", "mended", F.size("faults").alias("n_faults"))


def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, idx, title, clean_title): chapter titles closed up, those of scans with their words corrected."""
    words = known_words(table(spark, sf_dir, "lexicon"))
    rows = corpus(table(spark, sf_dir, "books"), words)
    shared = spark.sparkContext.broadcast(fit_channel(rows, words))
    scans = rows.where("kind = 4").select("book_id").distinct().withColumn("scan", F.lit(True))
    titles = table(spark, sf_dir, "chapters").select("book_id", "idx", "title").distinct().join(scans, "book_id", "left")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(*shared.value)
        for batch in it:
            out = [clean_title(t, channel if scan else None) for t, scan in zip(batch.column("title").to_pylist(), batch.column("scan").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "clean_title"])

    return titles.mapInArrow(run, titles.withColumn("clean_title", F.lit("")).schema).drop("scan")


def clean_title(title: str | None, channel: Channel | None) -> str | None:
    """A title with single blanks, letter-spacing closed and, given a channel, its words corrected; null stays null."""
    if title is None:
        return None
    t = unicodedata.normalize("NFC", title).strip()
    if t.count(" ") >= 4 and not re.search(r"\S\S", t):
        t = " ".join(w.replace(" ", "") for w in re.split(r"\s{2,}", t))
    t = re.sub(r"\s+", " ", t)
    if channel is None:
        return t
    spots = [(m.group(), m.start()) for m in WORD.finditer(t)]
    out, at = [], 0
    for (w, start), c in zip(spots, channel.decode([w for w, _ in spots]) if spots else []):
        out += [t[at:start], like(w, c) if c else w]
        at = start + len(w)
    return "".join(out) + t[at:]
