"""Problem 5: per-document statistics that tell prose from lists, tables and junk.

Every line is described by distributions: its characters over the classes in ``CHARS``, and those between
words alone, its tokens over those in ``TOKENS``, and its form (how it begins and ends, and how long it is); one more says what
the outline has on that line. Each is compared with structural profiles by Jensen-Shannon divergence. The
distribution of a document's tokens over single function words is compared with the prose of each
language; the least of these divergences names the language and counts for or against all its lines being
prose. The nearest profile gives the line's shape, and a document's shape is that of most of its lines,
headings and what stands above the first heading left out.

The profiles are fitted: ``SAMPLE_BOOKS`` books, those with the least hashes, whatever their number, are
labelled line by line by the outline's kinds and by crude marks (``weak_labels``), only to learn from. The lines
of each shape fall into ``KINDS_OF_LINES`` clusters at most, whose means are the profiles; a few lines of
every shape in ``EXAMPLES`` stand in for what a sample lacks.

All lines of a batch are handled as arrays. What leaves a task are divergences per line, which meet the
outline's entries; texts are not shuffled.

Defined results: null texts have no row; a text without words has null means and the shape ``empty``;
repeated rows count once; of several entries on a line a heading counts before a list item; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.codepoints import batches, slices, to_codepoints
from quillmill.llm.leaks import _arrow_schema, mix, powers
from quillmill.llm.normalise import NO_WIDTH, TOP

CHARS = ["vowel", "consonant", "capital", "accented", "digit", "blank", "end", "inner", "separator", "leader", "odd"]
BETWEEN = CHARS.index("blank")  # from here on classes of what stands between words
TOKENS = ["function", "content", "echo", "number", "marker", "voiceless", "oversized"]

# Common function words.
FUNCTION_WORDS = {
    "en": "the a an and of to in was were is are it that which not no had has have for most all so while when because why after before every there some more than by said who his her",
    "fr": "le la les un une des du et que qui ne pas dans sur avec était mais est bien disait très plus pour par au aux sans",
    "de": "der die das ein eine und war nicht mit von zu den dem als weil sich so doch sagte ist dabei ohne noch sehr in",
    "es": "el la los las un una y que era con por para no en lo su se muy sin pero es del al decía cuando",
}

#: Books the profiles are learnt from, and clusters of lines of one shape.
SAMPLE_BOOKS, KINDS_OF_LINES = 2000, 12
#: Lines above the first heading that may be a title page.
TITLE_PAGE = 5
SHAPES = ["prose", "list", "table", "junk", "heading"]
FORMS = (4, 4, 5)

#: Lines of every shape, in case a sample has none.
EXAMPLES = {
    "prose": [
        "The winter was long and the harbour was grey, but the stranger who lived there did not go away.",
        "“It is not for the old man,” she said, and so they went to the garden by the river.",
        "of the river and the people that lived in it, so that",
        "La maison était grise et le jardin ne donnait plus de fruits, mais les voisins y passaient avec plaisir.",
        "Der Garten war alt und die Nachbarn sagten, dass es nicht mit den Bäumen zu tun hatte.",
        "La casa era vieja y los vecinos decían que no había agua en el jardín, pero se quedaron.",
    ],
    "list": ["1. The old garden", "• A silver spoon", "(b) the harbour; 7 the lamp", "garden, 12, 48, 107", "The lamp of winter ........ 12", "Summer and Winter", "3) la maison grise"],
    "table": ["garden\t12.5\t7\t81", "garden;12.5;7;81", "garden,12.5,7,81", "garden    12.5    7    81%", "| garden | 12 | 7 |", "name    size    price", "--------------------"],
    "junk": ["#=%§@ _}>\\&&>}}■%§=|■}{#^@>_&&~", "kfwdg dkqhnhj vb cj nqwb bkttgnzhwk", "Ã¢Â€Ã™â€œ Ã Â© ï¿½ Â°Â±", "IvCSm0iW2rtOHsD5CnE5TkiAigdNb40Yn1Npi9sEaZiLv", "tenant copper tunnel tenant copper tunnel tenant"],
    "heading": ["CHAPTER 1", "Chapter 2: The Garden", "THE OLD GARDEN", "Part 1 – La Maison"],
}


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, small letter and kind (1 letter, 2 digit, 4 vowel) of every code point."""
    cls, low, kind = np.full(TOP + 1, CHARS.index("odd"), np.int8), np.arange(TOP + 1, dtype=np.uint32), np.zeros(TOP + 1, np.uint8)
    for c in range(0x20000):
        ch = chr(c)
        if ch.isalpha():
            kind[c] = 1
            small = ch.lower()
            if len(small) == 1:
                low[c] = ord(small)
            if c > 0x7E:
                cls[c] = CHARS.index("accented")
                kind[c] |= 4 * (small in "áàâäéèêëíìîïóòôöúùûüœæ")
            else:
                kind[c] |= 4 * (small in "aeiouy")
                cls[c] = CHARS.index("capital" if ch.isupper() else "vowel" if small in "aeiouy" else "consonant")
        elif ch.isdigit():
            kind[c], cls[c] = 2, CHARS.index("digit")
        elif ch.isspace():
            cls[c] = CHARS.index("blank")
    for chars, name in ((".!?…", "end"), (",;:'’‘\"“”„«»()-–—¿¡‐", "inner"), ("\t|", "separator")):
        for ch in chars:
            cls[ord(ch)] = CHARS.index(name)
    return cls, low, kind


@lru_cache(1)
def _function_hashes() -> np.ndarray:
    """The hashes of all function words in order; a word's place is its number."""
    words = sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split()})
    return np.unique(np.array([_hash(np.array([ord(c) for c in w], np.uint64)) for w in words], np.uint64))


@lru_cache(1)
def _languages() -> np.ndarray:
    """For each language which of the function words are its own."""
    return np.array([np.isin(_function_hashes(), [_hash(np.array([ord(c) for c in w], np.uint64)) for w in ws.split()]) for ws in FUNCTION_WORDS.values()])


def _hash(codes: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return np.uint64((mix(codes + np.uint64(1)) * powers(len(codes))).sum(dtype=np.uint64))


class Lines:
    """The lines of a batch of texts: where they are and their distributions."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray) -> None:
        hidden = np.zeros(len(codes), bool)
        for a, b in NO_WIDTH:
            hidden |= (codes >= a) & (codes <= b)
        if hidden.any():
            offsets = np.concatenate([[0], np.cumsum(~hidden)])[offsets]
            codes = codes[~hidden]
        cls, low, kind = _tables()
        at = np.minimum(codes, TOP)
        self.codes, c, k, small = codes, cls[at].copy(), kind[at], low[at]
        n = len(codes)
        newline = codes == 10
        stops = np.unique(np.concatenate([np.flatnonzero(newline) + 1, offsets[1:]]))
        stops = stops[stops > 0]
        starts = np.concatenate([[0], stops[:-1]]).astype(np.int64) if len(stops) else np.empty(0, np.int64)
        self.starts, self.stops = starts, stops
        self.row = np.searchsorted(offsets, starts, "right") - 1
        line = np.repeat(np.arange(len(starts), dtype=np.int64), stops - starts)
        blank = c == CHARS.index("blank")
        solid = ~blank & (c != CHARS.index("separator"))
        # context: separators are blanks in a row, and commas and semicolons between solid characters
        nxt, prv = np.append(codes[1:], 10), np.concatenate([[10], codes[:-1]])
        gap = blank & ~newline & (np.append(blank[1:] & ~newline[1:], False) | np.concatenate([[False], blank[:-1] & ~newline[:-1]]))
        first = np.full(len(starts), n, np.int64)
        ink = np.flatnonzero(~blank)
        np.minimum.at(first, line[ink], ink)
        inside = np.arange(n) > first[line] if n else gap
        c[gap & inside] = CHARS.index("separator")
        tight = ((codes == 44) | (codes == 59)) & (nxt != 32) & (nxt != 10) & (prv != 32) & ~np.isin(nxt, [0x201D, 0xBB, 34, 0xA0, 0x202F])
        c[tight] = CHARS.index("separator")
        dots = (codes == 46) & ((nxt == 46) | (prv == 46))
        c[dots] = CHARS.index("leader")
        use = ~newline & ~(gap & ~inside)
        size = len(CHARS)
        self.chars = np.bincount(line[use] * size + c[use], minlength=len(starts) * size).reshape(-1, size)
        self.capitals = self.chars[:, CHARS.index("capital")]
        self.letters = np.bincount(line[(k & 1) > 0], minlength=len(starts))
        self.length = np.bincount(line[use], minlength=len(starts))
        self.last_end = np.zeros(len(starts), bool)
        lastly = np.full(len(starts), -1, np.int64)
        sayable = np.flatnonzero(~blank & ~np.isin(codes, [0x201D, 0xBB, 34, 0x2019, 0x29, 0x5D]))
        np.maximum.at(lastly, line[sayable], sayable)
        self.last_end = (lastly >= 0) & np.isin(codes[np.maximum(lastly, 0)], [46, 33, 63, 0x2026]) if n else self.last_end
        self.low = np.zeros(len(starts), bool)
        shown = first < n
        self.low[shown] = (k[first[shown]] == 1) | (k[first[shown]] == 5)
        self.low[shown] &= small[first[shown]] == codes[first[shown]]
        self.shown, self.ink = first, self.length - self.chars[:, CHARS.index("blank")]
        self._begin = np.where(shown, k[np.minimum(first, max(0, n - 1))] & 3, 0) if n else np.zeros(len(starts), np.int64)
        self._end = np.where(lastly >= 0, k[np.maximum(lastly, 0)] & 3, 0) if n else np.zeros(len(starts), np.int64)
        dash = np.flatnonzero((codes == 45) | (codes == 61) | (codes == 43) | (codes == 95))
        self.dashes = np.bincount(line[dash], minlength=len(starts))
        self._tokens(solid & (c != CHARS.index("separator")) & (c != CHARS.index("leader")), k, small, line, offsets)

    def _tokens(self, solid: np.ndarray, k: np.ndarray, small: np.ndarray, line: np.ndarray, offsets: np.ndarray) -> None:
        n, count = len(solid), len(TOKENS)
        self.tokens = np.zeros((len(self.starts), count), np.int64)
        self.words = np.zeros(len(self.starts), np.int64)
        self.word_chars = np.zeros(len(self.starts), np.int64)
        self.function_row = self.function_word = np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.starts] = True
        start = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]) | solid & edge[:-1])
        if not len(start):
            return
        at = np.flatnonzero(solid)
        first = np.searchsorted(at, start)
        length = np.diff(np.append(first, len(at)))
        letter, digit, vowel = (np.add.reduceat((k[at] & b > 0).astype(np.int64), first) for b in (1, 2, 4))
        foreign = np.add.reduceat(((k[at] & 1) > 0) & (self.codes[at] > 0x7E), first, dtype=np.int64)
        # a hash of the small letters alone
        is_letter = (k[at] & 1) > 0
        order = np.cumsum(is_letter)
        pos = order - np.repeat(np.concatenate([[0], order])[first], length) - 1
        with np.errstate(over="ignore"):
            terms = np.where(is_letter, mix(small[at].astype(np.uint64) + np.uint64(1)) * powers(int(pos.max(initial=0)) + 1)[np.maximum(pos, 0)], np.uint64(0))
            h = np.add.reduceat(terms, first)
        in_line = line[start]
        leads = np.concatenate([[True], in_line[1:] != in_line[:-1]])
        function = np.isin(h, _function_hashes()) & (letter > 0)
        row = self.row[in_line]
        echo = np.zeros(len(h), bool)
        for d in range(1, 9):
            echo[d:] |= (h[d:] == h[:-d]) & (row[d:] == row[:-d])
        marker = leads & (length <= 4) & ((letter + digit < length) & (letter <= 1) & (digit <= 3))
        kinds = [
            marker,
            (letter == 0) & (digit > 0),
            letter == 0,
            function,
            (letter > 22) | (digit > 0) & (letter > 3) & (length > 12),
            (letter >= 3) & ((vowel * 6 < letter) | (foreign * 2 > letter)) | (letter > 0) & (length > letter + digit + 3),
            echo & (letter >= 3),
        ]
        names = ["marker", "number", "voiceless", "function", "oversized", "voiceless", "echo"]
        which = np.select(kinds, [TOKENS.index(x) for x in names], TOKENS.index("content"))
        self.tokens = np.bincount(in_line * count + which, minlength=len(self.starts) * count).reshape(-1, count)
        at = np.flatnonzero(function)
        self.function_row, self.function_word = row[at], np.searchsorted(_function_hashes(), h[at])
        wordy = letter > 0
        self.words = np.bincount(in_line[wordy], minlength=len(self.starts))
        self.word_chars = np.bincount(in_line[wordy], weights=letter[wordy], minlength=len(self.starts)).astype(np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of ``p`` from each row of ``q``."""
    p, q = p.astype(np.float32), q.astype(np.float32)
    least = np.float32(1e-12)
    entropy = lambda x: (x * np.log2(np.maximum(x, least))).sum(1)
    own, theirs = entropy(p), entropy(q)
    return np.stack([(own + theirs[j]) / 2 - entropy((p + x) / 2) for j, x in enumerate(q)], 1)


def distributions(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shares of character classes, and of those between words, the shares of token classes, and how it begins, ends and how long it is, per line."""
    begin = np.select([lines.low, lines._begin == 1, lines._begin == 2], [0, 1, 2], 3)
    end = np.select([lines.last_end, lines._end == 1, lines._end == 2], [0, 1, 2], 3)
    size = np.searchsorted([2, 4, 7, 13], lines.tokens.sum(1), "right")
    chars, between, tokens = (x / np.maximum(1, x.sum(1, keepdims=True)) for x in (lines.chars, lines.chars[:, BETWEEN:], lines.tokens))
    return np.concatenate([chars, between], 1), tokens, np.stack([begin, end, size])


def one_hot_divergence(shares: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of the distribution that is all on one value from ``shares``, for each value."""
    x = np.clip(shares, 0, 1)
    m = (1 + x) / 2
    rest = (1 - x) / 2  # the others, each halved by the mean
    own = np.where(x > 0, x * np.log2(np.maximum(x, 1e-12) / m), 0.0)
    return (np.log2(1 / m) + own) / 2 + rest


def document_words(lines: Lines, n: int) -> np.ndarray:
    """For each document the shares of its tokens that are each function word, and of all others."""
    size = len(_function_hashes())
    out = np.zeros((n, size + 1))
    np.add.at(out, (lines.function_row, lines.function_word), 1)
    tokens = np.bincount(lines.row, weights=lines.tokens.sum(1), minlength=n)
    out[:, size] = np.maximum(0, tokens - out[:, :size].sum(1))
    return out / np.maximum(1, out.sum(1, keepdims=True))


def weak_labels(lines: Lines, kinds: np.ndarray) -> np.ndarray:
    """A guess at the shape of lines that show it plainly, -1 for others; kinds: 1 heading, 2 list, 0 nothing by the outline."""
    t, n = lines.tokens, np.maximum(1, lines.tokens.sum(1))
    share = lambda *names: t[:, [TOKENS.index(x) for x in names]].sum(1) / n
    count = lambda name: lines.chars[:, CHARS.index(name)]
    ink = np.maximum(1, lines.ink)
    junk = (share("voiceless", "oversized") >= 0.6) | (count("odd") + count("accented") >= 0.4 * ink) | (share("echo") >= 0.6) & (share("function") <= 0.1) & (n >= 4)
    rule = (lines.letters == 0) & (ink >= 4) & (lines.dashes + count("separator") >= 0.9 * ink)
    parted, n_texts = count("separator") >= 1, int(lines.row.max(initial=-1)) + 1
    most = np.bincount(lines.row, weights=parted, minlength=n_texts) * 2 > np.bincount(lines.row, weights=lines.ink > 0, minlength=n_texts)
    table = (count("separator") >= 2) | parted & most[lines.row]  # cells in most lines of a text
    short = (n <= 6) & ~lines.last_end & (count("inner") == 0) & ~lines.low & (lines.letters >= 3) & (kinds != 1)
    full = np.flatnonzero(lines.ink > 0)
    near = np.zeros(len(lines.starts), bool)
    if len(full) > 4:  # a run of short lines
        run = np.lib.stride_tricks.sliding_window_view(short[full] & (lines.row[full] >= 0), 5).all(1)
        same = lines.row[full][4:] == lines.row[full][:-4]
        near[full[np.flatnonzero(run & same) + 2]] = True
    listed = (kinds == 2) & ~(lines.last_end & (n >= 8)) | (count("leader") >= 3) | near | (share("number") >= 0.4) & (count("inner") > 0)
    prose = (n >= 6) & (share("function") >= 0.15) & (lines.last_end | (count("inner") > 0) | (n >= 8))
    out = np.select([kinds == 1, rule, junk, table, listed, prose], [4, 2, 3, 2, 1, 0], -1)
    out[lines.ink == 0] = -1
    # a text that is no prose is mostly of one kind: the guesses that differ from its most frequent one follow it
    other = np.isin(out, [1, 2, 3])
    votes = np.zeros((n_texts, 5), np.int64)
    np.add.at(votes, (lines.row[other], out[other]), 1)
    out[other] = votes.argmax(1)[lines.row[other]]
    return out


def clusters(x: np.ndarray, most: int) -> np.ndarray:
    """The cluster of each row, -1 for strays: seeded k-means in the metric of square roots (Hellinger)."""
    z = np.sqrt(x)
    rnd = np.random.default_rng(0)
    means = z[[int(((z - z.mean(0)) ** 2).sum(1).argmin())]]
    gap = ((z - means[0]) ** 2).sum(1)
    while len(means) < most and gap.sum() > 0.01 * len(z):
        means = np.concatenate([means, z[[int(rnd.choice(len(z), p=gap / gap.sum()))]]])
        gap = np.minimum(gap, ((z - means[-1]) ** 2).sum(1))
    for _ in range(12):
        of = np.stack([((z - m) ** 2).sum(1) for m in means], 1).argmin(1)
        means = np.array([z[of == k].mean(0) if (of == k).any() else m for k, m in enumerate(means)])
    size = np.bincount(of, minlength=len(means))
    return np.where(size[of] * 200 >= len(z), of, -1)


class Profiles:
    """What the sample says: mean distributions of the lines of each shape, the outline's kinds, and the prose of each language."""

    def __init__(self, texts: list[str], kinds: list[dict[int, int]]) -> None:
        extra = [(x, SHAPES.index(s)) for s, xs in EXAMPLES.items() for x in xs]
        parts = [self._learn(texts[a:b], kinds[a:b]) for a, b in slices(np.array([len(t) for t in texts]), 500_000)]
        parts.append(self._learn([x for x, _ in extra], [{} for _ in extra], np.array([s for _, s in extra])))
        chars, tokens, form, label, kind, words, prose = (np.concatenate([p[i] for p in parts], 1 if i == 2 else 0) for i in range(7))
        self.shape: list[int] = []
        means: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.kind = np.zeros((len(SHAPES), 3))  # a line that the outline does not list says nothing
        for s in range(len(SHAPES)):
            at = np.flatnonzero(label == s)
            of = clusters(np.concatenate([chars[at], tokens[at]], 1) / 3, KINDS_OF_LINES)
            seen = np.bincount(kind[at], minlength=3)[1:] + 0.5
            self.kind[s, 1:] = one_hot_divergence(seen / seen.sum())
            for k in np.unique(of[of >= 0]):
                mine = at[of == k]
                shares = [np.bincount(x[mine], minlength=n) / len(mine) for x, n in zip(form, FORMS)]
                means.append((chars[mine].mean(0), tokens[mine].mean(0), np.concatenate([one_hot_divergence(x) / 2 for x in shares])))
                self.shape.append(s)
        self.chars, self.tokens, self.form = (np.array([m[i] for m in means]) for i in range(3))
        self.of = np.array(self.shape)
        # the prose of each language: documents mostly of prose, by whose words they have most of
        speech = np.stack([words[:, :-1][:, own].sum(1) for own in _languages()], 1).argmax(1)
        self.prose = np.array([words[prose & (speech == g)].mean(0) if (prose & (speech == g)).any() else words.mean(0) for g in range(len(_languages()))])

    @staticmethod
    def _learn(texts: list[str], kinds: list[dict[int, int]], given: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Distributions, labels and the outline's kinds of all lines; the words of each text, and whether it is mostly prose."""
        n = len(texts)
        lines = Lines(*to_codepoints(pa.array(texts, pa.string())))
        first = np.searchsorted(lines.row, np.arange(n + 1))
        kind = np.zeros(len(lines.starts), np.int64)
        for r, of in enumerate(kinds):
            for i, k in of.items():
                if 0 <= i < first[r + 1] - first[r]:
                    kind[first[r] + i] = k
        label = weak_labels(lines, kind) if given is None else given
        prose = np.bincount(lines.row[label == 0], minlength=n) * 2 > np.bincount(lines.row[lines.ink > 0], minlength=n)
        return *distributions(lines), label, kind, document_words(lines, n), prose

    def compare(self, lines: Lines, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Divergence of each line from each shape; the language of each document and its divergence from its prose."""
        d = divergence(document_words(lines, n), self.prose)
        language, own = d.argmin(1), d.min(1)
        chars, tokens, form = distributions(lines)
        n_chars = len(CHARS)
        each = divergence(chars[:, :n_chars], self.chars[:, :n_chars]) + divergence(chars[:, n_chars:], self.chars[:, n_chars:]) + divergence(tokens, self.tokens)
        for x, start in zip(form, np.cumsum([0, *FORMS])):
            each += self.form[:, start + x].T
        out = np.stack([each[:, self.of == s].min(1) for s in range(len(SHAPES))], 1)
        out[:, 0] += own[lines.row] / 2
        return out, language, own


COUNTS = ["n_chars", "lines", "words", "word_chars", "ends", "symbols", "inked", "common", "tokens"]


def batch_quality(arr: pa.Array, profiles: Profiles) -> dict[str, np.ndarray]:
    """The statistics of every text of a batch, and for each line with text its number and its divergence from each shape."""
    codes, offsets = to_codepoints(arr)
    lines = Lines(codes, offsets)
    n = len(offsets) - 1
    d, language, own = profiles.compare(lines, n)
    full = lines.ink > 0
    add = lambda x, where=None: np.bincount(lines.row if where is None else lines.row[where], weights=x if where is None else x[where], minlength=n)
    symbols = lines.chars[:, [CHARS.index("odd"), CHARS.index("separator"), CHARS.index("leader")]].sum(1)
    out = {"n_chars": np.diff(offsets), "lines": add(full.astype(float)), "words": add(lines.words), "word_chars": add(lines.word_chars), "ends": add(lines.last_end.astype(float), full)}
    out |= {"symbols": add(symbols), "inked": add(lines.ink), "common": add(lines.tokens[:, 0]), "tokens": add(lines.tokens.sum(1))}
    number = np.arange(len(lines.row)) - np.searchsorted(lines.row, lines.row)
    return out | {"language": language, "language_divergence": own, "row": lines.row[full], "number": number[full], "d": d[full]}


def sampled(books: DataFrame, outline: DataFrame | None) -> Profiles:
    """The profiles of the sample: one text each of ``SAMPLE_BOOKS`` books comes to the driver, with the entries of those books."""
    rows = books.select("book_id", "text", F.xxhash64(F.col("book_id").cast("string")).alias("h")).where("text is not null")
    least = [r.h for r in rows.select("h").distinct().orderBy("h").limit(SAMPLE_BOOKS).collect()]
    got = rows.where(F.col("h") <= least[-1]).groupBy("book_id").agg(F.min("text").alias("text")).collect() if least else []
    of: dict = {}
    if outline is not None and least:
        mine = outline.where(F.xxhash64(F.col("book_id").cast("string")) <= least[-1])
        of = {r.book_id: r.kinds for r in _entries(mine).collect()}
    got.sort(key=lambda r: str(r.book_id))
    return Profiles([r.text for r in got], [of.get(r.book_id, {}) for r in got])


def _entries(outline: DataFrame) -> DataFrame:
    """(book_id, kinds map<line, 1 heading or 2 list>) of the outline; an entry of unknown kind with a level is a heading."""
    kind = F.when((F.col("kind") == "heading") | F.col("kind").isNull() & F.col("level").isNotNull(), 1).when(F.col("kind") == "list", 2)
    each = outline.select("book_id", F.col("line_idx").cast("int").alias("line_idx"), kind.alias("k")).where("k is not null and line_idx is not null").groupBy("book_id", "line_idx").agg(F.min("k").alias("k"))
    return each.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("line_idx", "k"))).alias("kinds"))


def text_quality(books: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """One row per document: counts, means, shares of line shapes, and the document's shape."""
    spark = books.sparkSession
    if outline is not None and "level" not in outline.columns:
        outline = outline.withColumn("level", F.lit(None).cast("int"))
    profiles = sampled(books, outline)
    shared = spark.sparkContext.broadcast(profiles)
    kind = dict(books.dtypes)["book_id"]
    schema = f"book_id {kind}, digest string, " + ", ".join(f"{k} bigint" for k in COUNTS) + ", language string, language_divergence double, divergence double, at binary, d binary"
    wanted = _arrow_schema(spark, schema)

    def compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        names = np.array(list(FUNCTION_WORDS))
        for batch in batches(it, "text", 1_000_000):
            n = batch.num_rows
            q = batch_quality(batch.column("text"), profiles)
            ends = np.searchsorted(q["row"], np.arange(n + 1)).tolist()
            at, d = q["number"].astype(np.int32), np.minimum(np.round(q["d"] * 1000), 20_000).astype(np.int16)
            lists = [pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()) for x in (at, d)]
            total = np.bincount(q["row"], weights=q["d"][:, 0], minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column("book_id"), batch.column("digest"), *(pa.array(q[k].astype(np.int64)) for k in COUNTS), pa.array(names[q["language"]]), pa.array(q["language_divergence"].astype(float)), pa.array(total), *lists], schema=wanted)

    raw = books.select("book_id", F.md5("text").alias("digest"), "text").where("text is not null").mapInArrow(compared, schema).dropDuplicates(["book_id", "digest"])
    raw = raw.withColumn("kinds", F.lit(None).cast("map<int,int>")) if outline is None else raw.join(_entries(outline), "book_id", "left")
    keep = [c for c in raw.columns if c not in ("at", "d", "kinds")]
    schema2 = f"book_id {kind}, digest string, " + ", ".join(f"{k} bigint" for k in COUNTS) + ", language string, language_divergence double, divergence double, " + ", ".join(f"{k} bigint" for k in [*SHAPES, "outline_headings", "outline_items"])
    wanted2 = _arrow_schema(spark, schema2)

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = shared.value.kind * 1000
        for batch in it:
            held = batch.column("kinds").to_pylist()
            out = []
            for at, d, kinds in zip(batch.column("at").to_pylist(), batch.column("d").to_pylist(), held):
                out.append(_count_shapes(np.frombuffer(at, np.int32), np.frombuffer(d, np.int16).reshape(-1, len(SHAPES)), dict(kinds or {}), shift))
            values = np.array(out, np.int64).reshape(-1, len(SHAPES) + 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(values[:, j]) for j in range(values.shape[1]))], schema=wanted2)

    counted_ = raw.select(*keep, "at", "d", "kinds").mapInArrow(counted, schema2)
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    kinds = F.greatest("list", "table", "junk")
    shape = (
        F.when(F.col("lines") == 0, "empty")
        .when(F.col("prose") * 2 >= F.col("lines") - F.col("heading"), "prose")
        .when(F.col("junk") == kinds, "junk")
        .when(F.col("table") == kinds, "table")
        .otherwise("list")
    )
    return counted_.select(
        "book_id", "digest", "n_chars", "lines", "words",
        share("word_chars", "words").alias("mean_word_length"), share("words", "lines").alias("words_per_line"), share("symbols", "inked").alias("symbol_ratio"),
        share("ends", "lines").alias("end_share"), share("common", "tokens").alias("common_share"), "language", "language_divergence", share("divergence", "lines").alias("prose_divergence"),
        *(F.col(k).alias(f"{k}_lines") for k in SHAPES), shape.alias("shape"), "outline_headings", "outline_items",
    )


def _count_shapes(at: np.ndarray, d: np.ndarray, kinds: dict[int, int], shift: np.ndarray) -> list[int]:
    """Lines of each shape, and the outline's headings and items. d: divergence of each line ``at`` from each shape.

    A title that the outline doesn't mark may be an item of a list, so only marked lines are headings; but the
    first line, if it is no prose or junk, and up to ``TITLE_PAGE`` such lines above the first heading are a title.
    """
    entries = [sum(v == k for v in kinds.values()) for k in (1, 2)]
    if not len(at):
        return [0] * len(SHAPES) + entries
    head = SHAPES.index("heading")
    kind = np.zeros(len(at), np.int64)
    if kinds:
        lines, values = np.array(sorted(kinds.items())).T
        where = np.minimum(np.searchsorted(lines, at), len(lines) - 1)
        kind = np.where(lines[where] == at, values[where], 0)
    total = d + shift.T[kind]
    total[kind != 1, head] = 1e9
    shape = total.argmin(1)
    top = min((i for i, k in kinds.items() if k == 1), default=0)
    title = (np.arange(len(at)) == 0) | (at < top) & ((at < top).sum() <= TITLE_PAGE)
    shape[title & (shape != SHAPES.index("prose")) & (shape != SHAPES.index("junk"))] = head
    return [*np.bincount(shape, minlength=len(SHAPES)).tolist(), *entries]
