"""The training-data operators against brute force, round trips and edge cases."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillmill.llm import chunking, fmindex, leaks, mixing, normalise, packing, quality, scans, spans
from quillmill.llm.codepoints import to_arrow, to_codepoints
from quillmill.llm.queries import QUERIES

RND = random.Random(7)


# -- code points and normalisation


def test_arrow_round_trip():
    rows = ["", "abc", "żółć", "a\U0001f600b", None, "\n"]
    codes, offsets = to_codepoints(pa.array(rows))
    assert to_arrow(codes, offsets, np.array([r is None for r in rows])).to_pylist() == rows
    sliced = pa.array(rows).slice(2, 2)
    assert to_arrow(*to_codepoints(sliced)).to_pylist() == rows[2:4]


def brute_form(s):
    out = []
    for i, c in enumerate(s):
        if any(a <= ord(c) <= b for a, b in normalise.NO_WIDTH):
            if c == "\xad" and (i + 1 == len(s) or s[i + 1] == "\n"):
                out.append(c)
            continue
        out.append(normalise._plain(c))
    return unicodedata.normalize("NFC", "".join(out))


def test_form_equals_brute_force():
    pool = [chr(x) for x in [*range(32, 127), *range(0xA0, 0x250), *list(range(0x300, 0x370)) * 3, *range(0x370, 0x530), *range(0x9C0, 0x9E0), *range(0x1100, 0x1200), *range(0xAC00, 0xAC40), *range(0xFF00, 0xFFEF), 0x200B, 0x2060, 0xAD, 10, 0x1D15E, 0x1F600, 0x2F801]]
    rows = ["".join(RND.choice(pool) for _ in range(RND.randint(0, 25))) for _ in range(3000)]
    assert normalise.normalise_arrow(pa.array(rows)).to_pylist() == [brute_form(r) for r in rows]


def test_form_is_idempotent_and_keeps_what_shows():
    rows = ["café", "cafe", "m²", "m2", "Cc", "Ｆｕｌｌ", "é", "pаper", "a b", None, ""]
    once = normalise.normalise_arrow(pa.array(rows))
    assert normalise.normalise_arrow(once).to_pylist() == once.to_pylist() == ["café", "cafe", "m²", "m2", "Cc", "Full", "é", "paper", "a b", None, ""]


def test_same_look_pairs(spark):
    rows = [("b1", "café"), ("b2", "café"), ("b2", "café"), ("b3", "cafe"), ("b4", "café"), ("b5", None), (None, "café"), ("b6", "")]
    df = spark.createDataFrame(rows, "book_id string, text string").selectExpr("book_id", "text", "1 as raw", "2 as form")
    assert sorted(map(tuple, normalise.same_look_pairs(df).collect())) == [("b1", "b2"), ("b2", "b4")]
    assert normalise.same_look_pairs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        normalise.normalise_text(df, "text", "raw")


# -- chunking


@pytest.mark.parametrize("limit, overlap", [(20, 5), (7, 3), (50, 0), (1, 0), (10, 10), (3, 1)])
def test_cuts_tile_the_text(limit, overlap):
    for _ in range(60):
        t = "".join(RND.choice(["word", " ", ". ", ", ", "é", "é", "　", "x" * 30]) for _ in range(RND.randint(0, 40)))
        codes, offsets = to_codepoints(pa.array([t]))
        cuts = chunking.bisect(chunking.boundary_strength(codes, offsets), limit, overlap)
        assert cuts[0] == 0 and cuts[-1] == len(t) and cuts == sorted(cuts)
        if len(t) > limit:
            o = min(overlap, limit - 1)
            assert all(b - a + min(o, a) <= limit and b > a for a, b in zip(cuts, cuts[1:]))
            assert all(a >= o for a in cuts[1:])  # every later piece repeats the whole overlap


def test_overlap_of_half_the_limit_is_kept(spark):
    t = "Some words, that go on. And on and on " * 20
    rows = chunking.cut_oversized(spark.createDataFrame([(t, 80)], "t string, m int"), "t", "m", 40).orderBy("part").collect()
    assert [r.overlap_len for r in rows] == [0] + [40] * (len(rows) - 1) and all(len(r.piece) <= 80 for r in rows)
    assert all(b.piece[:40] == a.piece[-40:] for a, b in zip(rows, rows[1:]))
    assert "".join(r.piece[r.overlap_len :] for r in rows) == t


def test_cut_prefers_sentence_ends(spark):
    t = "One two three. Four five six, seven. " * 6
    df = spark.createDataFrame([(1, t, 80), (2, t[:50], 80), (3, None, 80), (4, t, None), (5, "", 80)], "k int, t string, m int")
    rows = chunking.cut_oversized(df, "t", "m", 10).orderBy("k", "part").collect()
    assert Counter(r.k for r in rows)[2] == Counter(r.k for r in rows)[3] == Counter(r.k for r in rows)[4] == 1
    first = [r for r in rows if r.k == 1]
    assert "".join(r.piece[r.overlap_len :] for r in first) == t
    assert all(len(r.piece) <= 80 for r in first) and all(r.piece.rstrip().endswith(".") for r in first)
    assert all(b.piece[: b.overlap_len] == a.piece[-b.overlap_len :] for a, b in zip(first, first[1:]))
    with pytest.raises(ValueError):
        chunking.cut_oversized(df.withColumnRenamed("k", "part"), "t", "m", 10)


# -- packing


def test_packing_fills_and_never_overflows():
    for _ in range(40):
        cap = RND.randint(5, 100)
        sizes = [RND.randint(1, cap - 1) for _ in range(RND.randint(1, 40))]
        bins = packing.pack(sizes, cap, 1)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= cap for b in bins)
        assert packing.lower_bound(sizes, cap) <= len(bins)
    assert len(packing.pack([6, 6, 4, 4, 5, 5], 10)) == 3
    assert len(packing.pack([7, 5, 5, 4, 4, 4, 3, 3, 3, 2], 20)) == 2


def test_packing_beats_best_fit_on_triplets():
    rnd, ours, fits, n = random.Random(5), 0, 0, 20
    for seed in range(4):
        sizes = []
        for _ in range(n):  # three items fill a container exactly
            a = rnd.randint(380, 490)
            b = rnd.randint(250, (1000 - a) - 250)
            sizes += [a, b, 1000 - a - b]
        first = []
        packing.best_fit(sizes, list(range(len(sizes))), first, [], 1000)
        bins = packing.pack(sizes, 1000, seed)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 1000 for b in bins)
        ours, fits = ours + len(bins), fits + len(first)
    assert ours <= fits - 4 and ours <= 4 * (n + 1)


def test_lower_bound_of_many_items():
    sizes = [51] * 500 + [30] * 500  # a small item goes with each large one
    assert packing.lower_bound(sizes, 100) == 500 and packing.lower_bound([], 100) == 0 and packing.lower_bound([60] * 7 + [41] * 7, 100) == 10


def test_crossover_keeps_every_item_once():
    sizes = [RND.randint(1, 50) for _ in range(60)]
    a, b = [], []
    packing.best_fit(sizes, list(range(60)), a, [], 100)
    for i in range(60):
        packing.best_fit(sizes, [i], b, [sum(sizes[j] for j in x) for x in b], 100)
    child = packing.crossover(sizes, a, b, 100, random.Random(3))
    assert sorted(i for x in child for i in x) == list(range(60))
    assert all(sum(sizes[i] for i in x) <= 100 for x in child)


def test_pack_items(spark, monkeypatch):
    rows = [("g", "a", 250), ("g", "a", 250), ("g", "b", 60), ("g", "c", 40), ("g", "z", 0), ("g", "n", None), ("h", "a", 100)]
    df = spark.createDataFrame(rows, "grp string, item string, size int")
    got = packing.pack_items(df, 100).collect()
    assert Counter((r.grp, r.item) for r in got) == {("g", "a"): 3, ("g", "b"): 1, ("g", "c"): 1, ("g", "z"): 1, ("g", "n"): 1, ("h", "a"): 1}
    assert {r.item: r.n_parts for r in got if r.grp == "g"} == {"a": 3, "b": 1, "c": 1, "z": 1, "n": 1}
    load = Counter()
    for r in got:
        if r.container is not None:
            load[r.grp, r.container] += r.size
    assert max(load.values()) <= 100 and len(load) == 5
    assert next(r for r in got if r.item == "n").container is None
    assert packing.pack_items(df.limit(0), 100).count() == 0


def test_large_group_is_spread_and_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 50)
    sizes = [RND.randint(5, 70) for _ in range(400)]
    df = spark.createDataFrame([("hot", f"i{k}", s) for k, s in enumerate(sizes)], "grp string, item string, size int")
    got = packing.pack_items(df, 100).collect()
    assert sorted(r.item for r in got) == sorted(f"i{k}" for k in range(400))
    load = Counter()
    for r in got:
        load[r.container] += r.size
    assert max(load.values()) <= 100 and len(load) <= 1.06 * sum(sizes) / 100


def test_a_group_that_fills_no_container_well_ends(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 20)
    df = spark.createDataFrame([("hot", f"i{k}", 41) for k in range(301)], "grp string, item string, size int")
    got = packing.pack_items(df, 100).collect()
    assert len(got) == 301 and len({r.container for r in got}) == 151  # two to a container, the odd ones brought together


# -- scans

LEXICON = "the old garden of was and not harbour silver dinner under button arrived a stranger well-known chapter winter".split()


def test_channel_finds_the_printed_word():
    ch = scans.Channel(LEXICON)
    assert [ch.decode([w])[0] for w in ("thc", "riot", "wiriter", "0ld", "gardcn", "cliririer", "5ilver", "harbour", "Zorimund", "II", "1909")] == ["the", "not", "winter", "old", "garden", "dinner", "silver", None, None, None, None]


def test_words_read_wrongly_in_four_places_have_candidates():
    found = scans.Channel(["correspondence"]).candidates("c0rresp0ndcncc")
    assert [(x[0], x[2]) for x in found] == [("correspondence", 1)]


def test_neighbours_choose_between_candidates():
    sketch = np.zeros(2 * scans.SKETCH, np.int64)
    sketch[scans._cells(np.array([2, 3]), np.array([1, 0]))] = 5  # we iamp, a lamp
    ch = scans.Channel(["lamp", "iamp", "we", "a"], np.array([5, 5, 9, 9]), sketch)
    assert {c[0] for c in ch.candidates("1amp")} == {"lamp", "iamp"}
    assert ch.decode(["we", "1amp"])[1] == "iamp" and ch.decode(["a", "1amp"])[1] == "lamp"


PAGE = ["THE OLD GARDEN", "", "The winter was old and the harbour was silver and not", "under the garden of thc stranger and the dinner was a", "well-known dinner and the stranger arrived under the har-", "12", "THE OLD GARDFN", "bour and the garden was not the dinner of the old well-", "known stranger and the silver button was under the old", "13", "THE OLD GARDEN", "harbour and not the winter of the garden and the dinner", "was not silver."]


def test_faults_of_a_page():
    faults, mended = scans.examine("\n".join(PAGE), scans.Channel(LEXICON), "The Old Garden", True)
    assert faults == [(0, "furniture"), (3, "misread"), (4, "broken"), (5, "furniture"), (6, "furniture"), (9, "furniture"), (10, "furniture")]
    assert "under the harbour and the garden" in mended and "old well-known stranger" in mended and "GARDFN" not in mended and "of the stranger" in mended


def test_texts_that_are_no_scans(spark):
    flowed = ("The winter was old. " * 20 + "\n") * 8
    knows = scans.Channel(LEXICON).knows
    assert not scans.is_scan(flowed.split("\n"), knows) and not scans.is_scan([""], knows) and scans.is_scan(PAGE, knows)
    merged = [*PAGE, PAGE[2] + " " + PAGE[3] + " " + PAGE[4], *PAGE[7:]]
    assert scans.is_scan(merged, knows) and scans.is_scan(PAGE[2:5], knows)  # one long line or few lines change nothing
    books = spark.createDataFrame([("b", None, None, 1), ("c", None, "\n".join(PAGE), 1), ("c", None, "\n".join(PAGE), 2), ("d", "x.txt", "", 1)], "book_id string, filename string, text string, faults int")
    lex = spark.createDataFrame([("# note",), ("",), (None,), *[(w.upper(),) for w in LEXICON]], "entry string")
    got = {r.book_id: len(r.faults) for r in scans.examined(books, lex).collect()}
    assert got == {"c": 7}
    assert {r.book_id: r.mended is not None for r in scans.examined(books, lex, True).collect()} == {"c": True, "d": True}
    assert scans.examined(books.limit(0), lex).count() == 0
    assert scans.clean_title("T H E   0 L D   G A R D C N", scans.Channel(LEXICON)).startswith("THE ")
    assert scans.clean_title(None, scans.Channel(LEXICON)) is None


def test_confusions_are_fitted_to_the_corpus(spark):
    lines = ["the winter was old and the harbour was silver and not", "under the garden of the stranger and the dinner was a", "chapter of the winter garden and the silver button and"] * 40
    read = "\n".join(x.replace("the", "thc", 1) if n % 3 == 0 else x for n, x in enumerate(lines))
    words = scans.known_words(spark.createDataFrame([(w,) for w in LEXICON], "entry string"))
    rows = scans.corpus(spark.createDataFrame([("b", "f", read)], "book_id string, filename string, text string"), words)
    *_, costs = scans.fit_channel(rows, words)
    cost = dict(zip(scans.RULES, costs))
    assert cost["c", "e"] == min(costs) and cost["c", "e"] < cost["f", "t"]


def test_long_headers_are_furniture():
    head = "THE LONG AND WINDING HISTORY OF THE OLD SILVER GARDEN BESIDE THE HARBOUR OF THE STRANGER AND HIS WELL-KNOWN DINNER"
    lines = [x if "GARD" not in x else head for x in PAGE]
    assert {i for i, x in enumerate(lines) if x == head} <= scans.furniture(lines)


# -- quality

PROSE = "The winter was old and the harbour was silver. It was not the dinner that arrived, and so the stranger of the garden waited.\n" * 5


def shape(spark, text):
    return quality.text_quality(spark.createDataFrame([("b", text)], "book_id string, text string")).first()


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Title\n" + PROSE, "prose"),
        ("Title\n" + "\n".join(f"{i}. The {w} garden" for i, w in enumerate(LEXICON * 2)), "list"),
        ("Title\n" + "\n".join(f"The {w} winter ........ {i}" for i, w in enumerate(LEXICON)), "list"),
        ("Title\n" + "\n".join(f"garden\t{i}.5\t{i * 7}\t81" for i in range(1, 20)), "table"),
        ("Title\n" + "\n".join(f"garden;{i}.5;{i * 7};81" for i in range(1, 20)), "table"),
        ("Title\n" + "\n".join("#=%§@ _}>\\&&>}}■%§=|■}{#^@>_&&~" for _ in range(9)), "junk"),
        ("Title\n" + "\n".join("kfwdg dkqhnhj vb cj nqwb bkttgnzhwk ttsmt" for _ in range(9)), "junk"),
        ("Title\n" + "\n".join("IvCSm0iW2rtOHsD5CnE5TkiAigdNb40Yn1Npi9sEaZiLv" for _ in range(9)), "junk"),
        ("Title\n" + "\n".join("tenant copper tunnel tenant copper tunnel tenant" for _ in range(9)), "junk"),
        ("", "empty"),
        ("\n\n", "empty"),
    ],
)
def test_shapes(spark, text, expected):
    assert shape(spark, text).shape == expected


def test_counts(spark):
    r = shape(spark, "By line\n\nThe old garden was old.\nNo end here")
    assert (r.n_chars, r.lines, r.words) == (44, 3, 10) and r.end_share == pytest.approx(1 / 3)
    p = np.array([[0.5, 0.5], [1.0, 0.0]])
    d = quality.divergence(p, np.array([[0.5, 0.5], [0.0, 1.0]]))
    assert d[0, 0] == pytest.approx(0) and d[1, 1] == pytest.approx(1) and d[0, 1] == pytest.approx(d[1, 0])
    empty = spark.createDataFrame([("b", None)], "book_id string, text string")
    assert quality.text_quality(empty).count() == 0


# -- leaks


def brute_longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_tiles_are_longest_first_and_apart():
    for _ in range(60):
        a, b = (np.array([RND.randint(1, 4) for _ in range(RND.randint(0, 30))], np.int64) for _ in range(2))
        tiles = leaks.tile(a, b, 3)
        longest = brute_longest(a.tolist(), b.tolist())
        assert (tiles[0][2] if tiles else 0) == (longest if longest >= 3 else 0)
        used = [i for s, _, n in tiles for i in range(s, s + n)]
        assert len(used) == len(set(used)) and [t[2] for t in tiles] == sorted((t[2] for t in tiles), reverse=True)


def test_leaks(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[:20])), (1, " ".join(words[:20])), (2, "short item"), (3, None)], "item_id int, text string")
    docs = [(10, "X; " + "—".join(w.upper() for w in words[2:16]) + "!"), (11, " ".join(words[:11])), (12, None), (13, ""), (14, "ｗ２ " + " ".join(words[3:14])), (15, " ".join(words[10:20] + words[:10])), (10, "X; " + "—".join(w.upper() for w in words[2:16]) + "!")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as longest")
    got = {r.doc_id: (r.item_id, r.longest, r.matched) for r in leaks.leaks(docs, items, 8).collect()}
    assert got == {10: (1, 14, 14), 11: (1, 11, 11), 14: (1, 12, 12), 15: (1, 10, 20)}
    assert {r.doc_id: r.leaked for r in leaks.leaks(docs, items, 8).collect()} == {10: True, 11: True, 14: True, 15: True}
    assert not leaks.leaks(docs.where("doc_id = 11").selectExpr("doc_id", "substring(text, 1, 24) as text"), items, 8).first().leaked
    monkeypatch.setattr(leaks, "ITEM_BYTES", 10)  # many blocks give the same rows
    monkeypatch.setattr(leaks, "HELD_BLOCKS", 1)
    assert {r.doc_id for r in leaks.leaks(docs, items, 8).collect()} == set(got)
    assert leaks.leaks(docs, items.limit(0), 8).count() == leaks.leaks(docs.limit(0), items, 8).count() == 0


# -- mixing


def test_fit_hits_the_budget():
    for _ in range(40):
        n = RND.randint(1, 8)
        lengths = np.array(sorted(RND.sample(range(1, 60), n)))
        counts = np.array([RND.randint(1, 9) for _ in range(n)])
        budget = RND.randint(0, int((lengths * counts).sum()) + 5)
        take = mixing.fit(lengths, counts, budget)
        reach = {0}
        for l, c in zip(lengths.tolist(), counts.tolist()):
            reach = {s + k * l for s in reach for k in range(c + 1) if s + k * l <= budget}
        assert (take <= counts).all() and int((take * lengths).sum()) == max(reach)


def test_fit_large_budget():
    lengths, counts = np.array([3, 1000, 7001]), np.array([10**6, 10**6, 10**5])
    take = mixing.fit(lengths, counts, 5 * 10**8)
    assert (take <= counts).all() and int((take * lengths).sum()) == 5 * 10**8


def test_mix(spark):
    docs = [(i, f"word number {i} of the garden", "  Big" if i % 2 else "big ") for i in range(40)] + [(100, "tiny text", "small"), (101, None, "small"), (102, " ", "small"), (103, "no target", "other"), (104, "x", None)]
    docs = spark.createDataFrame(docs, "doc_id int, text string, source string")
    targets = spark.createDataFrame([("BIG", 0.5, 1), ("small", 0.4, 3), ("missing", 0.1, None)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(docs, targets)
    rows, rep = chosen.collect(), {r.source: r for r in report.collect()}
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"big", "small"}
    assert max(r.repeats for r in rows if r.source == "small") == 3 and max(r.repeats for r in rows if r.source == "big") == 1
    assert abs(rep["big"].share_of_all - 0.5) < 0.03 and rep["missing"].mixed_tokens == 0 and rep["other"].documents == 0
    again = {(r.doc_id, r.repeats) for r in mixing.mix(docs.repartition(3), targets)[0].collect()}
    assert again == {(r.doc_id, r.repeats) for r in rows}
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0


# -- shared spans


def test_suffix_order_and_search():
    for _ in range(100):
        x = np.array([RND.randrange(3) for _ in range(RND.randint(1, 50))], np.int32)
        l = x.tolist()
        assert fmindex.suffix_order(x, 3).tolist() == sorted(range(len(l)), key=lambda i: l[i:])


def brute_spans(docs, least):
    out = []
    for i, d in enumerate(docs):
        out.append(spans._merge([(s, s + least) for s in range(len(d) - least + 1) if any(d[s : s + least] in o for j, o in enumerate(docs) if j != i)]))
    return out


def texts():
    base = ["".join(RND.choice("ab") for _ in range(RND.randint(5, 40))) for _ in range(4)]
    return sorted({"".join(RND.choice([*base, "c", "dd", ""]) for _ in range(RND.randint(1, 3))) for _ in range(RND.randint(2, 6))})


@pytest.mark.parametrize("least", [6, 9, 12])
def test_spans_of_a_shard(least):
    for _ in range(40):
        docs = texts()
        t = [np.frombuffer(d.encode("utf-32-le"), np.uint32) for d in docs]
        row, pos, fp = spans.winnow(np.concatenate(t), np.concatenate([[0], np.cumsum([len(x) for x in t])]), least)
        by = {}
        for r, f in zip(row.tolist(), fp.tolist()):
            by.setdefault(f, set()).add(r)
        places = [sorted(p for r, p, f in zip(row.tolist(), pos.tolist(), fp.tolist()) if r == i and len(by[f]) > 1) for i in range(len(docs))]
        assert spans.match_shard(t, places, [bool(p) for p in places], least) == brute_spans(docs, least)


@pytest.mark.parametrize("shard", [10**6, 200, 60])
def test_shared_spans(spark, monkeypatch, shard):
    monkeypatch.setattr(spans, "SHARD_CHARS", shard)  # the small ones make hot fingerprints, blocks and copies
    monkeypatch.setattr(spans, "VISITS_PER_INDEX", 2)
    common = "".join(RND.choice("abcdefgh") for _ in range(40))
    docs = [f"{RND.random()}{common[RND.randint(0, 9):RND.randint(28, 40)]}{RND.random()}" for _ in range(25)] + ["q" * 50, "r" * 19]
    rows = [(i, d) for i, d in enumerate(docs)] + [(90, docs[0]), (91, None), (92, ""), (0, docs[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as spans", "2 as shard")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in spans.shared_spans(df, 20).collect()}
    expected = {i: s for i, s in enumerate(brute_spans(docs, 20)) if s}
    expected |= {0: [(0, len(docs[0]))], 90: [(0, len(docs[0]))]}
    assert got == expected
    assert spans.shared_spans(df.limit(0), 20).count() == 0


def test_a_hot_fingerprint_stays_linear(spark, monkeypatch):
    monkeypatch.setattr(spans, "SHARD_CHARS", 2000)
    footer = "".join(RND.choice("abcdefgh") for _ in range(60))
    sent = {}
    split = spans._in_copies
    monkeypatch.setattr(spans, "_in_copies", lambda q: split(sent.setdefault("q", q)))
    chars = []
    for n in (250, 1000):
        docs = [f"{RND.random()}{RND.random()}{footer}{RND.random()}" for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
        got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in spans.shared_spans(df, 40).collect()}
        assert len(got) == n and all(any(a <= d.index(footer) and b >= d.index(footer) + 60 for a, b in got[i]) for i, d in enumerate(docs))
        if n == 250:
            assert got == {i: s for i, s in enumerate(brute_spans(docs, 40)) if s}
        chars.append(sum(len(r.text) for q in sent.pop("q").collect() for r in q.stretches))
    assert chars[1] < 6 * chars[0]  # four times the records; all pairs of blocks would be sixteen times


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns and df.count() >= 0
