"""Golden vectors, worked out by hand."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions import maths as M
from quillmill.functions import text as T
from quillmill.operators import grounding as G
from quillmill.operators import layout as Y
from quillmill.operators import sentences as S
from quillmill.operators import timeline as TL
from quillmill.plans import budget as B
from quillmill.sources import files as X
from quillmill.sources import sinks
from quillmill.streaming import progress as P


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text, expected",
    [
        ('Mr. Smith paid 3. 14 left. "Go!" he said. "Stop." Then J. R. Tolkien left. ok? yes! É fin. Done', ["Mr. Smith paid 3. 14 left.", '"Go!" he said.', '"Stop."', "Then J. R. Tolkien left. ok? yes! É fin.", "Done"]),
        ("Chap. no. 4. See e.g. Fig. 2. End.", ["Chap. no. 4.", "See e.g. Fig. 2.", "End."]),
        ("", []),
        ("  \n ", []),
        (None, None),
    ],
)
def test_sentences(spark, text, expected):
    assert one(spark, text, S.sentences) == expected


def test_sentences_keep_all_characters(spark):
    text = "One two. Three? “Four!” Five 6. 7 eight… Nine. (Ten.) X. Y"
    assert "".join("".join(one(spark, text, S.sentences)).split()) == "".join(text.split())


@pytest.mark.parametrize("word, value", [("xiv", 14), ("iiii", 0), ("", 0), ("MCMXCIV", 1994)])
def test_roman(spark, word, value):
    assert one(spark, word, T.roman_value) == value


def test_strings(spark):
    assert one(spark, "The Coinage — Part 2!", T.heading_key) == "the coinage part 2"
    assert set(one(spark, "1,234.50 and 7.", T.numbers_in)) == {"1234.50", "7"}
    assert tuple(one(spark, "The Laws of Human Nature - Robert Greene.pdf", T.meta_from_filename)) == ("The Laws of Human Nature", "Robert Greene")
    assert one(spark, "no dash.pdf", T.meta_from_filename) is None
    assert one(spark, "1. Introduction", T.line_kind) == "list"
    assert one(spark, "CHAPTER ONE", T.line_kind) == "heading"
    assert set(one(spark, "running", T.base_forms)) >= {"running", "runn", "runne", "run"}
    assert "city" in one(spark, "cities", T.stems)
    assert one(spark, "Crème brûlée, n°2", T.norm_text) == "creme brulee n 2"
    assert one(spark, " \t", T.count_words) == 0
    assert one(spark, "well,", T.end_cleanly) == "well."


def test_numbers(spark):
    assert [one(spark, x, M.back_off, "int") for x in (1, 2, 3, 4, 5)] == [5, 10, 20, 40, 60]
    assert [one(spark, x, M.clamp_speed, "double") for x in (0.0, 3.0, 0.1, None)] == [1, 2, 0.5, 1]
    assert [one(spark, x, M.level_from_ratio, "double") for x in (1.5, 1.25, 1.2)] == [1, 2, 3]
    assert one(spark, "01:02:03.5", M.clock_seconds) == 3723.5
    assert one(spark, "abc", M.clock_seconds) is None
    assert (one(spark, "3:05", M.colon_seconds), one(spark, "abc", M.colon_seconds)) == (185, 0)
    ranges = {"bytes=0-9": (0, 9), "bytes=90-": (90, 99), "bytes=-5": (95, 99), "bytes=200-": None, "x": None}
    for header, expected in ranges.items():
        got = one(spark, header, lambda c: M.byte_range(c, F.lit(100)))
        assert (got and tuple(got)) == expected
    errors = {429: ("RATE_LIMITED", True), 401: ("AUTH", False), 404: ("MODEL_MISSING", False), 413: ("TOO_LARGE", False), 503: ("SERVER", True), 418: ("BAD_REQUEST", False)}
    assert {k: tuple(one(spark, k, M.http_error, "int")) for k in errors} == errors


@pytest.mark.parametrize("weights, total, floor, expected", [([1, 1, 98], 100, 10, [10, 10, 80]), ([1, 1], 10, 6, [6, 6]), ([], 10, 1, []), ([0, 0], 10, 0, [0, 0])])
def test_split_budget(weights, total, floor, expected):
    assert B.split_budget(weights, total, floor) == expected


def test_chunks_end_chapters(spark):
    df = spark.createDataFrame([(1, "Chapter 1\n\nOne two three. Four five\n\nChapter 2\n\nSix seven. Eight nine."), (2, ""), (3, None)], "k int, t string")
    rows = [tuple(r) for r in S.chunk_table(df, "k", "t", 4).orderBy("k", "i").select("text", "chapter_index", "ends_chapter").collect()]
    assert rows == [("Chapter 1.", 0, False), ("One two three.", 0, False), ("Four five.", 0, True), ("Chapter 2. Six seven.", 1, False), ("Eight nine.", 1, False)]


def test_capped_pieces_stay_within_the_cap(spark):
    df = spark.createDataFrame([(1, "A long sentence, with clauses; and more. " * 30 + "x" * 950)], "k int, t string")
    assert max(len(r.piece) for r in S.capped_pieces(df, "k", "t", 100).collect()) <= 100


def test_grounding(spark):
    claims = spark.createDataFrame([(1, "In 1999 the Baron met Zora. He said “never go there again” twice.")], "id int, text string")
    sources = spark.createDataFrame([("The baron said: never go there. In 1998 he met no one.",)], "text string")
    issues = {(r.kind, r.detail) for r in G.all_issues(claims, sources).collect()}
    assert issues == {("number", "1999"), ("name", "Zora"), ("quote", "never go there again")}


def test_alignment():
    assert TL.align([(1.0, False), (2.0, True)], [(1.1, 0.1), (2.0, 0.5)]) == [(0, 0), (1, 1)]
    assert TL.align([(1.0, False)], [(9.0, 0.1)]) == []
    seg = TL.segments("One two, three. Four five.", [(0.7, 0.9), (1.2, 1.6)], 2.4)
    assert seg[0][0] == 0 and seg[-1][1] == 2.4 and seg[-1][3] == 5
    assert all(a[1] <= b[0] and a[3] == b[2] for a, b in zip(seg, seg[1:]))
    assert TL.match_words(["it", "costs", "five", "dollars"], ["It", "costs", "$5"]) == [0, 1, -1, -1]


def test_html():
    text, heads = X.html_lines("<head><title>x</title></head><h2>A &amp; B</h2><p>one<br>two&copy;</p><ul><li>a</li><li>b</li></ul><ol><li><p>c</p></li></ol><script>no</script>")
    assert text == "A & B\n\none two\n\n• a\n• b\n1. c"
    assert heads == [("A & B", 2)]
    assert X.decode_entities("&#x41;&#66;&nope;&quot;") == 'AB "'


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿Hello".encode())
    (tmp_path / "b.doc").write_bytes(b"no")
    with zipfile.ZipFile(tmp_path / "c.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<rootfile full-path="o/p.opf"/>')
        z.writestr("o/p.opf", '<item id="i1" href="1.xhtml"/><item id="i2" href="2.xhtml"/><itemref idref="i2"/><itemref idref="i1"/>')
        z.writestr("o/1.xhtml", "<title>One</title><h1>ONE</h1><p>first</p>")
        z.writestr("o/2.xhtml", "<title>Two</title><p>second</p>")
    (tmp_path / "d.wav").write_bytes(X.wav_bytes(np.array([0, 16384, -32768]), 8000))
    files = X.uploads(spark, f"{tmp_path}/*")
    assert X.txt(files).first().raw_text == "Hello"
    assert X.epub_books(files).first().raw_text == "Two\n\nsecond\n\nONE\n\nfirst"
    wav = spark.read.format("binaryFile").load(f"{tmp_path}/d.wav")
    row = wav.select(X.wav_header("content").alias("h"), X.decode_wav("content").alias("s")).first()
    assert (row.h.channels, row.h.rate, row.h.bits, row.h.data_offset, row.h.data_bytes) == (1, 8000, 16, 44, 6)
    assert row.s.samples == [0, 0.5, -1]
    assert X.wav_info(b"nothing") is None


def test_layout(spark):
    rows = [(1, 0, i, s, x, y, 6.0 * len(s), 10.0) for i, (s, x, y) in enumerate([("Hel", 0.0, 100.0), ("lo", 18.0, 100.0), ("world", 36.0, 99.0), ("next-", 0.0, 88.0), ("ed", 0.0, 76.0)])]
    tokens = spark.createDataFrame(rows, "book_id int, page int, ord int, str string, x double, y double, w double, h double")
    lines = Y.lines(tokens)
    assert [r.text for r in lines.orderBy("line").collect()] == ["Hello world", "next-", "ed"]
    assert Y.page_measures(lines).first().leading == 12


def test_sinks_and_folds(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, text string")
    new = spark.createDataFrame([(2, ""), (3, "c")], "k int, text string")
    assert sorted(map(tuple, sinks.upsert(old, new, "k").collect())) == [(1, "a"), (3, "c")]
    patches = spark.createDataFrame([(1, 1, "start", None), (1, 2, None, "hi"), (1, 3, None, P.CLEARED), (2, 1, "x", None)], "job int, ts int, status string, message string")
    got = {r.job: (r.status, r.message) for r in P.fold(patches, fields=("status", "message")).collect()}
    assert got == {1: ("start", None), 2: ("x", None)}
    sinks.write_job_bundle(spark.createDataFrame([("j", 1)], "job_key string, total int"), spark.createDataFrame([("j", 0, ["a"])], "job_key string, i int, pieces array<string>"), str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b/chunks")).first().pieces == ["a"]


def test_highlight_and_tags(spark):
    got = spark.createDataFrame([("One two. Three four.",)], "x string").select(T.highlight("x", F.array(F.lit("two."), F.lit("zzz"))).alias("y")).first().y
    assert [tuple(p) for p in got] == [("One ", False), ("two.", True), (" Three four.", False)]
    assert one(spark, "Calm, Female Vocals", T.has_vocal_tag) is True and one(spark, "calm piano", T.has_vocal_tag) is False


def test_hooks(spark):
    from quillmill.operators import hooks, signal

    df = spark.createDataFrame([(1, "Hello there. More", 1.0), (2, "", 1.0)], "k int, text string, speed double")
    rows = {r.k: r.samples for r in hooks.synthesise(df).collect()}
    assert len(rows[1]) == round(3 * 38) and rows[2] == []
    p = signal.pauses(spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0])], "k int, s array<float>"), "k", "s", 0.1, 2, 1, 3)
    assert [tuple(r) for r in p.collect()] == [(1, 1, 3)]
    with pytest.raises(KeyError):
        hooks.synthesise(df, "nobody")
