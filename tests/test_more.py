"""Golden vectors and small fixtures of lookups, passages, plans, layout, jobs and providers."""

import json
import sys
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmill.functions import maths as M
from quillmill.functions import speech as V
from quillmill.functions import text as T
from quillmill.operators import catalogue as C
from quillmill.operators import grounding as G
from quillmill.operators import hooks as H
from quillmill.operators import layout as Y
from quillmill.operators import lookups as K
from quillmill.operators import sentences as S
from quillmill.operators import signal
from quillmill.operators import timeline as TL
from quillmill.operators import writers as W
from quillmill.plans import summary as P
from quillmill.sources import files as X
from quillmill.sources import sinks
from quillmill.streaming import jobs as J


def test_highlight_marks_the_earliest_again_and_again(spark):
    def parts(text, *needles):
        df = spark.createDataFrame([(text, list(needles))], "t string, n array<string>")
        return [(p.text, p.hit) for p in df.select(T.highlight("t", F.col("n")).alias("h")).first().h]

    assert parts("a b a", "a") == [("a", True), (" b ", False), ("a", True)]
    assert parts("one two three", "two three", "two") == [("one ", False), ("two three", True)]
    assert parts("one two three", "two", "two three") == [("one ", False), ("two", True), (" three", False)]
    assert parts("x.y\\E(z", ".", "\\E") == [("x", False), (".", True), ("y", False), ("\\E", True), ("(z", False)]
    assert parts("none", "", "zz") == [("none", False)]


def test_vocal_tags(spark):
    df = spark.createDataFrame([("Calm,A_Capella",), ("voice,speech",), (None,)], "t string")
    assert [r.v for r in df.select(T.has_vocal_tag("t").alias("v")).collect()] == [True, False, False]


def test_pruned_keeps_the_latest_with_nulls(spark):
    df = spark.createDataFrame([("a", 3, None), ("b", 2, None), ("c", 1, "x")], "k string, at int, note string")
    assert [r.k for r in C.pruned(df, 2, "at").collect()] == ["c"]


def test_upsert_takes_one_row_of_a_key(spark):
    old = spark.createDataFrame([("a", "old", 1), ("b", "old", 1)], "k string, text string, at int")
    new = spark.createDataFrame([("a", "x", 2), ("a", "y", 3), ("b", "", 2)], "k string, text string, at int")
    assert [(r.k, r.text) for r in sinks.upsert(old, new, "k", at="at").collect()] == [("a", "y")]


def test_quiet_runs():
    x = np.array([1, 0, 0, 1, 0, 0, 0, 1, 1, 0, 0, 0, 0, 1, 0, 0], float)
    assert signal.quiet_runs(x, 0.5, 2, 1, 4) == [(1, 6)]  # the later ones are one run that touches the end
    assert signal.quiet_runs(x, 0.5, 2, 0, 3) == [(4, 6), (9, 12)]
    assert signal.quiet_runs(np.zeros(5), 0.5, 2, 1, 2) == signal.quiet_runs(np.empty(0), 0.5, 2, 1, 2) == []


def test_conditioning(spark):
    rate = 1000
    tone = np.sin(np.arange(400)) * 0.1
    x = np.concatenate([np.zeros(300), tone, np.zeros(200), tone, np.zeros(500)])
    pcm, m = signal.condition(x, rate, lead=0.05, tail=0.1, gap=0.4)
    assert m["speech_sec"] == pytest.approx(1.15, abs=0.01) and m["gap_sec"] == 0.4 and len(pcm) == round((m["speech_sec"] + 0.4) * rate)
    assert len(m["pauses"]) == 1 and m["pauses"][0][0] == pytest.approx(0.45, abs=0.02) and m["gain_db"] > 0 and m["raw_peak"] == pytest.approx(0.1, abs=1e-3)
    assert np.abs(pcm).max() <= 32767 and abs(pcm[0]) < 50 and (pcm[-400:] == 0).all()
    silent, m = signal.condition(np.zeros(100), rate)
    assert m["speech_sec"] == 0 and m["pauses"] == []
    df = spark.createDataFrame([("a", 1, x.tolist()), ("b", 0, None), ("c", 0, [])], "k string, i int, s array<float>")
    got = {r.k: r for r in signal.conditioned(df, ["k", "i"], "s", rate, gap=0.4).collect()}
    assert set(got) == {"a", "c"} and len(got["a"].pcm) == 2 * round((got["a"].speech_sec + 0.4) * rate) and got["c"].speech_sec == 0


def test_joined_sounds_and_bundles(spark, tmp_path):
    rows = [("a", 1, np.array([3, 4], "<i2").tobytes()), ("a", 0, np.array([1, 2], "<i2").tobytes()), ("b", 0, b"")]
    got = {r.k: bytes(r.wav) for r in sinks.joined_sounds(spark.createDataFrame(rows, "k string, i int, pcm binary"), "k", "i", "pcm", 8000).collect()}
    assert np.frombuffer(got["a"][44:], "<i2").tolist() == [1, 2, 3, 4] and X.wav_info(got["a"])[7] == 4 / 8000 and len(got["b"]) == 44
    jobs = spark.createDataFrame([("a", 3), ("b", 2)], "job_key string, total int")
    chunks = spark.createDataFrame([("a", i, [f"p{i}"]) for i in range(3)] + [("b", 0, None), ("a", 1, ["p1"])], "job_key string, i int, pieces array<string>")
    done = spark.createDataFrame([("a", 1)], "job_key string, i int")
    sinks.write_job_bundle(jobs, chunks, str(tmp_path), done)
    lines = spark.read.json(str(tmp_path / "chunks"))
    assert sorted((r.job_key, r.i) for r in lines.collect()) == [("a", 0), ("a", 2)]
    assert {r.job_key: r.pending for r in spark.read.json(str(tmp_path / "job")).collect()} == {"a": 2, "b": 0}


# -- lookups


def test_word_at(spark):
    seg = spark.createDataFrame([("a", 1.0, 3.0, 0, ["aa", "bbbb"]), ("a", 5.0, 6.0, 2, ["c"]), ("b", 0.0, 0.0, 0, ["z", "y"])], "k string, s double, e double, a int, words array<string>")
    at = [("a", t) for t in (0.5, 1.0, 1.7, 1.8, 3.0, 4.0, 5.0, 9.0)] + [("b", 0.0), ("c", 1.0)]
    got = {(r.k, r.at): r.word for r in K.word_at(spark.createDataFrame(at, "k string, at double"), seg, "k").collect()}
    assert got == {("a", 0.5): -1, ("a", 1.0): 0, ("a", 1.7): 0, ("a", 1.8): 1, ("a", 3.0): 1, ("a", 4.0): 1, ("a", 5.0): 2, ("a", 9.0): 2, ("b", 0.0): 1, ("c", 1.0): -1}


def test_segments_are_found_in_what_is_shown():
    shown = "The old house , and the garden behind it".split()
    assert TL.match_segments([(0, "the old house"), (1, "—"), (2, "zzz"), (3, "The Garden")], shown) == [(0, 0, 3), (2, 3, 4), (3, 5, 7)]
    assert TL.match_segments([(0, "far")], ["x"] * 80 + ["far"], 60) == [(0, 0, 1)]


# -- passages


def test_passage_issues(spark):
    claims = spark.createDataFrame([("1", "b", "It was 1999 then. He met Anna Karl in “a very old house” there. Then: Bob left."), ("2", "b", "")], "id string, book string, text string")
    passages = spark.createDataFrame([("1", "It was 1998 then, in a very old barn."), ("2", "x")], "id string, text string")
    books = spark.createDataFrame([("b", "Karl lived here.")], "book string, text string")
    none = spark.createDataFrame([], "id string, text string")
    got = {(r.kind, r.detail): r.sentence for r in G.passage_issues(claims, passages, books, none).collect()}
    assert got == {("number", "1999"): "It was 1999 then.", ("quote", "a very old house"): "He met Anna Karl in “a very old house” there.", ("name", "Anna"): "He met Anna Karl in “a very old house” there."}
    allowed = spark.createDataFrame([("1", "Anna 1999")], "id string, text string")
    assert {r.kind for r in G.passage_issues(claims, passages, books, allowed).collect()} == {"quote"}


# -- plans


def test_headings_are_made_whole():
    lines = ["Chapter", "", "I", "", "Why It Went", "Wrong", "Some text goes here.", "Transform Self-love into", "Empathy", "III", "More text, and more."]
    assert P.whole_headings([0, 2, 7, 9], lines) == [("Chapter I: Why It Went Wrong", "", 0, 5), ("Transform Self-love into Empathy", "", 7, 8), ("III", "", 9, 9)]
    fused = "The Law of Things e all know that this is a very long line of text that runs on and on"
    assert P.unfused(fused) == ("The Law of Things", fused[18:])
    assert P.unfused("How to think about money") == ("How to think about money", "")


def test_headings_are_repaired():
    words = {"letter", "before", "begin", "the", "wealth", "that", "remains"}
    assert P.repaired("THE WEALTH THAT REMAI NS", words) == "THE WEALTH THAT REMAINS"
    assert P.repaired("ALETTERBEFOREWEBEGIN", words) == "A LETTER BEFORE WE BEGIN"
    assert P.repaired("Unknownworditis", words) == "Unknownworditis"


def test_choice_of_sections():
    s = lambda *titles: [P.Section([t], [], 200) for t in titles]
    assert P.choose([s("Chapter 1", "Chapter 2", "Part 3"), s("a"), s("b")], 1) == 0
    assert P.choose([s("a"), s("b", "c"), s("d", "e")], 2) == 1
    assert P.choose([s("a", "b", "c"), s("d", "e"), s("f", "g")], 1) == 1


def book(chapters, words=400):
    body = " ".join(["Plain words go on and on here."] * (words // 7))
    return "\n".join(x for n in range(chapters) for x in (f"Chapter {n + 1}", body))


def test_sections_of_texts(spark):
    text = "Preface words here.\nChapter\n\nI\n\nThe Start\n" + "Plain words go on. " * 40 + "\nIndex\nZebra, see the horse of the field.\n"
    marks = spark.createDataFrame([("a", 1), ("a", 3), ("a", 7), ("a", 99)], "book_id string, line_idx int")
    books = spark.createDataFrame([("a", text), ("b", "No mark at all."), ("c", None), ("d", "")], "book_id string, text string")
    got = [(r.book_id, r.section, r.title, r.words) for r in P.sections_of(books, marks).orderBy("book_id", "section").collect()]
    assert got == [("a", 0, None, 3), ("a", 1, "Chapter I: The Start", 160), ("b", 0, None, 4), ("d", 0, None, 0)]


def test_plan_holds_its_budget():
    p = P.plan(book(6), 300, {}, 6)
    assert p["code"] is None and [i["titles"] for i in p["items"]] == [[f"Chapter {n + 1}"] for n in range(6)]
    assert sum(i["budget"] for i in p["items"]) + p["heading_words"] + 300 <= p["target"] == 990
    assert P.plan("short", 300, {}, 6)["code"] == "NO_TEXT" and P.plan(book(6), 300, {}, 2)["code"] == "SUMMARY_TOO_SHORT" and P.plan(book(1), 300, {}, 6)["code"] == "SUMMARY_TOO_LONG"
    merged = P.plan(book(30, 100), 300, {}, 4, chapters=False)
    assert merged["code"] is None and all(i["budget"] >= P.LEAST_SECTION for i in merged["items"]) and [i["context"] for i in merged["items"]] != []
    cut = P.plan(book(2, 4000), 300, {}, 25, most_input=1000)
    assert max(i["words"] for i in cut["items"]) <= 4100 and cut["items"][0]["parts"] >= 2


def test_plans_of_books(spark):
    rows = [("a", "Welcome to The Book, written by A. Writer.\n\nLet us begin.\n\n" + book(6), "x.txt"), ("b", None, None), ("c", "few words", "A Title - Some Body.pdf")]
    books = spark.createDataFrame(rows, "book_id string, text string, filename string").selectExpr("*", "1 as code")
    levels = spark.createDataFrame([], "book_id string, key string, level int")
    got = {r.book_id: r for r in P.public(P.plan_summaries(books, levels, 6)).collect()}
    assert set(got) == {"a", "c"} and (got["a"].title, got["a"].author, got["a"].certain, got["a"].code) == ("The Book", "A. Writer", True, None)
    assert len(got["a"].sections) == 6 and got["a"].units >= 1 and (got["c"].title, got["c"].author, got["c"].code) == ("A Title", "Some Body", "NO_TEXT")
    assert P.plan_summaries(books.limit(0), levels, 6).count() == 0
    s = W.summaries(books, levels, 6).collect()
    assert {r.book_id for r in s} == {"a"} and all(r.text and not r.missing for r in s)


# -- layout


def rows_of(spark, *lines):
    """Tokens of (x, y, size, words...) with the words' own widths."""
    out = []
    for x, y, h, *words in lines:
        for k, w in enumerate(words):
            at = x if not isinstance(w, tuple) else w[0]
            t = w if not isinstance(w, tuple) else w[1]
            out.append(("b", 0, k, t, float(at), float(y), len(t) * h * 0.5, float(h)))
            x = at + len(t) * h * 0.5 + 0.4 * h
    return spark.createDataFrame(out, "book_id string, page int, ord int, str string, x double, y double, w double, h double")


def test_letter_spaced_lines(spark):
    at = [0, 7, 14, 28, 35, 42]
    spaced = rows_of(spark, (0, 100, 10, *zip(at, "THEOLD")), (0, 80, 10, *zip(range(0, 60, 9), "GARDEN")), (0, 60, 10, "plain", "words"))
    assert [r.text for r in Y.lines(spaced).orderBy("line").collect()] == ["THE OLD", "GARDEN", "plain words"]


def test_margins_and_blocks(spark):
    body = [(20, 660 - 12 * k, 10, "some", "words", "that", "fill", "a", "line") for k in range(4)]
    l = Y.lines(rows_of(spark, (20, 760, 10, "The", "Book", "12"), (20, 690, 15, "A", "Title"), *body, (20, 606, 10, "•", "item", "one"), (40, 594, 10, "goes", "on"), (20, 520, 10, "13")))
    m = Y.page_measures(l)
    kept = Y.without_margins(l, m)
    texts = [r.text for r in kept.orderBy("line").collect()]
    assert texts[0] == "The Book" and "13" not in texts
    got = [(r.kind, r.level, r.text[:16]) for r in Y.page_blocks(kept, m).orderBy("block").collect()]
    assert ("heading", 1, "A Title") in got and ("list", None, "• item one goes ") in got and got[-1][0] == "list"
    assert sum(k == "paragraph" for k, _, _ in got) == 2  # the running head and the text


def test_drop_caps_join_their_line(spark):
    l = Y.lines(rows_of(spark, (20, 700, 10, "a", "line", "above", "it", "all"), (20, 660, 30, "W"), (40, 680, 10, "inter", "came", "and"), (40, 668, 10, "went", "again", "soon"), (20, 640, 10, "and", "so", "on", "it", "went")))
    texts = [r.text for r in Y.with_caps(l, Y.page_measures(l)).orderBy("line").collect()]
    assert "Winter came and" in texts and "W" not in texts and len(texts) == 4


# -- numbers, speech, sources


def test_waits_and_retry(spark):
    df = spark.createDataFrame([("5", 1.63), ("Wed, 21 Oct 2015 07:28:10 GMT", 0.25), ("soon", None), (None, None)], "h string, f double")
    now = F.lit("2015-10-21 07:28:00").cast("timestamp")
    assert [(r.a, r.c) for r in df.select(M.retry_after(F.col("h"), now).alias("a"), M.cost_text(F.col("f")).alias("c")).collect()] == [(5000.0, "1.6 h"), (10000.0, "15 min"), (None, None), (None, None)]
    n = spark.range(4000).select(M.normal_noise(3).alias("x")).agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
    assert abs(n.m) < 0.1 and abs(n.s - 1) < 0.1


def test_engine_text(spark):
    df = spark.createDataFrame([("Hi — “you”  _there_ 😀 [x] e.g., a@b ,ok", "en"), ("Ciao!", "it"), ("x", "xx"), (None, "en")], "t string, l string")
    got = [r.t for r in df.select(V.engine_text("t", F.col("l")).alias("t")).collect()]
    assert got == ['<en>Hi - "you" there x for example, a at b,ok.</en>', "<it>Ciao!</it>", None, None]


def test_engine_chunks():
    assert V.engine_chunks("Mr. A. Smith left. He ran.\n\nNew one.", 20) == ["Mr. A. Smith left.", "He ran.", "New one."]
    assert V.engine_chunks("") == [] and V.engine_chunks("x" * 400) == ["x" * 400]


def test_rendered_chunks(spark):
    paths = ["a/chunk-0001.wav", "a/chunk-0001.flac", "a/chunk-0003.wav", "a/chunk-0009.wav", "a/other.wav", "b/chunk-0002.wav", "b/chunk-0002.json"]
    got = [tuple(r) for r in X.rendered_chunks(spark.createDataFrame([(p,) for p in paths], "path string"), 5).orderBy("idx").collect()]
    assert got == [(0, "a/chunk-0001.flac"), (2, "a/chunk-0003.wav")]


# -- jobs and providers


def test_lifecycle_as_batch_and_stream(spark, tmp_path):
    rows = [("a", 1, 1, "start"), ("a", 2, 2, "progress"), ("a", 3, 3, "start"), ("a", 4, 4, "merge"), ("a", 5, 5, "end"), ("b", 1, 6, "progress"), ("c", 1, 7, "start"), ("c", 2, 8, "cancel"), ("c", 2, 9, "end")]
    df = spark.createDataFrame(rows, "job string, ts int, ord int, command string")
    want = {"a": ("done", 5), "b": ("idle", 1), "c": ("cancelled", 3)}
    assert {r.job: (r.state, r.commands) for r in J.lifecycle(df).collect()} == want
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    out = J.lifecycle_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    seen = []
    q = out.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.job: (r.state, r.commands) for r in seen} == want


def test_retries():
    waits, calls = [], []

    def flaky(request):
        calls.append(request)
        if len(calls) == 1:
            raise W.WriterError("RATE_LIMITED", 7.0)
        if len(calls) == 2:
            return "no json"
        return json.dumps({"paragraphs": ["ok"]})

    assert W.ask(W.Writer("x", flaky), {}, sleep=waits.append) == ({"paragraphs": ["ok"]}, None, 3) and waits == [7.0, 10.0]

    def refused(request):
        raise W.WriterError("AUTH")

    assert W.ask(W.Writer("x", refused), {}, sleep=waits.append) == (None, "AUTH", 1)

    def busy(request):
        raise W.WriterError("SERVER")

    assert W.ask(W.Writer("x", busy), {}, attempts=3, sleep=waits.append)[1:] == ("SERVER", 3)
    assert W.input_words("groq") == 5357 and W.input_words("ollama") == 7417 and W.input_words("claude") == 60_000
    assert W.strict_schema({"type": "object", "additionalProperties": False, "items": [{"$schema": 1, "a": 2}]}) == {"type": "object", "items": [{"a": 2}]}


def test_trimming_and_suggestions(spark):
    assert W.trimmed("One two. Three four.\n\nFive.", 3) == "One two." and W.trimmed(None, 3) is None and W.trimmed("One two three four.", 2) == "One two three four."
    lex = spark.createDataFrame([("calm", 0, "sea", 2), ("dark", 1, "night", 3)], "mood string, ord int, keyword string, weight int")
    texts = spark.createDataFrame([("1", "the night"), ("2", "the night")], "id string, text string")
    got = {r.id: (r.mood, r.by) for r in W.suggestion(texts, spark.createDataFrame([("1", "calm"), ("2", "odd")], "id string, mood string"), lex).collect()}
    assert got == {"1": ("calm", "provider"), "2": ("dark", "words")}


def test_engines(tmp_path):
    program = tmp_path / "speak.py"
    program.write_text("import sys, struct\nt = sys.stdin.read()\nsys.stdout.buffer.write(struct.pack('<%dh' % len(t), *([16384] * len(t))))\n")
    (x,) = H.program_engine([sys.executable, str(program), "{scale}"], 100)(["abc"], [2.0])
    assert x.tolist() == [0.5] * 3
    loads = []
    speak = H.model_engine(lambda: loads.append(1) or (lambda t, s: np.ones(len(t))), lambda t: t.split(), 2)
    assert [len(y) for y in speak(["ab c", ""], [1.0, 1.0])] == [5, 0] and len(speak(["a"], [1.0])[0]) == 1 and loads == [1]


def test_chunks_of_odd_texts(spark):
    df = spark.createDataFrame([("n", None), ("e", ""), ("b", " \n\n "), ("l", "word " * 3000)], "k string, t string")
    assert {r.k for r in S.chunk_table(df, "k", "t", 60).collect()} == {"l"}
    assert S.capped_pieces(df, "k", "t", 50).where("length(piece) > 50").count() == 0
    assert S.split_sentences(df.limit(0), "k", "t").count() == 0


@pytest.mark.parametrize("words, target", [([], 1.0)])
def test_weights_of_nothing(spark, words, target):
    df = spark.createDataFrame([(words,)], "w array<string>")
    assert df.select(K.total_weight(F.col("w")).alias("t"), K.words_before(F.col("w"), F.lit(target)).alias("n")).first() == (0, 0)


def test_carried_text(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * 4, "i": [0, 1, 2, 3], "text": ["One.\n\nTwo.", " ", "Three.", "Four."]}))
    assert [r.tail for r in J.carried(df, "k", "i").orderBy("i").collect()] == ["", "Two.", "Two.", "Three."]


def test_seek_looks_at_each_chunk_once(spark):
    """A feed over many stretches: chunks of no length, one longer than stretches, points on ends and outside."""
    words = [0, 0, 3, 0, 900, 5, 5, 0, 0, 700, 1, 0] * 9 + [0]
    ends = np.cumsum(words).astype(float)
    clock = [(k, i, float(e - w), float(e)) for k in ("feed", "other") for i, (w, e) in enumerate(zip(words, ends)) if k == "feed" or i < 5] + [("silent", 0, 0.0, 0.0), ("silent", 1, 0.0, 0.0)]
    at = sorted({-1.0, 0.0, 1e9, *ends, *(ends - 0.5), *(ends + 250)})
    points = spark.createDataFrame([(k, float(t)) for k in ("feed", "other", "silent") for t in at], "job_key string, at double")
    out = K.seek(points, spark.createDataFrame(clock, "job_key string, i int, start_sec double, end_sec double"), 100.0)
    want = {}
    for k in ("feed", "other", "silent"):
        own = [c for c in clock if c[0] == k]
        for t in at:
            _, i, start, _ = next((c for c in own if c[3] > max(0, t)), own[-1])
            want[k, t] = (i, round(max(0, t) - start, 2))
    got = [((r.job_key, r["at"]), (r.i, r["into"])) for r in out.collect()]
    assert len(got) == len(want) and dict(got) == want
    # a frame that shrinks at its start is summed up anew for each of its rows: the square of a feed's chunks
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$()" in plan and "specifiedwindowframe(RowFrame, 1, unboundedfollowing$())" not in plan


def test_seek_takes_a_long_feed(spark):
    n = 30_000
    clock = spark.range(n).selectExpr("'feed' as job_key", "cast(id as int) as i", "id * 10.0D as start_sec", "id * 10.0D + 10 as end_sec")
    points = spark.range(n).selectExpr("'feed' as job_key", "id * 10.0D + 4 as at")
    began = time.monotonic()
    assert K.seek(points, clock).where("into = 4 and i * 10.0D + 4 = at").count() == n
    assert time.monotonic() - began < 30
