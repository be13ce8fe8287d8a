"""Queries read all of their input, however much there is."""

import os

import pytest
from oracle import SF, bag, sql

import quillmill.catalog  # noqa: F401
from quillmill.queries import QUERIES, SQL


def test_level_map_is_of_each_book(spark, tmp_path):
    n = 3000
    rows = [(f"b{b}", i, f"Heading {'same' if i == 0 else i}", 1 + b) for b in range(2) for i in range(n)] + [("long", i, f"Part {i}", 1) for i in range(5001)]
    df = spark.createDataFrame(rows, "book_id string, line_idx int, title string, level int").selectExpr("*", "'heading' as kind")
    df.select("book_id", "line_idx", "title").write.parquet(str(tmp_path / "chapters.parquet"))
    df.select("book_id", "line_idx", "kind", "level").write.parquet(str(tmp_path / "outline_entries.parquet"))
    out = QUERIES["level_map"](spark, str(tmp_path))
    got = {(r.book_id, r.key): r.level for r in out.collect()}
    assert got["b0", "heading same"] == 1 and got["b1", "heading same"] == 2
    assert sum(book == "b1" for book, _ in got) == n
    assert sum(book == "long" for book, _ in got) == 5000 and ("long", "part 5000") not in got


def test_line_tests_take_lines_of_any_length(spark, tmp_path):
    prose, matter, short = "word " * 30, "Also by " + "x" * 130, "Chapter 1"
    spark.createDataFrame([("b", "\n".join([prose, matter, short]))], "book_id string, text string").write.parquet(str(tmp_path / "books.parquet"))
    got = {r.line: r for r in QUERIES["line_tests"](spark, str(tmp_path)).collect()}
    assert set(got) == {prose, matter, short}
    assert got[prose].prose and not got[prose].heading_like and not got[prose].real_heading
    assert got[matter].not_the_book and not got[matter].title_like


def test_line_tests_same_rows_as_sql_without_length(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    theirs = sql(SQL["line_tests"].replace(" WHERE length(line) <= 120", ""))
    assert theirs.line.str.len().max() > 120
    assert bag(QUERIES["line_tests"](spark, SF).toPandas()) == bag(theirs)


def test_sample_text_keeps_20000_characters(spark, tmp_path):
    long = "".join(f"{i:07d} " for i in range(3000))
    rows = [("short", long[:3001]), ("full", long[:20_000]), ("long", long)]
    spark.createDataFrame(rows, "book_id string, text string").write.parquet(str(tmp_path / "books.parquet"))
    got = {r.book_id: r["sample"] for r in QUERIES["sample_text"](spark, str(tmp_path)).collect()}
    middle = len(long) // 2 - 3333
    assert got["short"] == long[:3001] and got["full"] == long[:20_000]
    assert got["long"] == "\n".join([long[:6666], long[middle : middle + 6666], long[-6666:]])


def test_speech_rate_is_measured(spark, tmp_path):
    at = "timestamp'2024-07-19 00:00:00'"
    chunks = [("fast", 0, ["word " * 50], 50), ("fast", 0, ["word " * 50], 50), ("fast", 1, ["word " * 50], 25), ("fast", 2, None, 90), ("few", 0, ["One two."], 2), ("none", 0, None, None)]
    spark.createDataFrame(chunks, "job_key string, i int, pieces array<string>, words int").selectExpr("*", f"{at} as received_at").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([("fast", 2.0), ("few", 1.25), ("none", 0.25)], "job_key string, speed double").write.parquet(str(tmp_path / "jobs.parquet"))
    got = {r.job_key: (r.seconds_per_word, r.words) for r in QUERIES["speech_rate"](spark, str(tmp_path)).collect()}
    assert got == {"fast": (round(100 * 0.19 / 75, 4), 75), "few": (0.304, 2), "none": (0.76, 0)}
