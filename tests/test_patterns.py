"""Lists of strings in texts, by both ways, against plain search."""

import random

import numpy as np
import pytest

from factloom.operators import patterns


def plain(texts, listed):
    out = []
    for key, text in texts:
        for p in {p for p in listed if p}:
            at = (text or "").find(p)
            while at >= 0:
                out.append((key, p, at))
                at = text.find(p, at + 1)
    return sorted(out, key=str)


@pytest.mark.parametrize("most_chars", [patterns.MOST_CHARS, 0])
def test_both_ways_find_all(spark, most_chars):
    rng = random.Random(1)
    listed = ["".join(rng.choices("ab한😀", k=rng.randint(1, 6))) for _ in range(60)] + [None, "", "aa", "aa", "x" * 70, "발이 넓다"]
    texts = [(i, "".join(rng.choices("ab한😀 ", k=rng.randint(0, 160)))) for i in range(30)] + [(98, "a" * 300), (97, "x" * 180), (99, None), (100, ""), (None, "abab"), (3, "aab"), (3, "aab")]
    docs = spark.createDataFrame([(k, t, "p", 1) for k, t in texts], "key long, text string, pattern string, n int").repartition(3)
    got = patterns.occurrences(docs, spark.createDataFrame([(p,) for p in listed], "pattern string"), most_chars=most_chars, portion=50)
    assert got.columns == ["key", "n", "pattern", "at"]
    assert sorted(((r.key, r.pattern, r["at"]) for r in got.collect()), key=str) == plain(texts, listed)


@pytest.mark.parametrize("most_chars", [patterns.MOST_CHARS, 0])
def test_empty_lists_and_tables(spark, most_chars):
    docs, none = spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([], "pattern string")
    assert patterns.occurrences(docs, none, most_chars=most_chars).count() == 0
    assert patterns.occurrences(docs.where("false"), spark.createDataFrame([("a",)], "pattern string"), most_chars=most_chars).count() == 0


def test_list_size_hardly_matters(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(200))) for i in range(50)], "key long, text string")
    some = [r.text[:8] for r in docs.collect()]
    listed = spark.createDataFrame([(w,) for w in {word() for _ in range(100_000)} | set(some)], "pattern string")
    by_both = [sorted((r.key, r.pattern, r["at"]) for r in patterns.occurrences(docs, listed, most_chars=m).collect()) for m in (10**7, 0)]
    assert by_both[0] == by_both[1] and {(i, w, 0) for i, w in enumerate(some)} <= set(by_both[0])


def test_window_hashes():
    text = "a😀한b" * 9
    windows = patterns.Windows(text)
    for n in (1, 3, 36, 37):
        got = windows.of(n)
        assert len(got) == max(0, len(text) - n + 1)
        assert all(got[i] == patterns.Windows(text[i : i + n]).of(n)[0] for i in range(len(got)))
    assert len(np.unique(windows.of(3))) == len({text[i : i + 3] for i in range(34)})


@pytest.mark.parametrize("most", [patterns.MOST_BROADCAST, 0])
def test_windows_stay_where_they_are_if_few_strings_are_met(spark, monkeypatch, most):
    monkeypatch.setattr(patterns, "MOST_BROADCAST", most)
    texts = [(i, f"ab{i % 7} xyz ab{i % 7} " * 3) for i in range(40)]
    listed = [f"b{i}" for i in range(5)] + ["xyz", "never"]
    got = patterns.occurrences(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame([(p,) for p in listed], "pattern string"), most_chars=0)
    assert sorted(((r.key, r.pattern, r["at"]) for r in got.collect()), key=str) == plain(texts, listed)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (most == 0) and ("BroadcastHashJoin" in plan) == (most > 0)


def test_a_larger_table_has_more_tasks_of_one_size(spark, tmp_path):
    from factloom import queries

    spark.range(3_000_000).repartition(1).write.parquet(str(tmp_path / "large.parquet"))
    rows = spark.read.parquet(str(tmp_path / "large.parquet"))
    size = sum(p.stat().st_size for p in (tmp_path / "large.parquet").glob("*.parquet"))
    old, queries.SHARE = queries.SHARE, size // 10
    try:
        assert queries.shares(rows) >= 10
    finally:
        queries.SHARE = old
