"""Verdicts by tables of facts are those of the gate row by row."""

import collections
import datetime

from factloom import queries
from factloom.operators import fact_tables, gate
from factloom.plans import notices
from tests.test_adversarial import CASES, REF, SAME

SOURCES, EASIES = "source_id long, source_text string, ref_date date, easy_id string", "easy_id long, source_id long, easy_text string, ref_date int"
FLIPS = ("date_flips", "scope_flips", "negation_flips")


def by_rows(pairs, key="i"):
    return collections.Counter((r[key], r.verdict, len(r.slots), tuple((x.type, x.value) for x in r.failed), *(r[f] for f in FLIPS)) for r in gate.verified(pairs).collect())


def by_tables(sources, easies):
    return collections.Counter((r.easy_id, r.verdict, r.n_facts, tuple((x.type, x.value) for x in r.failed), *(r[f] for f in FLIPS)) for r in fact_tables.judged(sources, easies).collect())


def test_every_family_with_its_own_and_with_other_texts(spark):
    texts = [(a, a if b is SAME else b) for a, b, _ in CASES]
    sources = sorted({a for a, _ in texts}, key=str)
    of = {a: i for i, a in enumerate(sources)}
    # each source with the easy texts of its cases, and with those of the cases before and after
    pairs = [(of[texts[i][0]], texts[(i + k) % len(texts)][1]) for i in range(len(texts)) for k in (0, 1, -1)]
    pairs += [(of[texts[0][0]], t) for t in (None, "", "　", texts[0][1], texts[0][1])]
    rows = spark.createDataFrame([(i, sources[s], e, REF) for i, (s, e) in enumerate(pairs)], "i long, source_text string, easy_text string, ref_date date")
    made = fact_tables.judged(spark.createDataFrame([(i, a, REF, "x") for i, a in enumerate(sources)], SOURCES), spark.createDataFrame([(i, s, e, 1) for i, (s, e) in enumerate(pairs)], EASIES))
    assert made.columns == ["easy_id", "source_id", "n_facts", "failed", *FLIPS, "verdict"]
    got = {r.easy_id: (r.verdict, r.n_facts, [(x.type, x.value) for x in r.failed], *(r[f] for f in FLIPS)) for r in made.collect()}
    want = {r.i: (r.verdict, len(r.slots), [(x.type, x.value) for x in r.failed], *(r[f] for f in FLIPS)) for r in gate.verified(rows).collect()}
    wrong = {i: (pairs[i], sources[pairs[i][0]], got.get(i), want[i]) for i in want if got.get(i) != want[i]}
    assert not wrong and len(got) == len(pairs)
    assert len({v[0] for v in got.values()}) == 3 and all(any(v[3 + k] for v in got.values()) for k in range(3))


def test_nulls_repeated_rows_and_empty_tables(spark):
    text, later = "회비 30,000원을 냅니다.", "회비 40,000원을 냅니다."
    sources = spark.createDataFrame([(1, text, None, "a"), (1, later, REF, "a"), (2, None, REF, "a"), (3, "5일 이내 30명이 옵니다.", None, "a"), (None, text, REF, "a"), (4, "안녕하세요.", REF, "a")], SOURCES)
    easies = [(1, 1, "30,000원"), (1, 1, "30,000원"), (2, 1, "40,000원"), (3, 2, "글"), (4, 9, "글"), (5, None, text), (None, 1, "3만원"), (6, 3, "30명"), (7, 4, None)]
    got = collections.Counter((r.easy_id, r.verdict) for r in fact_tables.judged(sources, spark.createDataFrame([(*e, 1) for e in easies], EASIES)).collect())
    assert got[1, "pass"] == 2 and got[2, "revise"] == got[3, "human_review"] == got[4, "human_review"] == got[5, "human_review"] == got[6, "pass"] == got[7, "pass"] == 1
    assert sum(got.values()) == len(easies) and sum(v for (i, _), v in got.items() if i is None) == 1
    no_sources, no_easies = spark.createDataFrame([], SOURCES), spark.createDataFrame([], EASIES)
    assert fact_tables.judged(sources, no_easies).count() == fact_tables.judged(no_sources, no_easies).count() == 0
    assert [r.verdict for r in fact_tables.judged(no_sources, spark.createDataFrame([(1, 1, text, 1)], EASIES)).collect()] == ["human_review"]


def test_a_source_of_most_easy_texts(spark):
    orders = spark.createDataFrame([(k, k * 7, 1234.5 + k, datetime.date(2026, 7, 1 + k % 28)) for k in range(3)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date")
    pairs = notices.pairs(orders).unionByName(notices.pairs(orders.where("o_orderkey = 0"), 3)).collect()
    easies = [(i, r.o_orderkey, r.easy_text, 1) for i, r in enumerate(pairs)] + [(100 + i, 0, pairs[i % 4].easy_text, 1) for i in range(60)]
    source = {r.o_orderkey: (r.source_text, r.ref_date) for r in pairs}
    rows = spark.createDataFrame([(i, source[s][0], e, source[s][1]) for i, s, e, _ in easies], "i long, source_text string, easy_text string, ref_date date")
    assert by_tables(spark.createDataFrame([(k, *v, "x") for k, v in source.items()], SOURCES), spark.createDataFrame(easies, EASIES)) == by_rows(rows)
    assert "fact_table_verdicts" in queries.queries() and "fact_table_verdicts" in queries.oracle_sql()


def test_only_facts_that_are_missing_move(spark):
    """What stands in an easy text is told in its row; facts are not dealt by kind and key to meet it."""
    text = "회비 30,000원을 2026년 7월 17일까지 강서구청에 내세요. 문의 031-123-4567"
    sources = spark.createDataFrame([(1, text, REF, "a")], SOURCES)
    easies = spark.createDataFrame([(1, 1, text, 1), (2, 1, text.replace("30,000", "40,000"), 1), (3, 1, None, 1), (4, 9, text, 1)], EASIES)
    read = fact_tables.easy_facts(easies, fact_tables.source_facts(sources))
    got = {r.easy_id: [(x.type, x.value) for x in r.missing or []] for r in read.collect()}
    assert got == {1: [], 2: [("money", "30000")], 3: [("money", "30000"), ("date", "2026-07-17|inclusive"), ("contact", "0311234567"), ("agency", "강서구청")], 4: []}
