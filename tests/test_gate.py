"""The fidelity gate, case by case."""

import datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import normalize
from factloom.operators import distort, gate
from factloom.plans import notices
from tests.test_adversarial import CASES, SAME

REF = datetime.date(2026, 7, 1)


def judge(spark, rows):
    df = spark.createDataFrame([(i, s, e, REF) for i, (s, e) in enumerate(rows)], "i int, source_text string, easy_text string, ref_date date")
    return {r.i: r for r in gate.verified(df).collect()}


CASES = [
    ("수수료 30,000원을 내세요.", "수수료 30,000원을 내요.", "pass"),
    ("수수료 30,000원을 내세요.", "수수료 3,000원을 내요.", "revise"),
    ("2026년 7월 17일까지 내세요.", "7월 17일까지 내요.", "pass"),
    ("2026년 7월 17일까지 내세요.", "2026년 7월 17일 전에 내요.", "human_review"),
    ("2026년 7월 17일까지 내세요.", "내세요.", "revise"),
    ("2026년 7월 17일까지 하나, 2027년 7월 17일까지 둘.", "7월 17일까지 하나.", "revise"),
    ("만 65세 이상만 됩니다.", "65세 이상만 돼요.", "pass"),
    ("만 65세 이상만 됩니다.", "65세 이하만 돼요.", "human_review"),
    ("정원 5,000명 이상.", "정원 15,000명 이상.", "revise"),
    ("30세 이상과 30세 미만.", "30세 이상과 30세 이상.", "human_review"),
    ("대상에서 제외됩니다.", "대상에서 제외됩니다.", "pass"),
    ("대상에서 제외됩니다.", "대상에 들어가요.", "human_review"),
    ("대상에서 제외됩니다.", "제외됩니다 라고 생각하기 쉽습니다.", "human_review"),
    ("강서구청에 오세요.", "강서 구청에 오세요.", "pass"),
    ("강서구청에 오세요.", "송파구청에 오세요.", "human_review"),
    ("신청자 1명.", "신청자 한 명.", "pass"),
    ("비율은 32퍼센트.", "비율은 32%.", "pass"),
    ("문의 02-1234-5678", "문의 02 1234 5678", "pass"),
    ("문의 02-1234-5678", "문의 없이", "revise"),
    ("   ", "아무 말", "human_review"),
    (None, "아무 말", "human_review"),
]


def test_verdicts(spark):
    got = judge(spark, [(s, e) for s, e, _ in CASES])
    assert [(i, got[i].verdict) for i in range(len(CASES))] == [(i, v) for i, (_, _, v) in enumerate(CASES)]


def test_rounding_needs_the_allowed_value(spark):
    df = spark.createDataFrame([("약 3,000원 듭니다.", "약 2,900원 들어요.", REF)], "source_text string, easy_text string, ref_date date")
    assert gate.verified(df).first().verdict == "revise"
    assert gate.verified(df, rounding_allowed=("3000",)).first().verdict == "pass"


@pytest.mark.parametrize("text,value", [("삼만원", 30000), ("약 3억 원", 300000000), ("3만5천원", 35000), ("금 1,200,000원정", 1200000), ("십", 10), ("만", 10000), ("abc", None), ("", None), ("123456789012345678901", None)])
def test_korean_numbers(spark, text, value):
    assert spark.range(1).select(normalize.korean_number(F.lit(text)).alias("v")).first().v == value


def test_dates(spark):
    texts = ["2026. 7. 3까지", "D-3", "5일 이내", "2026년 13월 1일", "없음"]
    rows = spark.createDataFrame([(t, REF) for t in texts], "t string, r date").select(normalize.date_iso(F.col("t"), F.col("r")).alias("d")).collect()
    assert [r.d for r in rows] == ["2026-07-03", "2026-07-04", "2026-07-06", None, None]


def test_distortions_are_caught(spark):
    text = "여러분, 30,000원을 2026년 7월 17일까지 강서구청에 내세요. 65세 이상은 제외됩니다. 10명 미만이면 됩니다."
    pairs = spark.createDataFrame([(text, text, REF)], "source_text string, easy_text string, ref_date date")
    cases = distort.distorted(pairs)
    recall = {r.distortion_type: r.recall for r in distort.by_type(cases, gate.verified).collect()}
    assert recall == {"number_swap": 1, "date_shift": 1, "inclusivity_flip": 1, "negation_drop": 1, "condition_flip": 1, "range_weaken": 1, "entity_swap": 1, "hallucinated_entity": 0}
    total = distort.overall(cases, gate.verified).first()
    assert (total.n_clean, total.fp, total.clean_fp_rate, total.precision) == (1, 0, 0.0, 1.0)
    empty = distort.overall(cases.where("false"), gate.verified).first()
    assert (empty.n_cases, empty.f1, empty.recall) == (0, 0.0, 0.0)


def test_undistorted_texts_of_all_orders(spark):
    orders = spark.sql("SELECT id AS o_orderkey, id AS o_custkey, 1000.5D + id AS o_totalprice, DATE'1995-03-08' AS o_orderdate FROM range(24)")
    clean = distort.distorted(notices.pairs(orders, case=0)).where("is_clean")
    assert gate.verified(clean).where("verdict = 'pass'").count() == 24


LONG = "구천구백구십구억구천구백구십구만구천구백구십구원"


@pytest.mark.parametrize("text,value", [(LONG, 999_999_999_999), ("구백이십이경삼천삼백칠십이조삼백육십팔억오천사백칠십칠만오천팔백칠원", 9223372036854775807), ("구백이십이경삼천삼백칠십이조삼백육십팔억오천사백칠십칠만오천팔백팔원", None), ("9223372036854775807", 9223372036854775807), ("9223372036854775808", None), ("9223372036854775808천", None), ("000000000000000000000000012", 12)])
def test_long_numbers(spark, text, value):
    assert spark.range(1).select(normalize.korean_number(F.lit(text)).alias("v")).first().v == value


def test_a_long_spelled_amount_must_survive(spark):
    got = judge(spark, [(f"대금 {LONG}을 내세요.", f"돈 {LONG}을 내요."), (f"대금 {LONG}을 내세요.", f"돈 {LONG[:-2]}팔원을 내요.")])
    assert [got[i].verdict for i in range(2)] == ["pass", "revise"]


def test_numbers_of_telephones_are_no_days(spark):
    source, day = "2026년 5월 12일까지 내세요. 문의 031-1005-1234", datetime.date(2026, 1, 1)
    rows = [(source, "2026년 5월 19일까지 내요. 문의 031-1005-1234", day), (source, "5월 12일까지 내요. 문의 031-1005-1234", day)]
    got = gate.verified(spark.createDataFrame(rows, "source_text string, easy_text string, ref_date date")).collect()
    assert [(r.verdict, [s.type for s in r.failed], r.date_flips) for r in got] == [("revise", ["date"], 0), ("pass", [], 0)]


def test_spelled_numbers_keep_all_digits(spark):
    numbers = [438799999994, 158999999999, 99999999, 9999999999999999, 10000, 1, 12345678901234567890, 10**16]
    rows = spark.createDataFrame([(str(n),) for n in numbers], "n string").select("n", notices.spelled(F.col("n").cast("decimal(38,0)")).alias("s"))
    assert [r.v for r in rows.select(normalize.amount(F.col("s")).alias("v")).collect()] == [str(n) for n in numbers]


def test_another_amount_is_no_fault_where_the_first_one_stands_too(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from factloom import queries

    con = duckdb.connect()
    con.sql(f"COPY (SELECT CAST(i AS BIGINT) AS o_orderkey, CAST(1 AS BIGINT) AS o_custkey, CASE WHEN i % 24 < 12 THEN 31000.5 ELSE 777.0 END AS o_totalprice, TIMESTAMP '1999-05-12' AS o_orderdate FROM range(48) t(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    for name in ("fidelity_verdicts", "slot_survival_failures", "fact_table_verdicts"):
        got = [tuple(r) for r in queries.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(con.sql(queries.oracle_sql()[name]).fetchall()), name


def test_the_verdict_alone_is_that_of_the_whole_gate(spark):
    source = "대금 1,234원을 2026년 7월 17일까지 강서구청에 내세요. 만 20세 이상은 제외됩니다. 하지 \t않는 곳은 없음. 소득이 삼만원 미만. 세 명, 문의 031-123-4567"
    changes = (("", ""), ("1,234원", "1,235원"), ("까지", " 전에"), ("17일", "18일"), ("강서구청", "송파구청"), ("이상", "이하"), ("제외", "포함"), ("지 \t않", "지 않"), ("없음", "없지 않음"), ("삼만원", "30,000 원"), ("미만", ""), ("4567", "4568"), ("20세", "21세"), ("세 명", "네 명"))
    easies = [source.replace(a, b) if a else source for a, b in changes] + [source.replace("20세 ", "20세 이하 20세 "), "", None]
    rows = [(i * 100 + j, s, e, d) for i, (s, d) in enumerate(((source, "2026-07-01"), (source + " 2027년 7월 17일까지 D-3", None), (" ", None), (None, None))) for j, e in enumerate(easies)]
    pairs = spark.createDataFrame(rows, "id int, source_text string, easy_text string, ref_date string")
    for options in ({}, {"rounding_allowed": ("1234",)}, {"criticality": {"money": "low", "date": "low"}}):
        whole = {r.id: r.verdict for r in gate.verified(pairs, **options).select("id", "verdict").collect()}
        alone = gate.verdicts(pairs, **options)
        assert {r.id: r.verdict for r in alone.collect()} == whole and len(set(whole.values())) == 3
        assert "slots" not in alone.columns
    found = gate.verdicts(gate.with_facts(pairs), facts="source_slots")
    assert {r.id: r.verdict for r in found.collect()} == {r.id: r.verdict for r in gate.verified(pairs).collect()}


def test_findings_are_those_of_the_whole_gate(spark):
    rows = [(i, a, a if b is SAME else b, REF, c) for i, (a, b, _) in enumerate(CASES) for c in (None, 0.3)] + [(900, None, "글", REF, None), (901, "", "글", REF, None), (902, "회비 30,000원, 30,000원입니다.", None, REF, None), (903, "3일 이내 30명", "30명", None, None)]
    pairs = spark.createDataFrame(rows, "id long, source_text string, easy_text string, ref_date date, confidence double").withColumn("id", F.monotonically_increasing_id()).cache()
    pair = lambda s: (s.type, s.value)
    for options in ({}, {"criticality": {"agency": "low", "date": "low", "scope": "low"}}):
        of = lambda df: {r.id: r for r in df.collect()}
        whole, found = of(gate.verified(pairs, **options)), of(gate.findings(pairs, **options))
        assert len(found) == len(whole) == len(rows)
        for i, w in whole.items():
            f = found[i]
            assert list(map(pair, f.facts)) == [pair(s) for s in w.slots if s.criticality == "high"] and list(map(pair, f.failed)) == list(map(pair, w.failed))
            assert [f[c] for c in (*gate.FLIPS, "verdict")] == [w[c] for c in (*gate.FLIPS, "verdict")]
        by_keys = of(gate.verdicts(gate.with_keys(pairs, **options), keys="source_keys"))
        assert {i: r.verdict for i, r in by_keys.items()} == {i: r.verdict for i, r in whole.items()} and "source_keys" not in next(iter(by_keys.values())).asDict()
    some = gate.findings(pairs, ("date_flips",))
    assert some.columns == ["id", "source_text", "easy_text", "ref_date", "confidence", "date_flips"]
    assert gate.findings(pairs.where("false")).count() == 0


def test_an_operand_beside_digits_is_another(spark):
    """Places of an operand are told without a pattern where it stands once; where it does not, each counts."""
    texts = [("만 9세 이상입니다.", "만 19세 이하입니다."), ("만 9세 이상입니다.", "만 19세 이하, 9세 이상입니다."), ("만 9세 이상입니다.", "9세 이하입니다."), ("만 9세 이상입니다.", "9세 이하 9세 이상입니다."), ("만 9세 이상입니다.", "９9세 이하입니다."), ("만 9세 이상입니다.", "만 9세까지입니다.")]
    df = spark.createDataFrame([(i, *t, REF) for i, t in enumerate(texts)], "id int, source_text string, easy_text string, ref_date date")
    lost = {r.id: (r.scope_flips, "scope" in [s.type for s in r.failed]) for r in gate.findings(df).collect()}
    assert lost == {0: (0, True), 1: (0, False), 2: (1, False), 3: (0, False), 4: (0, True), 5: (1, False)}
