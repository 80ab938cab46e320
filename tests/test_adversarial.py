"""Texts that try to slip past the gate, family by family, in words of our own; and what the surrounding modules do with nulls, clashing columns and repeated rows."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom import cli
from factloom.functions import html, normalize, text
from factloom.operators import audit, distort, gate, pictograms, rules, segment
from factloom.plans import annotation, revision
from factloom.sources import documents, trees

REF = datetime.date(2026, 7, 1)
PAIR = "i int, source_text string, easy_text string, ref_date date"
SAME = "same"

# source, easy text, verdict (None: anything but pass)
CASES = [
    # deadlines whose last day is lost
    ("수도 요금은 2026년 9월 30일까지 냅니다.", "수도 요금은 2026년 9월 30일 전에 내요.", "human_review"),
    ("수도 요금은 2026년 9월 30일까지 냅니다.", "수도 요금은 2026년 9월 30일 이전에 내요.", "human_review"),
    ("수도 요금은 2026년 9월 30일까지 냅니다.", "수도 요금은 2026년 9월 30일 내요.", None),
    ("수도 요금은 2026년 9월 30일까지 냅니다.", SAME, "pass"),
    ("수도 요금은 2026-09-30까지 냅니다.", "수도 요금은 9월 30일까지 내요.", "pass"),
    # bounds
    ("만 18세 이상만 옵니다.", SAME, "pass"),
    ("월급 200만원 미만 가구가 받습니다.", SAME, "pass"),
    ("모집 50명 초과 때 닫습니다.", SAME, "pass"),
    ("만 18세 이상만 옵니다.", "만 18세 이하만 와요.", "human_review"),
    ("월급 200만원 미만 가구가 받습니다.", "월급 200만원 이하 가구가 받아요.", "human_review"),
    ("만 18세 이상만 옵니다.", "만 18세만 와요.", "human_review"),
    ("만 18세 이상만 옵니다.", "만 19세 이상만 와요.", "revise"),
    # amounts
    ("회비 2,345,600원을 냅니다.", "회비는 약 235만 원입니다.", "revise"),
    ("회비 2,345,600원을 냅니다.", "회비는 2,345,600원이에요.", "pass"),
    ("회비 2,345,600원을 냅니다.", "회비는 2345600 원이에요.", "pass"),
    ("회비 삼십만원을 냅니다.", "회비는 300,000원이에요.", "pass"),
    ("회비 123,456,789,012,345,678,901원을 냅니다.", "회비를 내요.", "revise"),
    ("회비 123,456,789,012,345,678,901원을 냅니다.", "회비는 123456789012345678901원이에요.", "pass"),
    ("천이백삼십사억오천육백칠십팔만구천백이십삼원을 냅니다.", "돈을 내요.", "revise"),
    ("천이백삼십사억오천육백칠십팔만구천백이십삼원을 냅니다.", "123,456,789,123원을 내요.", "pass"),
    ("구천구백구십구경구천구백구십구조구천구백구십구억구천구백구십구만구천구백구십구원을 냅니다.", "구천구백구십구경구천구백구십구조구천구백구십구억구천구백구십구만구천구백구십팔원을 내요.", "revise"),
    # thresholds with commas
    ("주민 40,000명 이상인 곳만 됩니다.", "주민 70,000명 이상인 곳만 돼요.", None),
    ("주민 40,000명 이상인 곳만 됩니다.", "주민 40,000명 미만인 곳만 돼요.", "human_review"),
    ("돈은 7,000원 이상이고, 벌이는 80,000원 미만입니다.", SAME, "pass"),
    ("자리가 3,000명 이상이어야 합니다.", "자리가 13,000명 이상이어야 해요.", None),
    # one threshold with two bounds
    ("만 40세 미만은 가, 만 40세 이상은 나.", SAME, "pass"),
    ("만 40세 미만은 가, 만 40세 이상은 나.", "만 40세 미만은 가, 만 40세 미만은 나.", "human_review"),
    # one day in two years
    ("처음은 2024년 5월 9일까지, 다음은 2025년 5월 9일까지.", "5월 9일까지예요.", None),
    ("처음은 2024년 5월 9일까지, 다음은 2025년 5월 9일까지.", SAME, "pass"),
    # negation that is taken back
    ("빚이 있으면 대상에서 제외됩니다.", "빚이 있으면 제외됩니다 라고 생각하지만 그렇지 않아요.", "human_review"),
    ("빚이 있으면 대상에서 제외됩니다.", "빚이 있어도 제외되지 않고 받아요.", "human_review"),
    ("빚이 있으면 대상에서 제외됩니다.", SAME, "pass"),
    ("빚이 있으면 받을 수 없습니다.", "빚이 있으면 받을 수 있어요.", "human_review"),
    # nothing to hold on to
    ("", "2031년 1월 1일까지 누구나 받아요.", "human_review"),
    (None, None, "human_review"),
    ("강남구청에 냅니다.", None, "human_review"),
    # agencies
    ("신고는 강남구청에 합니다.", "신고는 서초구청에 해요.", "human_review"),
    ("신고는 강남구청에 합니다.", "신고를 해요.", None),
    ("신고는 강남구청에 합니다.", "신고는 강남 구청에 해요.", "pass"),
    ("신고는 강남구청에 합니다.", "신고는 서초 구청에 해요.", "human_review"),
    ("병원비는 국민건강보험공단이 냅니다.", "병원비는 근로복지공단이 내요.", "human_review"),
    ("상담은 서울국세청 앞에서 합니다.", "상담은 서울 국세청 앞에서 해요.", "pass"),
    # counts
    ("올해는 모두 120명입니다.", "올해는 모두 1,200명이에요.", "revise"),
    ("올해는 모두 120명입니다.", "올해는 120명이에요.", "pass"),
    ("모임은 2,000명입니다.", "모임은 12,000명이에요.", None),
    ("벌이의 45퍼센트입니다.", "벌이의 45%예요.", "pass"),
    ("아이 3명마다 5,000원을 줍니다.", "아이 세 명마다 5,000원을 줘요.", "pass"),
    ("기간은 6개월입니다.", "기간은 반년이에요.", "pass"),
    # digits of other scripts
    ("２０２６년 ７월 １７일까지 냅니다.", "2026년 7월 17일까지 내요.", "pass"),
    ("2026년 7월 17일까지 냅니다.", "７월 １７일까지 내요.", "pass"),
    ("2026년 7월 17일까지 냅니다.", "７월 １８일까지 내요.", None),
    ("D-３ 안에 냅니다.", "2026-07-04 안에 내요.", "pass"),
    ("３０,０００원을 냅니다.", "30,000원을 내요.", "pass"),
    ("모두 ４５명입니다.", "모두 45명이에요.", "pass"),
    ("D-999999999 뒤에 봅니다.", "아무 때나 봐요.", "revise"),
    ("D-9999999 뒤에 봅니다.", "아무 때나 봐요.", "pass"),
]


def judge(spark, rows, **how):
    df = spark.createDataFrame([(i, s, s if e == SAME else e, REF) for i, (s, e, *_) in enumerate(rows)], PAIR)
    return {r.i: r for r in gate.verified(df, **how).collect()}


def test_families(spark):
    got = judge(spark, CASES)
    wrong = [(CASES[i], got[i].verdict) for i in range(len(CASES)) if (got[i].verdict == "pass" if CASES[i][2] is None else got[i].verdict != CASES[i][2])]
    assert not wrong


def test_slots_keep_spans_and_places(spark):
    source = "１,5명 말고 5명. 약 30,000원, 만 65세 이상 65세 이상. 문의 02-123-4567, 강서구청 아니면 국세청. 2026. 7. 3까지"
    row = spark.createDataFrame([(source,)], "t string").select(gate.slots(F.col("t"), F.lit(REF), criticality={"agency": "low"}).alias("s")).first()
    assert all(source[s.source_offset :].startswith(s.raw_span) or source[s.source_offset :].lstrip().startswith(s.raw_span) for s in row.s)
    assert [(s.raw_span, s.source_offset) for s in row.s if s.type == "numeric"] == [("5명", source.index(" 5명") + 1), ("65세", source.index("65세")), ("65세", source.rindex("65세"))]
    assert {s.type: s.criticality for s in row.s} == {k: "low" if k == "agency" else "high" for k in gate.KINDS}
    one = spark.createDataFrame([(source,)], "t string").select(gate.slots(F.col("t"), F.lit(REF), kinds=("contact",)).alias("s")).first()
    assert [s.value for s in one.s] == ["021234567"]


def test_facts_of_low_criticality_are_not_verified(spark):
    rows = [("강서구청에 30,000원을 내세요.", "송파구청에 30,000원을 내요.")]
    assert judge(spark, rows)[0].verdict == "human_review"
    assert judge(spark, rows, criticality={"agency": "low"})[0].verdict == "pass"


def test_flags_say_what_changed(spark):
    got = judge(spark, [("2026년 9월 30일까지, 만 40세 이상. 빚은 제외됩니다.", "2026년 9월 30일 전에, 만 40세 이하. 빚도 포함됩니다."), (" ", "글")])
    assert got[0].drift_flags == ["부정 '제외' 없음 (긍정하는 말이 있음)", "기한 '2026년 9월 30일까지' 약해짐", "조건 '40세 이상' 바뀜"]
    assert (got[0].date_flips, got[0].scope_flips, got[0].negation_flips) == (1, 1, 1) and got[1].drift_flags == ["원문이 비어 있음"]


def test_columns_of_the_input_survive_or_give_way(spark):
    df = spark.createDataFrame([("모두 5명.", "모두 5명.", REF, 1, 2, 3, 0.4)], "source_text string, easy_text string, ref_date date, easy int, slots int, gate_source int, confidence double")
    out = gate.verified(df.union(df))
    row = out.first()
    assert (row.easy, row.gate_source, len(row.slots), row.verdict) == (1, 3, 1, "human_review") and out.count() == 2
    assert gate.verified(df.where("false")).count() == 0
    cases = distort.distorted(df.withColumn("case", F.lit(7)), seed=4)
    assert {(r.case, r.case_id) for r in cases.collect()} == {(7, "4-clean"), (7, "4-hallucinated_entity")}
    scored = rules.scored(spark.createDataFrame([(None, None, 9)], "text string, tokens array<struct<form:string,tag:string>>, score int")).first()
    assert scored.direct_address == 70 and scored.score > 90
    found = audit.secrets(spark.createDataFrame([("AKIA" + "A" * 16, 1, 2), (None, 1, 2)], "text string, label int, n int")).collect()
    assert [(r.label, r.n, r.kind) for r in found] == [("aws-access-key", 2, "secret")]


def test_long_texts_take_time_in_proportion(spark):
    parts = [" " * 100_000, "가" * 100_000, "1" * 10_000, "1," * 10_000, "일" * 100_000, "지" * 100_000, "가 " * 50_000, ", " * 50_000]
    df = spark.createDataFrame([(i, p, "글", REF) for i, p in enumerate(parts)], PAIR)
    assert gate.verified(df).count() == len(parts)


@pytest.mark.parametrize("given,value", [("９２만원", "920000"), ("0007", "7"), ("99999999999999999천", "99999999999999999000"), ("1" * 60, "1" * 60), ("구" + "천" * 3, "11000"), ("３천", "3000"), ("천자", None), ("원", None)])
def test_amounts_of_any_size(spark, given, value):
    assert spark.range(1).select(normalize.amount(F.lit(given)).alias("v")).first().v == value


def test_blocks_keep_every_character(spark):
    odd = "가나다 a"
    rows = spark.createDataFrame([(f"# {odd}\n{odd}\n- {odd}", 1), ("﻿﻿ \n", 2)], "text string, blocks int")
    got = segment.parsed(rows).collect()
    assert [b.text for b in got[0].blocks] == [odd, odd, f"- {odd}"] and got[1].parse_error


def test_pictures(spark):
    df = spark.createDataFrame([("돈과 세금",), (None,)], "text string")
    got = [[p.glyph_id for p in r.pictograms] for r in pictograms.with_pictograms(df).collect()]
    assert got == [["openmoji/money.svg", "openmoji/tax.svg"], []]
    where = spark.createDataFrame([("a.svg",), ("http://x/a.svg",), (" DATA:image/png;base64,A",)], "g string").select(pictograms.source_of(F.col("g")).alias("s"))
    assert [r.s for r in where.collect()] == ["assets/pictograms/a.svg", "http://x/a.svg", None]


def test_pages_show_nothing_for_nulls(spark):
    none = F.lit(None).cast("string")
    made = html.page(none, none, F.lit(None).cast("double"), none, F.lit(None).cast(rules.VIOLATION), F.lit(None).cast(pictograms.REF), "plain")
    page = spark.range(1).select(made.alias("h")).first().h
    assert html.NO_VIOLATIONS in page and "보통 읽기" in page and '<p class="score"></p>' in page


def test_revision_keeps_documents_without_an_answer(spark):
    docs = spark.createDataFrame([(1, "모두 5명.", REF), (2, "모두 6명.", REF), (3, "모두 7명.", REF)], "k int, source_text string, ref_date date")
    answers = spark.createDataFrame([(1, 0, "모두 5명."), (3, 0, "모두 8명.")], "k int, attempt int, response string")
    got = {r.k: (r.verdict, r.revisions) for r in revision.revised(docs, answers, gate.verified, "k").collect()}
    assert got == {1: ("pass", 0), 2: ("human_review", 0), 3: ("human_review", 1)}


def test_revision_by_a_provider(spark):
    docs = spark.createDataFrame([(1, "모두 5명.", REF), (2, "모두 6명.", REF)], "k int, source_text string, ref_date date")
    script = lambda: revision.Scripted([("'6명'", "모두 6명이에요."), ("5명", "모두 5명이에요."), ("6명", "모두 60명이에요.")])
    score = lambda df: rules.scored(df.withColumn("tokens", F.array().cast(rules.TOKENS)), "easy_text")
    got = {r.k: (r.verdict, r.revisions, r.easy_text) for r in revision.revised(docs, revision.answers_by(script, "k"), gate.verified, "k", score=score).collect()}
    assert got == {1: ("pass", 0, "모두 5명이에요."), 2: ("pass", 1, "모두 6명이에요.")}
    with pytest.raises(LookupError):
        revision.Scripted([]).generate("x")


def test_whole_annotations(spark):
    tokens = [("사람", "NNG"), ("오", "VV")]
    df = spark.createDataFrame([("모두 5명까지 납부", "모두 6명", REF, tokens, tokens)], f"source_text string, easy_text string, ref_date date, source_tokens {rules.TOKENS}, easy_tokens {rules.TOKENS}")
    r = annotation.corpus_rows(df).first()
    assert (r.numbers, r.distortions, r.slot_types, r.pictogram_refs, r.delta) == (False, ["numbers"], ["numeric"], [], 0.0) and "direct_address:(없음)" in r.ker_rule_violations


def test_tokens_by_a_tokenizer(spark):
    df = rules.tokenized(spark.createDataFrame([("가 나",), (None,)], "text string"), lambda t: [(w, "NNG") for w in t.split()])
    assert [[t.form for t in r.tokens] for r in df.collect()] == [["가", "나"], []]


def test_trees_with_pictures_and_other_codes(spark, tmp_path):
    root = tmp_path / "it's"
    (root / "assets").mkdir(parents=True)
    (root / "a.png").write_bytes(b"\x89PNG\xff\xfe")
    (root / "b.txt").write_bytes("비밀 password = 'abcdefghijklmnop1'".encode("cp949"))
    (root / "assets" / "c.svg").write_text("<svg/>")
    (root / "d.md").write_text("x data:image/png;base64,AAAA")
    tree = trees.read_tree(spark, str(root))
    assert {r.path: r.content is None for r in tree.collect()} == {"a.png": True, "b.txt": False, "assets/c.svg": False, "d.md": False}
    assert [r.path for r in audit.picture_leaks(tree).collect()] == ["a.png", "d.md"]
    assert "generic-secret-assign in b.txt" in {r.detail for r in audit.audit(spark.createDataFrame([], "Name string, Version string, License string"), tree).collect()}
    assert cli.main(["audit", "--root", str(root)]) == 1


def test_sections_in_their_order_and_word_lists(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for i in (10, 2, 0):
            z.writestr(f"Contents/section{i}.xml", f'<s xmlns:hp="h"><hp:p><hp:t>{i}</hp:t></hp:p></s>')
    assert documents.hwpx_text(held.getvalue()) == "0\n2\n10"
    (tmp_path / "w.txt").write_text("# 목록\n　가 \n가\n\n나\t\n", encoding="utf-8")
    assert sorted(r.term for r in documents.read_words(spark, str(tmp_path / "w.txt")).collect()) == ["가", "나"]


def test_notes_of_licences(spark):
    df = spark.createDataFrame([("pip", None), ("a", "MIT"), ("b", "GPL"), ("c", None)], "n string, l string")
    assert [r.x for r in df.select(audit.licence_note(F.col("n"), F.col("l")).alias("x")).collect()] == ["MIT (known)", "allowed", "forbidden-license", "unrecognized-license"]


def test_strings(spark):
    row = spark.range(1).select(text.stripped(F.lit("　\t가 나 \n")).alias("s"), text.ascii_digits(F.lit("７٣x9")).alias("d"), text.matches(F.lit("a1bb22a1"), "[ab]+\\d").alias("m")).first()
    assert (row.s, row.d, [(m.at, m.span) for m in row.m]) == ("가 나", "73x9", [(0, "a1"), (2, "bb2"), (6, "a1")])


def test_days_far_ahead(spark):
    day = datetime.date(2026, 7, 1)
    spans = ["0000007일 후", "2912000일 이내", "9999999일 후", "99999999999999999999일 후", "D-10"]
    got = [r.x for r in spark.createDataFrame([(s, day) for s in spans], "s string, d date").select(normalize.date_iso(F.col("s"), F.col("d")).alias("x")).collect()]
    assert got == ["2026-07-08", str(day + datetime.timedelta(days=2912000)), None, None, "2026-07-11"]


def test_a_loop_needs_no_more_than_verdicts(spark):
    """A gate that gives the verdict alone is enough where answers are there already."""
    from factloom import queries
    from factloom.operators import gate as whole

    docs = spark.createDataFrame([(i, "회비 30,000원을 냅니다.", REF) for i in range(3)], "k int, source_text string, ref_date date")
    answers = spark.createDataFrame([(0, 0, "30,000원"), (1, 0, "3원"), (1, 1, "30,000원"), (2, 0, "1원"), (2, 1, "2원"), (2, 2, "3원"), (2, 3, "4원")], "k int, attempt int, response string")
    got = {r.k: (r.verdict, r.revisions) for r in revision.revised(docs, answers, whole.verdicts, "k").collect()}
    assert got == {0: ("pass", 0), 1: ("pass", 1), 2: ("human_review", 3)}
    orders = queries._answers(spark, "/root/testdata/sf0.001")
    assert "Join" not in orders._jdf.queryExecution().optimizedPlan().toString() and orders.groupBy("o_orderkey").count().where("count <> 4").count() == 0
