"""Readability rules on given tokens, segmentation, pictograms, audits."""

from pyspark.sql import functions as F

from factloom.operators import audit, pictograms, rules, segment

SCHEMA = "text string, tokens array<struct<form:string,tag:string>>"


def score(spark, text, tokens):
    return rules.scored(spark.createDataFrame([(text, tokens)], SCHEMA)).first()


def test_one_passive_of_four_verbs(spark):
    r = score(spark, "처리됩니다.", [("처리", "NNG"), ("되", "XSV"), ("하", "VV"), ("보", "VV"), ("크", "VA")])
    assert round(r.passive_ratio, 6) == 62.5
    assert [v.span for v in r.violations if v.rule == "passive_ratio"] == ["처리"]


def test_no_tokens(spark):
    r = score(spark, "", [])
    assert (r.hard_word_ratio, r.passive_ratio, r.modifier_ttr, r.direct_address, r.sentence_length) == (100, 100, 80, 70, 100)
    assert r.level_estimate == 1


def test_terms_are_explained_from_their_gloss_on(spark):
    tokens = [("납부", "NNG"), ("납부", "NNG"), ("집", "NNG"), ("집", "NNG")]
    assert score(spark, "납부(돈을 냄) 뒤 납부", tokens).undefined_hard_term == 100
    before = score(spark, "납부 뒤 납부(돈을 냄)", tokens)
    assert round(before.undefined_hard_term, 6) == round(100 * (1 - 0.25 / 0.3), 6)


def test_numbers_abbreviations_percent(spark):
    r = score(spark, "KTX 5% 할인, 300,000원. ABC, KT는", [])
    assert r.abbrev_percent_bignum == 60
    assert [v.span for v in r.violations if v.rule == "abbrev_percent_bignum"] == ["KTX", "ABC", "5%", "300,000"]


def test_blocks(spark):
    text = "﻿# 안내\n\n첫 줄\n둘째 줄  \n\n## 준비\n- 하나\n* 둘\n3. 셋\n\n전화 주세요"
    df = spark.createDataFrame([(text,), ("  \n ",), ("﻿",), (None,)], "text string")
    got = segment.parsed(df).collect()
    assert [(b.type, b.level, b.text) for b in got[0].blocks] == [("heading", 1, "안내"), ("paragraph", 0, "첫 줄\n둘째 줄"), ("heading", 2, "준비"), ("list_item", 0, "- 하나"), ("list_item", 0, "* 둘"), ("list_item", 0, "3. 셋"), ("paragraph", 0, "전화 주세요")]
    assert [r.parse_error for r in got] == [None, "empty document", "empty document", "empty document"]


def test_pictograms(spark):
    df = spark.createDataFrame([("계약 후 약국 말고 약을 금액과 돈으로",), ("요약과 예약",), (None,)], "t string")
    got = [[(p.concept, p.glyph_id) for p in r.p] for r in df.select(pictograms.matched(F.col("t")).alias("p")).collect()]
    assert got == [[("약", "mulberry/medicine.svg"), ("금액", "openmoji/money.svg")], [], []]


def test_licences_and_secrets(spark):
    rows = [("a", "MIT"), ("b", "GPL v3"), ("pip", "UNKNOWN"), ("c", None), ("d", "LGPL")]
    got = [r.f for r in spark.createDataFrame(rows, "n string, l string").select(audit.licence_finding(F.col("n"), F.col("l")).alias("f")).collect()]
    assert got == [None, "forbidden-license", None, "unrecognized-license", None]
    files = spark.createDataFrame([("src/a.py", "k = 'x'\npassword = 'abcdefghijklmnop1'"), ("tests/a.py", "password = 'abcdefghijklmnop1'"), ("b.txt", "900101-1234567"), ("corpus/x.png", ""), ("assets/pictograms/mulberry/LICENSE", "CC"), ("assets/a.svg", "<svg onload=x>")], "path string, content string")
    found = {(r.kind, r.detail) for r in audit.audit(spark.createDataFrame([("b", "1", "GPL")], "Name string, Version string, License string"), files).collect()}
    assert found == {("forbidden-license", "b 1 [GPL]"), ("secret", "generic-secret-assign in src/a.py"), ("pii", "korean-rrn in b.txt"), ("asset-in-code", "corpus/x.png"), ("active-svg", "assets/a.svg")}


def test_a_rule_finds_what_it_needs_once(spark):
    """Nouns, hits and shares are found once a rule, however often score and violations use them."""
    df = spark.createDataFrame([("사람이 KTX를 탑니다.", [("사람", "NNG"), ("KTX", "SL"), ("漢字", "NNG"), ("그", "NP"), (None, "NNG"), ("안", None)])], SCHEMA)
    once = rules.RULES["hard_word_ratio"](F.col("text"), F.col("tokens"))
    plan = df.select(once.alias("r"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("NNG") <= 2, plan  # the nouns of the text, and those that are hard
    r = rules.scored(df).first()
    assert (r.hanja_loanword_ratio, r.third_person_fictional, r.direct_address, r.hard_word_ratio) == (50.0, 85.0, 70.0, 0.0) and round(r.negation_ratio, 6) == round(100 * (1 - 0.5 / 1.5), 6)
    alone = rules.scored(df, only=rules.RULES).first()
    assert all(alone[k] == r[k] for k in rules.RULES)
