"""Word lists as tables: the same as lists that are written down."""

import random

from factloom import lexicons
from factloom.operators import patterns, rules

SCHEMA = "key long, text string, tokens array<struct<form:string,tag:string>>, easy string, row string, form string"


def rows():
    rng = random.Random(4)
    words = [*lexicons.EASY_WORDS, *lexicons.HARD_TERMS, "漢字", "KTX", "나무꾼", "안", "그"]
    out = []
    for i in range(60):
        forms = rng.choices(words, k=rng.randint(0, 40))
        text = " ".join(w + (" (뜻)" if rng.random() < 0.1 else "") + (". " if rng.random() < 0.2 else "") for w in forms) + " ".join(rng.choices(("", " 발이 넓다", "그림의 떡"), k=2))
        out.append((i, text, [(w, rng.choice(("NNG", "NNP", "VV", "MAG", "NP"))) for w in forms], "e", "r", "f"))
    return [*out, out[3], (None, None, None, "e", "r", "f"), (98, "", [], "e", "r", "f"), (99, "발이 넓다", None, "e", "r", "f")]


def listed(spark, words, order=True):
    return spark.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, ord int") if order else spark.createDataFrame([(w,) for w in words], "term string")


def as_rows(df):
    return sorted((str(r.asDict(recursive=True)) for r in df.collect()))


def test_tables_equal_literals(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    want = rules.scored(docs)
    given = {"easy": listed(spark, [*lexicons.EASY_WORDS, "사람", None]), "hard": listed(spark, lexicons.HARD_TERMS), "idioms": listed(spark, lexicons.IDIOMS)}
    got = rules.scored(docs, **given)
    assert got.columns == want.columns and as_rows(got) == as_rows(want)
    assert as_rows(rules.scored(docs, easy=given["easy"])) == as_rows(want)
    # without a broadcast
    monkeypatch.setattr(rules, "MOST_BROADCAST", 0)
    assert as_rows(rules.scored(docs, **given)) == as_rows(want)


def test_other_lists_and_empty_ones(spark):
    docs = spark.createDataFrame([(1, "가 나 다", [("가", "NNG"), ("나", "NNG"), ("다", "NNG")])], "key long, text string, tokens array<struct<form:string,tag:string>>")
    none = spark.createDataFrame([], "term string")
    r = rules.scored(docs, easy=none, hard=none, idioms=none).first()
    assert (r.hard_word_ratio, r.hanja_loanword_ratio, r.idiom) == (0.0, 100.0, 100.0)
    r = rules.scored(docs, easy=listed(spark, ["가", "나"]), hard=listed(spark, ["나"]), idioms=listed(spark, ["나 다", "가 나"], order=False)).first()
    assert round(r.hard_word_ratio, 6) == round(100 - 200 / 3, 6) and round(r.hanja_loanword_ratio, 6) == round(100 - 200 / 3, 6)
    assert [v.span for v in r.violations if v.rule == "idiom"] == ["가 나", "나 다"]
    assert rules.scored(docs.where("false"), easy=none).count() == 0


def test_large_lists(spark):
    many = spark.range(150_000).selectExpr("concat('w', id) term")
    docs = spark.createDataFrame([(i, f"w{i} w{i + 150_000}", [(f"w{i}", "NNG"), (f"w{i + 150_000}", "NNG")]) for i in range(40)], "key long, text string, tokens array<struct<form:string,tag:string>>")
    got = rules.scored(docs, easy=many, idioms=many).select("key", "hard_word_ratio", "idiom").collect()
    assert all(r.hard_word_ratio == 0.0 for r in got) and len(got) == 40
    # each text holds its word and the shorter ones that it begins with; what the other word begins with counts too
    want = {i: len({f"w{n}"[:k] for n in (i, i + 150_000) for k in range(2, 8) if f"w{n}"[1:k] and int(f"w{n}"[1:k]) < 150_000 and str(int(f"w{n}"[1:k])) == f"w{n}"[1:k]}) for i in range(40)}
    assert {r.key: r.idiom for r in got} == {i: max(0.0, 100.0 - 20 * n) for i, n in want.items()}
    assert patterns.MOST_CHARS > 0


def test_wanted_rules_alone(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    only = ("idiom", "hard_word_ratio", "hanja_loanword_ratio")
    given = {"easy": listed(spark, lexicons.EASY_WORDS), "idioms": listed(spark, lexicons.IDIOMS)}
    want, got = rules.scored(docs, **given), rules.scored(docs, **given, only=only)
    assert set(got.columns) == {*docs.columns, *only} and as_rows(got.select("key", *only)) == as_rows(want.select("key", *only))
    assert "undefined_hard_term" not in got._jdf.queryExecution().optimizedPlan().toString()
