"""Readability rules over (text, tokens): each a column expression (a struct of score and violations, in which what both need is found once); the mean of the sub-scores is the score.

tokens: array of struct form, tag (tags of a Korean morphological analyser), in the order of the text; tokenized() adds them by any tokenizer.

Null texts count as empty ones, null tokens as none: a rule without anything to judge gives its best score, but for direct_address (70) and modifier_ttr (80).
Rows are scored one by one, repeated ones too; an empty table gives an empty result. Columns of the input that are called like a result (the rules, violations, score,
level_estimate) give way to it. Ties do not arise: violations come in the order of the rules, spans in the order of the text, idioms in the order of their list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import bound, computed, found, free_name, linear, quoted, sentences, stripped
from factloom.lexicons import EASY_WORDS, HARD_TERMS, IDIOMS
from factloom.operators import patterns
from factloom.sources.shared import few, written

# Tags, forms and thresholds that results depend on.
NOUNS = ("NNG", "NNP", "NNB", "NR", "NP")
VERBS = ("VV", "VA", "XSV")
PASSIVE_FORMS, PASSIVE_TAGS = ("되", "지", "받", "당하"), ("XSV", "VV", "VX")
NEGATIVE_FORMS = ("안", "못", "없", "않", "말", "아니", "아니하", "불가", "금지", "제외")
CJK = "[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff\u2e80-\u2eff\u2f00-\u2fdf]"
LETTERS = f"[A-Za-z{CJK[1:]}"
ABBREVIATION = r"(?<![\p{L}\p{N}_])[A-Z]{2,}(?![\p{L}\p{N}_])"
PERCENT, NUMBER, BIG_DIGITS = r"\d+\s*%", r"\d[\d,]*", 6

VIOLATION = "array<struct<rule:string,span:string,severity:string,suggestion:string>>"
TOKENS = "array<struct<form:string,tag:string>>"
# What to do about a violation, in our own words.
SUGGESTIONS = {
    "sentence_length": "문장을 둘로 나누세요.", "hard_word_ratio": "쉬운 낱말로 바꾸거나 뜻을 풀어 쓰세요.", "hanja_loanword_ratio": "한자어와 외래어를 우리말로 바꾸세요.",
    "predicates_connectives": "이어진 문장을 끊으세요.", "passive_ratio": "누가 하는지 드러나게 쓰세요.", "negation_ratio": "긍정하는 말로 바꾸세요.",
    "undefined_hard_term": "낱말 뒤에 괄호로 뜻을 쓰세요.", "idiom": "관용구를 뜻 그대로 쓰세요.", "abbrev_percent_bignum": "약어와 큰 수를 풀어 쓰세요.",
    "third_person_fictional": "사람을 이름이나 '여러분'으로 부르세요.", "direct_address": "읽는 사람을 불러 주세요.", "modifier_ttr": "꾸미는 말을 줄이세요.",
}


def _violation(rule: str, span: Column, severity: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), span.alias("span"), severity.alias("severity"), F.lit(SUGGESTIONS[rule]).alias("suggestion"))


def _v(rule: str, span: Column, severity: str | Column, when: Column) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    one = F.array(_violation(rule, span, sev)).cast(VIOLATION)
    return F.when(F.coalesce(when, F.lit(False)), one).otherwise(F.array().cast(VIOLATION))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _sample(tokens: Column, n: int) -> Column:
    return F.array_join(F.transform(F.slice(tokens, 1, n), lambda t: t["form"]), ", ")


def _ratio(a: Column, b: Column) -> Column:
    return F.size(a).cast("double") / F.size(b)


def _nouns(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t["tag"].isin(*NOUNS))


def _with_form(tokens: Column, forms: tuple[str, ...], which: Callable[[Column], Column]) -> Column:
    """Tokens of some forms that are as they should be; they are gone through only if one has such a form."""
    some = F.arrays_overlap(tokens["form"], F.array(*map(F.lit, forms)))
    return F.when(some, F.filter(tokens, lambda t: t["form"].isin(*forms) & which(t))).otherwise(F.array().cast(TOKENS))


def _any(t: Column) -> Column:
    return F.lit(True)


def _n_nouns(tokens: Column) -> Column:
    return F.size(_nouns(tokens))


def _base_tag(t: Column) -> Column:
    return F.substring_index(t["tag"], "-", 1)


def _n_sentences(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(sentences(text)))


@dataclass
class Listed:
    """What word lists say of a text: nouns that are not easy, nouns that are hard terms or written in Chinese or Latin letters, tokens that are hard terms, and idioms."""

    hard: Column
    foreign: Column
    terms: Column
    idioms: Column


def _foreign(form: Column) -> Column:
    return form.rlike(LETTERS)


def own_lists(text: Column, tokens: Column) -> Listed:
    """By the short lists of this package."""
    noun, hard = (lambda t: t["tag"].isin(*NOUNS)), lambda t: t["form"].isin(*HARD_TERMS)
    # letters are looked for in all forms at once, before they are in each
    letters = F.array_join(tokens["form"], "\n").rlike(LETTERS)
    foreign = F.when(letters, F.filter(tokens, lambda t: noun(t) & (hard(t) | _foreign(t["form"])))).otherwise(_with_form(tokens, HARD_TERMS, noun))
    return Listed(F.filter(tokens, lambda t: noun(t) & ~t["form"].isin(*EASY_WORDS)), foreign, _with_form(tokens, HARD_TERMS, _any), F.filter(F.array(*map(F.lit, IDIOMS)), lambda i: F.contains(text, i)))


def at_places(tokens: Column, easy: Column, hard: Column, idioms: Column) -> Listed:
    """By the places (from 0) of tokens that stand in lists: arrays are matched as sets, in time that grows with the tokens."""
    every = F.filter(F.sequence(F.lit(0), F.size(tokens)), lambda p: p < F.size(tokens))
    of = lambda places: F.transform(places, lambda p: F.get(tokens, p))
    foreign = F.filter(every, lambda p: _foreign(F.get(tokens, p)["form"]))
    return Listed(_nouns(of(F.array_except(every, easy))), _nouns(of(F.array_sort(F.array_union(hard, foreign)))), of(F.array_sort(hard)), idioms)


def sentence_tokens(text: Column, tokens: Column) -> Column:
    """Tokens of each sentence, shared by its characters, rounded half to even; the last takes the rest."""
    return F.transform(_shared(text, tokens), lambda x: x["c"])


def _shared(text: Column, tokens: Column) -> Column:
    """Sentences s (the whole text, if it has none) with the tokens c of each."""
    n = F.size(tokens)

    def counts(parts: Column) -> Column:
        chars = _sum(F.transform(parts, lambda s: F.length(s).cast("double")))
        shares = bound(chars, lambda all_: F.transform(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)), lambda s: F.bround(n * F.length(s) / all_, 0).cast("int")))
        return bound(shares, lambda x: F.concat(x, F.array(n - F.aggregate(x, F.lit(0), lambda a, y: a + y))))

    whole = lambda parts: F.when(F.size(parts) == 0, F.array(stripped(text))).otherwise(parts)
    return bound(sentences(text), lambda parts: F.zip_with(whole(parts), F.when(F.size(parts) == 0, F.array(n)).otherwise(counts(parts)), lambda s, c: F.struct(s.alias("s"), c.alias("c"))))


def _rule(score: Column, violations: Column) -> Column:
    """What a rule says of a text: its sub-score and violations, found together."""
    return F.struct(score.cast("double").alias("score"), violations.cast(VIOLATION).alias("violations"))


def sentence_length(text: Column, tokens: Column) -> Column:
    def of(shared: Column) -> Column:
        score = _sum(F.transform(shared, lambda x: linear(x["c"].cast("double"), 15.0, 40.0))) / F.size(shared)
        long = F.filter(F.transform(shared, lambda x: _violation("sentence_length", F.substring(x["s"], 1, 60), F.when(x["c"] >= 40, "high").when(x["c"] > 15, "med"))), lambda v: v["severity"].isNotNull())
        return _rule(score, long)

    return bound(_shared(text, tokens), of)


def _by_share(rule: str, least: float, part: Column, nouns: Column) -> Column:
    """By the share of some nouns among all."""

    def of(some: Column) -> Column:
        r = bound(nouns, lambda all_: F.when(all_ > 0, F.size(some).cast("double") / all_))
        return bound(r, lambda x: _rule(F.when(x.isNull(), 100.0).otherwise(F.greatest(F.lit(0.0), 100 - x * 200)), _v(rule, _sample(some, 5), "med", x >= least)))

    return bound(part, of)


def hard_word_ratio(text: Column, tokens: Column, listed: Listed | None = None) -> Column:
    return _by_share("hard_word_ratio", 0.3, (listed or own_lists(text, tokens)).hard, _n_nouns(tokens))


def hanja_loanword_ratio(text: Column, tokens: Column, listed: Listed | None = None) -> Column:
    return _by_share("hanja_loanword_ratio", 0.4, (listed or own_lists(text, tokens)).foreign, _n_nouns(tokens))


def predicates_connectives(text: Column, tokens: Column) -> Column:
    r = F.size(F.filter(tokens, lambda t: t["tag"] == "EC")).cast("double") / _n_sentences(text)
    return bound(r, lambda x: _rule(linear(x, 1.0, 4.0), _v("predicates_connectives", F.substring(text, 1, 60), "med", x > 1)))


def passive_ratio(text: Column, tokens: Column) -> Column:
    tagged = lambda t: _base_tag(t).isin(*PASSIVE_TAGS)
    is_passive = lambda t: t["form"].isin(*PASSIVE_FORMS) & tagged(t)
    verbs, hits = F.size(F.filter(tokens, lambda t: _base_tag(t).isin(*VERBS))), _with_form(tokens, PASSIVE_FORMS, tagged)
    before = F.filter(F.transform(tokens, lambda t, i: F.when(is_passive(t) & (i > 0), F.get(tokens, i - 1))), lambda t: t.isNotNull() & t["tag"].isin(*NOUNS))

    def of(x: Column) -> Column:
        r = F.when(x["n"] > 0, F.size(x["hits"]).cast("double") / x["n"])
        span = bound(before, lambda b: F.when(F.size(b) > 0, _sample(b, 3)).otherwise(F.get(x["hits"], F.lit(0))["form"]))
        return bound(r, lambda y: _rule(F.coalesce(linear(y, 0.1, 0.5), F.lit(100.0)), _v("passive_ratio", span, "med", y.isNotNull() & (F.size(x["hits"]) > 0))))

    return bound(F.struct(verbs.alias("n"), hits.alias("hits")), of)


def negation_ratio(text: Column, tokens: Column) -> Column:
    hits = _with_form(tokens, NEGATIVE_FORMS, _any)
    return bound(hits, lambda x: _rule(linear(F.size(x).cast("double") / _n_sentences(text), 0.5, 2.0), _v("negation_ratio", _sample(x, 3), "med", F.size(x) > 0)))


def undefined_hard_term(text: Column, tokens: Column, listed: Listed | None = None) -> Column:
    """The k-th token of a term stands at the term's k-th place in the text; from its first gloss, `term (`, on it is explained."""

    def open_term(t: Column) -> Column:
        term = quoted(t["form"])
        gloss = F.regexp_instr(text, F.concat(term, F.lit(r"(?U:\s*)\(")))
        pieces = F.slice(F.split(text, term, -1), F.lit(1), t["k"])
        # the k-th place comes after k pieces and k - 1 terms
        place = F.aggregate(pieces, F.lit(0), lambda a, p: a + F.length(p)) + (t["k"] - 1) * F.length(t["form"]) + 1
        exists = F.size(F.split(text, term, -1)) > t["k"]
        return ~(exists & (gloss > 0) & (place >= gloss))

    def of(hard: Column) -> Column:
        turn = F.transform(hard, lambda t, i: F.struct(t["form"].alias("form"), F.size(F.filter(F.slice(hard, F.lit(1), i + 1), lambda u: u["form"] == t["form"])).alias("k")))
        share = lambda hits: F.size(hits).cast("double") / F.greatest(F.lit(1), _n_nouns(tokens))
        return bound(F.filter(turn, open_term), lambda hits: _rule(linear(share(hits), 0.0, 0.3), _v("undefined_hard_term", _sample(hits, 5), "high", F.size(hits) > 0)))

    return bound((listed or own_lists(text, tokens)).terms, of)


def idiom(text: Column, tokens: Column, listed: Listed | None = None) -> Column:
    """Idioms in the order of the list."""
    each = lambda hits: F.transform(F.slice(hits, 1, 5), lambda h: _violation("idiom", h, F.lit("med")))
    return bound((listed or own_lists(text, tokens)).idioms, lambda hits: _rule(F.greatest(F.lit(0.0), 100 - F.size(hits) * 20.0), each(hits)))


def abbreviations_and_numbers(text: Column) -> Column:
    """Abbreviations, percentages and numbers of six digits or more, in this order."""
    big = F.filter(found(text, NUMBER), lambda x: F.length(F.replace(x, F.lit(","), F.lit(""))) >= BIG_DIGITS)
    return F.concat(found(text, ABBREVIATION), found(text, PERCENT), big)


def abbrev_percent_bignum(text: Column, tokens: Column) -> Column:
    each = lambda hits: F.transform(F.slice(hits, 1, 5), lambda h: _violation("abbrev_percent_bignum", h, F.lit("med")))
    return bound(abbreviations_and_numbers(text), lambda hits: _rule(F.greatest(F.lit(0.0), 100 - F.size(hits) * 10.0), each(hits)))


def third_person_fictional(text: Column, tokens: Column) -> Column:
    hits = _with_form(tokens, ("그", "그녀"), lambda t: t["tag"].isin("NP", "NNG"))
    return bound(hits, lambda x: _rule(F.greatest(F.lit(40.0), 100 - F.least(F.size(x) * 15.0, F.lit(60.0))), _v("third_person_fictional", _sample(x, 3), "low", F.size(x) > 0)))


def direct_address(text: Column, tokens: Column) -> Column:
    hits = F.size(_with_form(tokens, ("당신", "여러분", "우리"), _any))
    return bound(hits, lambda x: _rule(70 + F.least(x * 10.0, F.lit(30.0)), _v("direct_address", F.lit("(없음)"), "low", x == 0)))


def modifier_ttr(text: Column, tokens: Column) -> Column:
    forms = F.transform(F.filter(tokens, lambda t: t["tag"].isin("MM", "MAG")), lambda t: t["form"])
    ttr = bound(forms, lambda x: F.when(F.size(x) > 0, _ratio(F.array_distinct(x), x)))
    score = lambda x: F.when(x <= 0.4, 100.0).when(x >= 0.9, 40.0).when(x.isNotNull(), 100 - (x - 0.4) / 0.5 * 60).otherwise(80.0)
    return bound(ttr, lambda x: _rule(score(x), _v("modifier_ttr", F.substring(text, 1, 60), "low", x > 0.7)))


BY_LISTS = ("hard_word_ratio", "hanja_loanword_ratio", "undefined_hard_term", "idiom")
RULES: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (sentence_length, hard_word_ratio, hanja_loanword_ratio, predicates_connectives, passive_ratio, negation_ratio, undefined_hard_term, idiom, abbrev_percent_bignum, third_person_fictional, direct_address, modifier_ttr)
}


MOST_BROADCAST = 200_000  # words that all texts have in common with the lists


def with_lists(docs: DataFrame, text_col: str, tokens_col: str, easy: DataFrame, hard: DataFrame, idioms: DataFrame, names: dict[str, str]) -> DataFrame:
    """docs with three arrays, called names["easy"], ["hard"] and ["idioms"]: places of tokens in the list easy, in hard, and the idioms in the text, in order. Lists have a column term, and
    idioms may have ord (else they are in the order of their characters).

    The words that texts and lists have in common are found first, from forms that are combined before they are shuffled; if they are few, they go to all tasks, else the places of each form of a text
    meet them by a merge join, of which Spark splits what very many texts share. Only places of listed tokens are gathered by text again."""
    row = free_name("row", docs.columns)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "scored-rows")
    forms = rows.select(F.explode(F.transform(tokens_col, lambda t: t["form"])).alias("form"))
    places = rows.select(row, F.posexplode(F.transform(tokens_col, lambda t: t["form"])).alias("place", "form"))
    lists = easy.select(F.col("term").alias("form"), F.lit(True).alias("is_easy"), F.lit(False).alias("is_hard")).unionByName(hard.select(F.col("term").alias("form"), F.lit(False).alias("is_easy"), F.lit(True).alias("is_hard")))
    lists = lists.groupBy("form").agg(F.max("is_easy").alias("is_easy"), F.max("is_hard").alias("is_hard"))
    common = written(lists.join(forms.select("form").distinct(), "form"), "scored-words")
    if few(common, MOST_BROADCAST):
        met = places.join(F.broadcast(common), "form").withColumn("places", F.array("place"))
    else:
        met = places.groupBy(row, "form").agg(F.collect_list("place").alias("places")).join(common.hint("merge"), "form")
    in_list = lambda c: F.flatten(F.collect_list(F.when(F.col(c), F.col("places"))))
    words = met.groupBy(row).agg(in_list("is_easy").alias(names["easy"]), in_list("is_hard").alias(names["hard"]))
    turn = (F.col("ord") if "ord" in idioms.columns else F.lit(0)).alias("ord")
    listed = idioms.select(F.col("term").alias("pattern"), turn).groupBy("pattern").agg(F.min("ord").alias("ord"))
    hits = patterns.occurrences(rows.select(row, F.col(text_col).alias("text")), listed).select(row, "pattern").distinct()
    hits = hits.join(listed, "pattern").groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "pattern"))), lambda x: x["pattern"]).alias(names["idioms"]))
    out = rows.join(words, row, "left").join(hits, row, "left")
    kinds = {"easy": "array<int>", "hard": "array<int>", "idioms": "array<string>"}
    return out.select(*docs.columns, *(F.coalesce(F.col(names[k]), F.array().cast(v)).alias(names[k]) for k, v in kinds.items()))


def scored(docs: DataFrame, text_col: str = "text", tokens_col: str = "tokens", easy: DataFrame | None = None, hard: DataFrame | None = None, idioms: DataFrame | None = None, only: Iterable[str] | None = None) -> DataFrame:
    """Adds a column per rule, score (their mean), level_estimate (1 from 80, 2 from 60, else 3) and violations (rule, span, severity, suggestion).

    easy, hard, idioms: tables of words of any size (column term), for the short lists of this package; what is not given stays as it is there.
    only: rules whose sub-scores are wanted; their columns alone are added, and no other rule is tried."""
    lists = {"easy": easy, "hard": hard, "idioms": idioms}
    given = any(x is not None for x in lists.values())
    names = {k: free_name(f"rules_{k}", docs.columns) for k in lists}
    results = (*RULES, "violations", "score", "level_estimate")
    kept = [c for c in docs.columns if c.lower() not in results]
    text, tokens, result = (free_name(c, docs.columns) for c in ("rules_text", "rules_tokens", "rules_result"))
    if given:
        own = {"easy": EASY_WORDS, "hard": HARD_TERMS, "idioms": IDIOMS}
        table = lambda k: docs.sparkSession.createDataFrame([(w, i) for i, w in enumerate(own[k])], "term string, ord int") if lists[k] is None else lists[k]
        docs = with_lists(docs, text_col, tokens_col, *(table(k) for k in lists), names)
    out = computed(docs, {text: F.coalesce(F.col(text_col).cast("string"), F.lit("")), tokens: F.coalesce(F.col(tokens_col), F.array().cast(TOKENS))})
    t, k = F.col(text), F.col(tokens)
    listed = own_lists(t, k)
    if given:
        found = at_places(k, *(F.col(names[x]) for x in ("easy", "hard", "idioms")))
        words = free_name("rules_listed", out.columns)
        out = computed(out, {words: F.struct(*(v.alias(x) for x, v in vars(found).items()))})
        listed = Listed(*(F.col(words)[x] for x in vars(found)))
    wanted = set(RULES if only is None else only)
    made = {name: rule(t, k, listed) if name in BY_LISTS else rule(t, k) for name, rule in RULES.items() if name in wanted}
    if only is not None:
        return out.select(*kept, *(v["score"].alias(c) for c, v in made.items()))
    out = computed(out, {result: F.struct(*(v.alias(k) for k, v in made.items()))})
    score = sum((F.col(result)[k]["score"] for k in made), F.lit(0.0)) / len(made)
    violations = F.concat(*(F.col(result)[k]["violations"] for k in made))
    out = out.select(*kept, *(F.col(result)[k]["score"].alias(k) for k in made), violations.alias("violations"), score.alias("score"))
    return out.withColumn("level_estimate", F.when(F.col("score") >= 80, 1).when(F.col("score") >= 60, 2).otherwise(3))


def tokenized(docs: DataFrame, tokenize: Callable[[str], list[tuple[str, str]]], text_col: str = "text", tokens_col: str = "tokens") -> DataFrame:
    """Adds tokens by a morphological analyser: tokenize gives form and tag of each token of a text and is made ready once in each worker, if it keeps state. Null texts have none."""

    @F.pandas_udf(TOKENS)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: [{"form": f, "tag": g} for f, g in tokenize(t)] if t else [])

    return docs.withColumn(tokens_col, of(F.col(text_col)))


def evaluation(pairs: DataFrame) -> DataFrame:
    """pairs: score_before, score_after, violations_before, violations_after. One row of means, 0 without pairs."""
    mean = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    b, a = F.col("score_before"), F.col("score_after")
    return pairs.agg(F.count("*").alias("n_pairs"), mean(b).alias("mean_before"), mean(a).alias("mean_after"), mean(a - b).alias("mean_delta"), mean(F.col("violations_before") - F.col("violations_after")).alias("mean_violation_reduction"))
