"""The fidelity gate: facts of a source, their survival in an easy text, flips of meaning, and a verdict.

Everything is one projection over rows of (source_text, easy_text, ref_date): facts are arrays of a row, so no row moves
between tasks, whatever the size of the table.

Null and blank sources have no facts and go to human review; a null or empty easy text keeps no fact. A null ref_date leaves relative
dates without a value, so they are no facts. Rows are judged one by one, repeated ones too; an empty table gives an empty result. Columns of the
input that are called like a result (see RESULTS) give way to it, all others pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import normalize as n
from factloom.functions.text import any_of, ascii_digits, bound, computed, found, free_name, matches, place, quoted, stripped

# Patterns and words that results depend on. Runs are entered at their first character only and never given up in part, which finds the same
# places in time that grows with the text. Lookaheads at the front name the characters that a match can begin with: most places are left at once; those before a choice of words name their first characters.
_NUMERALS = r"[일이삼사오육칠팔구십백천만억조\s]"
_DIGITS = r"(?=[\d,])(?<![\d,])[\d,]++\s*+원"
_AMOUNT = rf"{_DIGITS}|(?={_NUMERALS})(?<!{_NUMERALS}){_NUMERALS}++원"
MONEY = f"(?U)(?:{_AMOUNT})"
HEDGED_MONEY = rf"(?U)(?:약\s*)?(?:{_AMOUNT})"
# the same places in texts without WRITTEN, where no amount ends with a numeral or a blank
MONEY_IN_DIGITS = f"(?U){_DIGITS}"
HEDGED_IN_DIGITS = rf"(?U)(?=[약\d,])(?:약\s*)?{_DIGITS}"
WRITTEN = f"(?U)원(?<={_NUMERALS}원)"
DATE = r"(?U)(?=[\dD])(?:\d{4}\s*[년.\-/]\s*\d{1,2}\s*[월.\-/]\s*\d{1,2}\s*일?(?:\s*(?:전\s*)?까지)?|D\s*-\s*\d+|(?:\G|(?<!\d))\d+\s*일\s*(?:후|뒤|이내))"
CONTACT = r"(?U)\(?\d{2,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{4}"
SCOPE = r"(?U)(?=\d|(?<![^\s,])|\G)(?:\d{1,3}(?:,\d{3})++[^\s,]*\s*+|(?:\G|(?<![^\s,]))[^\s,]+\s*+|(?:\G|^|(?<=,))\s*+)(?=[이초미까부])(?:이상|초과|이하|미만|까지|부터)"
NEGATION = r"(?U)(?<![^\s,.])[^\s,.]*(?=[제불금아없지])(?:제외|불가|금지|아니|없|지\s*않)[^\s,.]*"
_OFFICES = "구청|시청|군청|도청|주민센터|행정복지센터|복지센터|복지관|보건소|공단|세무서|우체국|경찰서|소방서|교육청|지원센터|위원회|재단|협회"
_BUREAUS = "국세청|병무청|경찰청|검찰청|기상청|조달청|통계청|관세청|산림청|특허청|소방청"
# the last character is looked at before the words are
AGENCY = f"(?=[가-힣])(?:(?<![가-힣])[가-힣]*[관국단서소청터회](?<=[가-힣](?:{_OFFICES}))|[가-힣]{{2}}청(?<={_BUREAUS})|질병관리청|건강보험심사평가원)"
# a day's numbers are whole runs of digits: parts of longer ones, as in telephones, are no days
DATE_FLEX = r"(?U)(?=\d)(?<!\d)(?:(\d{4})\s*[년.\-/]\s*)?(\d{1,2})\s*[월.\-/]\s*(\d{1,2})(?!\d)\s*일?(\s*(?:이?전|까지))?"
OPERATORS = ("이상", "초과", "이하", "미만")
NEGATIONS = ("제외", "아니", "불가", "없", "금지", "말아야", "마십시오", r"지\s*않", r"못\s*하")
AFFIRMATIONS = ("포함", "가능", "있습니다", "할 수 있", "허용")
REVERSALS = ("지 않", "지않", "지는 않", "그렇지 않", "라고 생각", "아니")
REVERSAL_WINDOW, OPERATOR_WINDOW = 18, 8
RECOVERABLE = ("numeric", "date", "money", "duration", "contact", "scope")

KINDS = ("money", "date", "contact", "scope", "negation", "agency", "numeric")
SLOT = "array<struct<type:string,raw_span:string,value:string,polarity:boolean,operand:string,source_offset:int,criticality:string>>"
RESULTS = ("slots", "failed", "drift_flags", "date_flips", "scope_flips", "negation_flips", "verdict")


def _operand(span: Column) -> Column:
    return stripped(F.regexp_replace(span, "(?:" + "|".join(OPERATORS) + ")$", ""))


def money(text: Column, hedged: bool = False) -> Column:
    """The pattern that finds amounts in a text."""
    every, digits = (HEDGED_MONEY, HEDGED_IN_DIGITS) if hedged else (MONEY, MONEY_IN_DIGITS)
    return F.when(text.rlike(WRITTEN), every).otherwise(digits)


def inner_digits_masked(text: Column) -> Column:
    """Digits after a digit or comma, where no count begins, are one and the same character."""
    return F.regexp_replace(text, r"(?U)(?=\d)(?<=[\d,])\d", "#")


def _count(span: Column) -> Column:
    return F.get(n.counts(span), F.lit(0))


def slots(text: Column, ref_date: Column, kinds: Iterable[str] = KINDS, criticality: Mapping[str, str] | None = None) -> Column:
    """Facts that must survive, family by family (money, date, contact, scope, negation, agency, numeric), in the order of the text.

    kinds: the families that are wanted; the others are not looked for. criticality: of each family, high if it is not named; only facts of
    high criticality are verified. raw_span is the text as it is written, source_offset the characters before it."""
    symbols = tuple(v for k, v in n.BOUNDARIES.items() if k in OPERATORS)
    families = {
        "money": (money(text, hedged=True), n.amount),
        "date": (DATE, lambda m: F.concat(n.date_iso(m, ref_date), F.when(n.inclusive(m), "|inclusive").otherwise(""))),
        "contact": (CONTACT, n.phone),
        "scope": (SCOPE, lambda m: F.when(n.boundary(m).isin(*symbols), n.boundary(m))),
        "negation": (NEGATION, stripped),
        "agency": (AGENCY, lambda m: m),
        "numeric": (n.COUNT, _count),
    }

    def family(kind: str) -> Column:
        pattern, value = families[kind]
        return F.filter(
            F.transform(
                matches(text, pattern, inner_digits_masked) if kind == "numeric" else matches(text, pattern),
                lambda m: F.struct(
                    F.lit(kind).alias("type"), stripped(m["span"]).alias("raw_span"), value(m["span"]).alias("value"), F.lit(kind != "negation").alias("polarity"),
                    (_operand(stripped(m["span"])) if kind == "scope" else F.lit(None).cast("string")).alias("operand"),
                    m["at"].alias("source_offset"), F.lit((criticality or {}).get(kind, "high")).alias("criticality"),
                ),
            ).cast(SLOT),
            lambda s: s["value"].isNotNull(),
        )

    wanted = [k for k in KINDS if k in set(kinds)]
    return F.concat(*map(family, wanted)) if wanted else F.array().cast(SLOT)


def days(text: Column) -> Column:
    """Days in the order of the text: year (empty if it is left out), month, day and qualifier, as they are written. The text is searched once, its parts are read off what was found."""
    return F.transform(found(text, DATE_FLEX), lambda m: F.struct(*(F.regexp_extract(m, DATE_FLEX, i).alias(c) for i, c in ((1, "y"), (2, "m"), (3, "d"), (4, "q")))))


def _first_qualifier(flex: Column, iso: Column, ambiguous: Column) -> Column:
    """Of the first date in the easy text that means iso: what follows it; null if there is none. flex: year, month, day, qualifier."""
    y, m, d = F.substring(iso, 1, 4), F.substring(iso, 6, 2).cast("int"), F.substring(iso, 9, 2).cast("int")
    same = F.filter(flex, lambda x: (x["m"] == m) & (x["d"] == d) & F.when(x["y"] == "", ~ambiguous).otherwise(x["y"] == y))
    return F.get(same, F.lit(0))["q"]


def _ambiguous(dates: Column, iso: Column) -> Column:
    """Whether the source names iso's month and day in two years."""
    return F.size(F.array_distinct(F.filter(dates, lambda x: F.substring(x, 6, 5) == F.substring(iso, 6, 5)))) >= 2


def ambiguous_days(slots: Column) -> Column:
    """Month-days (MM-dd) that the date slots name in more than one year, in order."""
    days = F.array_distinct(F.transform(F.filter(slots, lambda s: s["type"] == "date"), lambda s: F.substring_index(s["value"], "|", 1)))
    return F.array_sort(F.array_distinct(F.transform(F.filter(days, lambda iso: _ambiguous(days, iso)), lambda x: F.substring(x, 6, 5))))


def _inside(text: Column, at: Column) -> Column:
    """Whether a place (from 1) comes after a digit or comma."""
    return (at > 1) & F.substring(text, at - 1, F.lit(1)).rlike(r"(?U)[\d,]")


def _windows(easy: Column, operand: Column) -> Column:
    """What follows each place of an operand. One that stands once is looked at without a pattern, since that of each row would have to be compiled."""
    searched = found(easy, F.concat(F.lit(r"(?Us)(?<![\d,])"), quoted(operand), F.lit("(?=(.{0,%d}))" % OPERATOR_WINDOW)), 1)
    window = lambda at: F.substring(easy, at + F.length(operand), F.lit(OPERATOR_WINDOW))
    once = lambda at: F.when(_inside(easy, at), F.array().cast("array<string>")).otherwise(F.array(window(at)))
    return bound(place(operand, easy), lambda at: F.when((at > 0) & (place(operand, easy, at + 1) == 0), once(at)).otherwise(searched))


def _operator(window: Column) -> Column:
    out = F.lit("")
    for word in reversed(OPERATORS):
        out = F.when(window.contains(word), n.BOUNDARIES[word]).otherwise(out)
    return out


def _stands(text: Column, p: str) -> Column:
    """Whether a mark stands in a text; the letters of one with a blank are looked for before its pattern is."""
    letters = p.split(r"\s*")
    plain = text.contains(letters[0])
    for x in letters[1:]:
        plain = plain & text.contains(x)
    return plain & text.rlike(f"(?U){p}") if letters[1:] else plain


def _mark(text: Column, p: str) -> Column:
    """How a mark is written where it stands first; null if it does not."""
    return F.when(_stands(text, p), F.replace(F.regexp_extract(text, f"(?U){p}", 0), F.lit(" "), F.lit("")) if r"\s" in p else F.lit(p))


def negation_flags(source: Column, easy: Column) -> Column:
    """A text for each negation of the source that is missing in the easy text, or is negated again there."""
    here = F.array_compact(F.array(*(_mark(source, p) for p in NEGATIONS)))
    there = F.array_compact(F.array(*(_mark(easy, p) for p in NEGATIONS)))
    affirmed = F.when(any_of(easy, AFFIRMATIONS), F.lit(" (긍정하는 말이 있음)")).otherwise("")
    lost = F.transform(F.array_except(here, there), lambda m: F.concat(F.lit("부정 '"), m, F.lit("' 없음"), affirmed))

    def again(p: str) -> Column:
        windows = f"(?Us){p}(?=(.{{0,{REVERSAL_WINDOW}}}))"
        both = F.arrays_zip(found(easy, windows, 0).alias("m"), found(easy, windows, 1).alias("w"))
        marker = F.get(F.filter(both, lambda x: any_of(x["w"], REVERSALS)), F.lit(0))["m"]
        return F.when(_stands(source, p) & _stands(easy, p), F.concat(F.lit("부정 '"), F.replace(marker, F.lit(" "), F.lit("")), F.lit("' 다시 부정됨")))

    # without a word of reversal in the text there is none behind a mark
    out = F.concat(lost, F.when(any_of(easy, REVERSALS), F.array_compact(F.array(*map(again, NEGATIONS)))).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(here) > 0, out).otherwise(F.array().cast("array<string>"))


def negated(source: Column, easy: Column) -> Column:
    """Whether there are negation_flags."""
    gone, again = F.lit(False), F.lit(False)
    for p in NEGATIONS:
        # a mark that is written as it is looked for is either there or not; that of a pattern may be written in several ways
        gone = gone | (_stands(source, p) & (~F.coalesce(_mark(source, p) == _mark(easy, p), F.lit(False)) if r"\s" in p else ~easy.contains(p)))
        again = again | (_stands(source, p) & _stands(easy, p) & F.exists(found(easy, f"(?Us){p}(?=(.{{0,{REVERSAL_WINDOW}}}))", 1), lambda w: any_of(w, REVERSALS)))
    return gone | (any_of(easy, REVERSALS) & again)


def with_facts(sources: DataFrame, name: str = "source_slots", criticality: Mapping[str, str] | None = None) -> DataFrame:
    """sources (source_text, ref_date) with their facts, for verified(facts=name): a source with many easy texts is read for them once, before its rows are multiplied."""
    text, day = (free_name(c, sources.columns) for c in ("facts_source", "facts_ref"))
    kept = [c for c in sources.columns if c != name]
    out = computed(sources, {text: F.coalesce(F.col("source_text").cast("string"), F.lit("")), day: F.col("ref_date").cast("date")})
    return computed(out, {free_name("facts_found", out.columns): F.struct(slots(F.col(text), F.col(day), criticality=criticality).alias("x"))}).select(*kept, F.col(free_name("facts_found", out.columns))["x"].alias(name))


def _iso_of(s: Column) -> Column:
    return F.substring_index(s["value"], "|", 1)


def _has(values: Column, s: Column) -> Column:
    return F.exists(values, lambda x: F.coalesce(x == s["value"], F.lit(False)))


def _values(easy: Column, ref: Column) -> dict[str, Column]:
    """What an easy text says, by the kinds of facts that are compared by value."""
    return {"money": F.transform(found(easy, money(easy)), n.amount), "date": F.transform(found(easy, DATE), lambda m: n.date_iso(m, ref)), "contact": F.transform(found(easy, CONTACT), n.phone), "numeric": n.count_values(easy)}


def _flex(easy: Column) -> Column:
    return F.transform(days(easy), lambda x: F.struct(ascii_digits(x["y"]).alias("y"), *(ascii_digits(x[c]).try_cast("int").alias(c) for c in "md"), x["q"].alias("q")))


def _dates(slots: Column) -> Column:
    return F.transform(F.filter(slots, lambda s: s["type"] == "date"), _iso_of)


def _rounded(s: Column, easy: Column, allowed: tuple[str, ...]) -> Column:
    return any_of(s["raw_span"], n.HEDGES) & any_of(easy, n.HEDGES) & s["value"].isin(*allowed) if allowed else F.lit(False)


def _operand_stands(s: Column, easy: Column) -> Column:
    """The pattern is tried only where the first place of the operand does not do."""
    operand = s["operand"]
    searched = F.rlike(easy, F.concat(F.lit(r"(?U)(?<![\d,])"), quoted(operand)))
    return (operand != "") & bound(place(operand, easy), lambda at: (at > 0) & (~_inside(easy, at) | searched))


def _qualifier(s: Column, flex: Column, dates: Column) -> Column:
    return _first_qualifier(flex, _iso_of(s), _ambiguous(dates, _iso_of(s)))


def _weakened(s: Column, q: Column) -> Column:
    return s["value"].endswith("|inclusive") & q.isNotNull() & ~(q.contains("까지") & ~q.contains("전"))


def _bounds(slots: Column) -> tuple[Column, Column]:
    """Bounds with an operand, and their operands and values, each once; an operand that is missing is a miss, not a flip."""
    scope = F.filter(slots, lambda s: (s["type"] == "scope") & (s["operand"] != ""))
    return scope, F.array_distinct(F.transform(scope, lambda s: F.struct(s["operand"].alias("operand"), s["value"].alias("value"))))


def _flipped(scope: Column, p: Column, easy: Column) -> Column:
    """Of the bounds with an operand and value those whose operator is lost: operators are compared as multisets by operand, in the order of the text."""
    nothing = F.array().cast(SLOT)

    def lost(windows: Column) -> Column:
        mine = F.filter(scope, lambda s: (s["operand"] == p["operand"]) & (s["value"] == p["value"]))
        there = F.filter(windows, lambda w: _operator(w) == p["value"])
        return F.when(F.size(windows) > 0, F.slice(mine, F.size(there) + 1, F.size(mine))).otherwise(nothing)

    return F.when(F.contains(easy, p["operand"]), bound(_windows(easy, p["operand"]), lost)).otherwise(nothing)


KEYS = "struct<money:array<string>,date:array<string>,contact:array<string>,scope:array<struct<operand:string,value:string>>,negation:array<string>,agency:array<string>,numeric:array<string>,days:array<string>>"
NONE = "array<string>"
FAILED = "array<struct<type:string,value:string>>"
FLIPS = ("date_flips", "scope_flips", "negation_flips")
FINDINGS = ("facts", "failed", *FLIPS, "verdict")


def keys(text: Column, ref_date: Column, criticality: Mapping[str, str] | None = None, kinds: Iterable[str] = KINDS) -> Column:
    """The facts of slots() by kind, in the order of the text, as no more than what an easy text is asked for: values, and of bounds operands too. Only those of high criticality and of the kinds that are wanted; days are those of all dates."""
    wanted = lambda kind: kind in set(kinds) and (criticality or {}).get(kind, "high") == "high"
    none = F.array().cast(NONE)
    operator = lambda m: F.nullif(_operator(m), F.lit(""))
    bounds = F.transform(found(text, SCOPE), lambda m: bound(operator(m), lambda v: F.when(v.isNotNull(), F.struct(_operand(stripped(m)).alias("operand"), v.alias("value")))))
    date = lambda m: F.concat(n.date_iso(m, ref_date), F.when(n.inclusive(m), "|inclusive").otherwise(""))
    dates = F.array_compact(F.transform(found(text, DATE), date))
    made = {
        "money": F.array_compact(F.transform(found(text, money(text, hedged=True)), n.amount)), "contact": F.array_compact(F.transform(found(text, CONTACT), n.phone)), "negation": F.transform(found(text, NEGATION), stripped),
        "agency": found(text, AGENCY), "numeric": F.array_compact(n.counts(text)), "scope": F.array_compact(bounds),
    }
    made = {k: v if wanted(k) else F.array().cast("array<struct<operand:string,value:string>>") if k == "scope" else none for k, v in made.items()}
    iso = lambda all_: F.struct((all_ if wanted("date") else none).alias("date"), F.transform(all_, lambda x: F.substring_index(x, "|", 1)).alias("days"))
    # dates are read once for both columns that hold them
    return bound(dates, lambda all_: F.struct(*((iso(all_)["date"] if k == "date" else made[k]).alias(k) for k in KINDS), iso(all_)["days"].alias("days"))).cast(KEYS)


def _keys_of(slots: Column) -> Column:
    """keys() of facts that are there as slots."""
    of = lambda kind, f: F.transform(F.filter(slots, lambda s: (s["criticality"] == "high") & (s["type"] == kind)), f)
    pair = lambda s: F.struct(s["operand"].alias("operand"), s["value"].alias("value"))
    return F.struct(*(of(k, pair if k == "scope" else lambda s: s["value"]).alias(k) for k in KINDS), _dates(slots).alias("days")).cast(KEYS)


def with_keys(sources: DataFrame, name: str = "source_keys", criticality: Mapping[str, str] | None = None) -> DataFrame:
    """sources (source_text, ref_date) with keys(), for verdicts(keys=name): less than with_facts, and enough for a verdict."""
    text, day, found_ = (free_name(c, sources.columns) for c in ("keys_source", "keys_ref", "keys_found"))
    kept = [c for c in sources.columns if c != name]
    out = computed(sources, {text: F.coalesce(F.col("source_text").cast("string"), F.lit("")), day: F.col("ref_date").cast("date")})
    return computed(out, {found_: keys(F.col(text), F.col(day), criticality)}).select(*kept, F.col(found_).alias(name))


def _missing(kind: str, mine: Column, easy: Column, ref: Column, k: Column) -> Column:
    """Those of a kind's facts that an easy text lacks; those that are compared by value come once each. Days are not told here."""
    if kind == "scope":
        return F.filter(mine, lambda s: ~F.coalesce(_operand_stands(s, easy), F.lit(False)))
    if kind == "negation":
        return F.filter(mine, lambda v: ~F.contains(easy, v))
    if kind == "agency":
        return bound(F.replace(easy, F.lit(" "), F.lit("")), lambda close: F.filter(mine, lambda v: ~F.contains(close, F.replace(v, F.lit(" "), F.lit("")))))
    if kind == "numeric":
        # native numerals are looked for only if digits do not do
        return bound(F.array_except(mine, n.counts(easy)), lambda miss: F.when(F.size(miss) > 0, F.array_except(miss, n.native_counts(easy))).otherwise(miss))
    return F.array_except(mine, _values(easy, ref)[kind])


def _lost(kind: str, mine: Column, easy: Column, ref: Column, k: Column) -> Column:
    """The facts of a kind, repeated ones too, that an easy text lacks; nothing is looked for if there is none."""
    missing = _missing(kind, mine, easy, ref, k)
    if kind not in ("scope", "negation", "agency"):
        missing = bound(missing, lambda miss: F.when(F.size(miss) > 0, F.filter(mine, lambda v: F.array_contains(miss, v))).otherwise(miss))
    return F.when(F.size(mine) > 0, missing).otherwise(mine)


def _day_codes(k: Column, easy: Column, ref: Column) -> Column:
    """Of each date: 2 weakened, 1 lost, else 0."""

    def of(v: Column, flex: Column) -> Column:
        iso = F.substring_index(v, "|", 1)
        stands = lambda i: F.contains(easy, i) | F.exists(found(easy, DATE), lambda m: F.coalesce(n.date_iso(m, ref) == i, F.lit(False)))
        q = lambda i: _first_qualifier(flex, i, _ambiguous(k["days"], i))
        weak = lambda x: v.endswith("|inclusive") & x.isNotNull() & ~(x.contains("까지") & ~x.contains("전"))
        return bound(iso, lambda i: bound(q(i), lambda x: F.when(F.coalesce(weak(x), F.lit(False)), 2).when(x.isNotNull() | F.coalesce(stands(i), F.lit(False)), 0).otherwise(1)))

    return F.when(F.size(k["date"]) > 0, bound(_flex(easy), lambda flex: F.transform(k["date"], lambda v: of(v, flex)))).otherwise(F.array().cast("array<int>"))


def _flip_counts(k: Column, easy: Column) -> Column:
    """Of each operand and operator of the source: how many of its bounds have lost the operator."""
    scope = F.filter(k["scope"], lambda s: s["operand"] != "")

    def lost(p: Column, mine: Column, windows: Column) -> Column:
        there = F.size(F.filter(windows, lambda w: _operator(w) == p["value"]))
        return F.when(F.size(windows) > 0, F.greatest(F.size(F.filter(mine, lambda s: s == p)) - there, F.lit(0))).otherwise(0)

    return bound(scope, lambda mine: F.transform(F.array_distinct(mine), lambda p: F.when(F.contains(easy, p["operand"]), bound(_windows(easy, p["operand"]), lambda w: lost(p, mine, w))).otherwise(0)))


def _prepared(pairs: DataFrame, results: tuple[str, ...], criticality: Mapping[str, str] | None, known: Column | None, given: tuple[str, ...], kinds: Iterable[str] = KINDS) -> tuple[DataFrame, list[str], dict[str, Column]]:
    """pairs with texts, day, doubt and keys, each computed once; the columns that are kept, and those that were added."""
    kept = [c for c in pairs.columns if c.lower() not in results and c not in given]
    names = {k: free_name(f"gate_{k}", pairs.columns) for k in ("source", "easy", "ref", "doubt", "keys")}
    doubt = F.coalesce(F.col("confidence") < 0.5, F.lit(False)) if "confidence" in pairs.columns else F.lit(False)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    before = [] if known is None else [known.alias(names["keys"])]
    out = pairs.select(*kept, *before, *(F.col(c) for c in ("source_text", "easy_text", "ref_date") if c not in kept))
    out = computed(out, {names["source"]: text("source_text"), names["easy"]: text("easy_text"), names["ref"]: F.col("ref_date").cast("date"), names["doubt"]: doubt})
    if known is None:
        out = computed(out, {names["keys"]: keys(F.col(names["source"]), F.col(names["ref"]), criticality, kinds)})
    return out, kept, {k: F.col(v) for k, v in names.items()}


def verdicts(pairs: DataFrame, rounding_allowed: tuple[str, ...] = (), criticality: Mapping[str, str] | None = None, facts: str | None = None, keys: str | None = None) -> DataFrame:
    """The verdict of verified() alone: kinds of facts are looked for one after the other, and no further than the verdict needs. Columns of the input called like a result of verified() give way as there.

    facts, keys: a column of with_facts or with_keys, if the sources have one; it is not part of the result."""
    if rounding_allowed:  # asks for the spans of the amounts
        whole = verified(pairs, rounding_allowed, criticality, facts)
        return whole.select(*(c for c in whole.columns if c.lower() not in RESULTS and c != keys), "verdict")
    known = F.col(keys) if keys else _keys_of(F.col(facts)) if facts else None
    out, kept, c = _prepared(pairs, RESULTS, criticality, known, tuple(x for x in (facts, keys) if x))
    k, easy, ref = c["keys"], c["easy"], c["ref"]
    # whether something is missing, kind by kind: the first that is ends the search
    lost = lambda kind: (F.size(k[kind]) > 0) & (F.size(_missing(kind, k[kind], easy, ref, k)) > 0)
    flipped = F.exists(_flip_counts(k, easy), lambda x: x > 0)
    human = (stripped(c["source"]) == "") | c["doubt"] | lost("agency") | lost("negation") | negated(c["source"], easy) | flipped
    day = F.coalesce(F.array_max(_day_codes(k, easy, ref)), F.lit(0))
    others = lost("scope") | lost("contact") | lost("numeric") | lost("money")
    by_day = bound(day, lambda x: F.when(x == 2, "human_review").when(F.when(x == 1, True).otherwise(others), "revise").otherwise("pass"))
    return computed(out, {"verdict": F.when(human, "human_review").otherwise(by_day)}).select(*kept, "verdict")


def findings(pairs: DataFrame, only: Iterable[str] = FINDINGS, criticality: Mapping[str, str] | None = None) -> DataFrame:
    """What verified() finds, without spans and places: facts and failed (type and value of each, in its order), date_flips, scope_flips, negation_flips, verdict. only: results that are wanted; nothing is looked for that they do not need."""
    wanted = [f for f in FINDINGS if f in set(only)]
    # meanings change by days and bounds alone, of the facts
    kinds = KINDS if {"facts", "failed", "verdict"} & set(wanted) else ("date", "scope")
    out, kept, c = _prepared(pairs, (*RESULTS, *FINDINGS), criticality, None, (), kinds)
    k, easy, ref, source = c["keys"], c["easy"], c["ref"], c["source"]
    days, changes, failed = (free_name(f"gate_{x}", out.columns) for x in ("days", "changes", "lost"))
    judged, losses = "verdict" in wanted, {"failed", "verdict"} & set(wanted)
    if losses or "date_flips" in wanted:
        out = computed(out, {days: _day_codes(k, easy, ref)})
    flips = {
        "date_flips": lambda: F.size(F.filter(days, lambda x: x == 2)), "scope_flips": lambda: F.aggregate(_flip_counts(k, easy), F.lit(0), lambda a, x: a + x),
        "negation_flips": lambda: F.when(negated(source, easy), F.size(negation_flags(source, easy))).otherwise(0),
    }
    made = {x: f() for x, f in flips.items() if judged or x in wanted}
    typed = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), (v["value"] if kind == "scope" else v).alias("value")))
    if losses:
        # a weakened day is in the text
        dates = lambda: F.transform(F.filter(F.arrays_zip(k["date"].alias("v"), F.col(days).alias("x")), lambda z: z["x"] == 1), lambda z: z["v"])
        made[failed] = F.concat(*(typed(kind, dates() if kind == "date" else _lost(kind, k[kind], easy, ref, k)) for kind in KINDS)).cast(FAILED)
    out = computed(out, {changes: F.struct(*(v.alias(x) for x, v in made.items()))})
    e = F.col(changes)
    results = {x: e[x] for x in FLIPS if x in wanted} | ({"failed": e[failed]} if "failed" in wanted else {})
    if "facts" in wanted:
        results["facts"] = F.concat(*(typed(kind, k[kind]) for kind in KINDS)).cast(FAILED)
    if judged:
        human = (stripped(source) == "") | c["doubt"] | (e["date_flips"] + e["scope_flips"] + e["negation_flips"] > 0)
        unsafe = F.exists(e[failed], lambda x: ~x["type"].isin(*RECOVERABLE))
        results["verdict"] = F.when(human, "human_review").when(F.size(e[failed]) == 0, "pass").when(unsafe, "human_review").otherwise("revise")
    return out.select(*kept, *(results[x].alias(x) for x in wanted))


def verified(pairs: DataFrame, rounding_allowed: tuple[str, ...] = (), criticality: Mapping[str, str] | None = None, facts: str | None = None) -> DataFrame:
    """pairs: source_text, easy_text, ref_date, and optionally confidence (lowest of the source's blocks). facts: a column of with_facts, if the sources have one; it is not part of the result.

    Adds slots, failed (slots that did not survive), drift_flags (a text for each change of meaning), date_flips, scope_flips and negation_flips (their numbers),
    verdict. The texts are computed once, whatever expressions they come from."""
    kept = [c for c in pairs.columns if c.lower() not in RESULTS and c != facts]
    found_before = [] if facts is None else [facts]
    names = {k: free_name(f"gate_{k}", pairs.columns) for k in ("source", "easy", "ref", "facts", "doubt")}
    source, easy, ref, e = (F.col(names[k]) for k in ("source", "easy", "ref", "facts"))
    doubt = F.coalesce(F.col("confidence") < 0.5, F.lit(False)) if "confidence" in pairs.columns else F.lit(False)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = computed(pairs.select(*kept, *found_before, *(F.col(c) for c in ("source_text", "easy_text", "ref_date") if c not in kept)), {names["source"]: text("source_text"), names["easy"]: text("easy_text"), names["ref"]: F.col("ref_date").cast("date"), names["doubt"]: doubt})
    out = computed(out, {"slots": slots(source, ref, criticality=criticality)}) if facts is None else out.withColumnRenamed(facts, "slots")
    high = F.filter("slots", lambda s: s["criticality"] == "high")
    facts = {**_values(easy, ref), "dates": _dates(F.col("slots")), "close": F.replace(easy, F.lit(" "), F.lit("")), "flex": _flex(easy), "high": high}
    out = computed(out, {names["facts"]: F.struct(*(v.alias(k) for k, v in facts.items()))})

    def survived(s: Column) -> Column:
        return (
            F.when(s["type"] == "money", _has(e["money"], s) | _rounded(s, easy, rounding_allowed))
            .when(s["type"] == "date", F.exists(e["date"], lambda x: F.coalesce(x == _iso_of(s), F.lit(False))) | F.contains(easy, _iso_of(s)) | _qualifier(s, e["flex"], e["dates"]).isNotNull())
            .when(s["type"] == "contact", _has(e["contact"], s))
            .when(s["type"] == "scope", _operand_stands(s, easy))
            .when(s["type"] == "numeric", _has(e["numeric"], s))
            .when(s["type"] == "agency", F.contains(e["close"], F.replace(s["value"], F.lit(" "), F.lit(""))))
            .otherwise(F.contains(easy, s["value"]))
        )

    failed = F.filter(e["high"], lambda s: ~F.coalesce(survived(s), F.lit(False)))
    weak = F.filter(e["high"], lambda s: (s["type"] == "date") & bound(_qualifier(s, e["flex"], e["dates"]), lambda q: F.coalesce(_weakened(s, q), F.lit(False))))
    date_flags = F.transform(weak, lambda s: F.concat(F.lit("기한 '"), s["raw_span"], F.lit("' 약해짐")))
    scope, once = _bounds(e["high"])
    scope_flags = bound(scope, lambda ss: F.transform(F.flatten(F.transform(once, lambda p: _flipped(ss, p, easy))), lambda s: F.concat(F.lit("조건 '"), s["raw_span"], F.lit("' 바뀜"))))
    out = computed(out, {"failed": failed, **{names["facts"] + c: v for c, v in (("d", date_flags), ("s", scope_flags), ("n", negation_flags(source, easy)))}})
    d, s, neg = (F.col(names["facts"] + c) for c in "dsn")
    blank = stripped(source) == ""
    flags = F.when(blank, F.array(F.lit("원문이 비어 있음"))).otherwise(F.concat(neg, d, s))
    flips = F.size(d) + F.size(s) + F.size(neg)
    unsafe = F.exists("failed", lambda x: ~x["type"].isin(*RECOVERABLE))
    verdict = F.when(blank | F.col(names["doubt"]) | (flips > 0), "human_review").when(F.size("failed") == 0, "pass").when(unsafe, "human_review").otherwise("revise")
    return out.select(*kept, "slots", "failed", flags.alias("drift_flags"), F.size(d).alias("date_flips"), F.size(s).alias("scope_flips"), F.size(neg).alias("negation_flips"), verdict.alias("verdict"))
