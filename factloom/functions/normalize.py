"""Normal forms of Korean numbers, money, dates, phone numbers and counts as column expressions; null where there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import ascii_digits, bound, found, stripped

# Numerals, units and words that results depend on.
DIGITS = {"영": 0, "공": 0, "일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "륙": 6, "칠": 7, "팔": 8, "구": 9}
SMALL_UNITS = {"십": 10, "백": 100, "천": 1000}
BIG_UNITS = {"만": 10**4, "억": 10**8, "조": 10**12, "경": 10**16}
HEDGES = ("약", "대략", "여", "내외", "쯤", "가량")
AFFIXES = ("원정", "원", "금")
BOUNDARIES = {"이상": ">=", "초과": ">", "이하": "<=", "미만": "<", "까지": "inclusive", "부터": "from"}
COUNT_UNITS = ("명", "건", "회", "개", "가구", "세대", "곳", "세", "%", "퍼센트")
NATIVE_NUMERALS = {"한": 1, "두": 2, "세": 3, "네": 4, "다섯": 5, "여섯": 6, "일곱": 7, "여덟": 8, "아홉": 9, "열": 10}
YMD = r"(?U)(\d{4})\s*[년.\-/]\s*(\d{1,2})\s*[월.\-/]\s*(\d{1,2})\s*일?"
USUAL_DAY = r"\A([1-9][0-9]{3})[년.\-/] ?([0-9]{1,2})[월.\-/] ?([0-9]{1,2})(?:일| |\z)[가-힣 ]*\z"
D_MINUS = r"(?U)D\s*-\s*(\d+)"
DAYS_AFTER = r"(?U)(\d+)\s*일\s*(?:후|뒤|이내)"
_UNITS = "|".join("개(?!월)" if u == "개" else u for u in COUNT_UNITS)
_COUNTED = "|".join("개(?!월)" if u == "개" else u for u in COUNT_UNITS if u not in ("%", "퍼센트"))
COUNT = rf"(?U)(?=\d)(?<![\d,])(\d{{1,3}}(?:,\d{{3}})+|\d+)\s*({_UNITS})"
NATIVE = ("다섯", "여섯", "일곱", "여덟", "아홉", "한", "두", "세", "네", "열")
NATIVE_COUNT = rf"(?U)(?=[{''.join(sorted({w[0] for w in NATIVE}))}])(?<![가-힣])({'|'.join(NATIVE)})\s*({_COUNTED})"


def _looked_up(char: Column, table: dict[str, int], kind: str = "long") -> Column:
    out = F.lit(None).cast(kind)
    for k, v in table.items():
        out = F.when(char == k, F.lit(v).cast(kind)).otherwise(out)
    return out


def _numeral(text: Column) -> Column:
    """text without hedges, currency marks, commas and blanks, its digits as 0 to 9."""
    s = ascii_digits(stripped(text))
    for word in (*HEDGES, *AFFIXES, ",", " "):
        s = F.replace(s, F.lit(word), F.lit(""))
    return s


def _bound(x: Column, f) -> Column:
    """f of x, with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def korean_number(text: Column) -> Column:
    """A number written in digits, Korean numerals or both, with hedges and currency marks, as a long.

    Null if nothing is left to read, a character has no meaning, or the value is beyond a long (see amount)."""
    return amount(text).try_cast("long")


def amount(text: Column) -> Column:
    """The same number as a string of digits, of any size, so that no amount is lost.

    Runs of digits may be of any length. Numerals beyond 38 digits stand for themselves, as they are written. Null if there is no number."""
    plain = lambda s: F.regexp_replace(s, "^0+(?=.)", "")
    read = _bound(_numeral(text), lambda s: F.when(s.rlike("^[0-9]+$"), plain(s)).when(s != "", _read(s)))
    # the usual forms hold nothing but digits and commas
    bare = F.replace(F.replace(text, F.lit(","), F.lit("")), F.lit("원"), F.lit(""))
    return F.when(text.rlike(r"\A[1-9][0-9,]*원\z"), bare).when(text.rlike(r"\A,*[0-9][0-9,]*원\z"), plain(bare)).otherwise(read)


def _read(s: Column) -> Column:
    kind = "decimal(38,0)"

    def state(**now: Column) -> Column:
        return F.struct(*(v.alias(k) for k, v in now.items()))

    def plus(a: Column, b: Column) -> Column:
        return F.try_add(a, b).cast(kind)

    def times(a: Column, b: Column) -> Column:
        return F.try_multiply(a, b).cast(kind)

    zero, one, none = (F.lit(x).cast(kind) for x in (0, 1, -1))
    # all: finished myriads; part: finished units of the chunk; digit: last Korean digit; run: Arabic digits read so far (-1: none); large: beyond 38 digits
    start = state(all=zero, part=zero, digit=zero, run=none, open=F.lit(False), big=F.lit(False), bad=F.lit(False), large=F.lit(False))

    def step(a: Column, c: Column) -> Column:
        arabic, korean = F.when(c.between("0", "9"), c.try_cast(kind)), _looked_up(c, DIGITS, kind)
        small, big = _looked_up(c, SMALL_UNITS, kind), _looked_up(c, BIG_UNITS, kind)
        current = F.when(a["run"] >= 0, a["run"]).otherwise(a["digit"])
        chunk = F.when(a["open"], plus(a["part"], current)).otherwise(one)
        run = plus(times(F.greatest(a["run"], zero), F.lit(10).cast(kind)), arabic)
        part, whole = plus(a["part"], times(F.when(current == 0, one).otherwise(current), small)), plus(a["all"], times(chunk, big))

        def then(all=a["all"], part=a["part"], digit=a["digit"], run=none, open=F.lit(True), big=a["big"], bad=a["bad"], large=F.lit(False)) -> Column:
            return state(all=F.coalesce(all, zero), part=F.coalesce(part, zero), digit=digit, run=F.coalesce(run, zero), open=open, big=big, bad=bad, large=a["large"] | large)

        return (
            F.when(arabic.isNotNull(), then(run=run, large=run.isNull()))
            .when(korean.isNotNull(), then(digit=korean))
            .when(small.isNotNull(), then(part=part, digit=zero, large=part.isNull()))
            .when(big.isNotNull(), then(all=whole, part=zero, digit=zero, open=F.lit(False), big=F.lit(True), large=whole.isNull()))
            .otherwise(then(bad=F.lit(True)))
        )

    def finish(a: Column) -> Column:
        total = plus(a["all"], F.when(a["open"], plus(a["part"], F.when(a["run"] >= 0, a["run"]).otherwise(a["digit"]))).otherwise(zero))
        number = F.when((total != 0) | a["big"], total.cast("string"))
        return F.when(~a["bad"], F.when(a["large"] | total.isNull(), s).otherwise(number))

    return F.aggregate(F.split(s, ""), start, step, finish)


def date_iso(span: Column, ref_date: Column) -> Column:
    """yyyy-MM-dd of an absolute date, or of D-N and N days after, counted from ref_date. Null for days that do not exist or come after the year 9999."""
    # the usual form is one day and nothing else of digits
    usual = F.regexp_replace(span, USUAL_DAY, "$1-$2-$3").try_cast("date").cast("string")
    return F.when(span.rlike(USUAL_DAY), usual).otherwise(_bound(ascii_digits(span), lambda s: _iso(s, ref_date)))


def _iso(span: Column, ref_date: Column) -> Column:
    y, m, d = (F.regexp_extract(span, YMD, i) for i in (1, 2, 3))
    absolute = F.call_function("try_to_date", F.concat_ws("-", y, m, d), F.lit("y-M-d"))
    days = F.coalesce(F.nullif(F.regexp_extract(span, D_MINUS, 1), F.lit("")), F.nullif(F.regexp_extract(span, DAYS_AFTER, 1), F.lit("")))
    days = days.try_cast("long")
    left = F.datediff(F.lit("9999-12-31").cast("date"), ref_date)
    counted = F.date_add(ref_date, F.when(days <= left, days).cast("int"))
    return F.date_format(F.when(span.rlike(YMD), absolute).otherwise(counted), "yyyy-MM-dd")


def inclusive(span: Column) -> Column:
    return span.contains("까지") & ~span.contains("전")


def phone(span: Column) -> Column:
    """The digits of any script, as they are written."""
    return F.nullif(F.regexp_replace(span, r"(?U)\D", ""), F.lit(""))


def boundary(span: Column) -> Column:
    """Symbol of the first boundary word, in the order of the table, that span holds."""
    out = F.lit(None).cast("string")
    for word, symbol in reversed(BOUNDARIES.items()):
        out = F.when(span.contains(word), symbol).otherwise(out)
    return out


def counts(text: Column) -> Column:
    """Numbers with their units in order: 3,000가구 as 3000가구, 32퍼센트 as 32%."""
    plain = lambda n: F.regexp_replace(F.replace(ascii_digits(n), F.lit(","), F.lit("")), "^0+(?=.)", "")
    # the text is searched once; number and unit are read off what was found
    number, unit = (lambda m: F.regexp_extract(m, r"(?U)^[\d,]+", 0)), (lambda m: F.regexp_extract(m, rf"(?U)({'|'.join(COUNT_UNITS)})$", 1))
    # what is written in plain digits without a blank is its own value
    return F.transform(found(text, COUNT), lambda m: F.when(m.rlike(r"\A[1-9][0-9]*(?!퍼)[가-힣%]+\z"), m).otherwise(F.concat(plain(number(m)), bound(unit(m), lambda u: F.when(u == "퍼센트", "%").otherwise(u)))))


def native_counts(text: Column) -> Column:
    """Counts in native numerals from one to ten."""
    number, unit = (lambda m: F.regexp_extract(m, f"^({'|'.join(NATIVE)})", 1)), (lambda m: F.regexp_extract(m, f"({'|'.join(COUNT_UNITS)})$", 1))
    return F.transform(found(text, NATIVE_COUNT), lambda m: bound(number(m), lambda w: F.concat(_looked_up(w, NATIVE_NUMERALS).cast("string"), unit(m))))


def count_values(text: Column) -> Column:
    """All counts of a text, native numerals from one to ten included."""
    return F.array_union(counts(text), native_counts(text))
