"""Korean notices written from the columns of `orders`, with an easy text that may be distorted.

The reference tables hold no Korean text; this gives the gate something to judge at any scale. The case number picks what the easy text gets wrong:
0 nothing, 1 amount, 2 date, 3 inclusive date, 4 negation, 5 operator, 6 upper bound, 7 agency, 8 an invented agency, 9 count, 10 telephone,
11 nothing (the year is left out).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import computed

CASES = 12
REF_DATE = "2026-07-01"


def _s(c: Column) -> Column:
    return c.cast("string")


def facts(orders: DataFrame, case: int | Column | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    """case: the case of all orders, or of each; else it follows from the key. o_orderkey, case, amount, y, m, d, age, n, phone, wage, and columns that are kept."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        "o_orderkey",
        *kept,
        (key % CASES if case is None else F.lit(case)).cast("int").alias("case"),
        F.floor("o_totalprice").cast("long").alias("amount"),
        F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"),
        (cust % 60 + 20).cast("int").alias("age"),
        (cust % 900 + 5).cast("int").alias("n"),
        F.concat(F.lit("031-"), _s(key % 9000 + 1000), F.lit("-"), _s(cust % 9000 + 1000)).alias("phone"),
        (cust % 300 * 1000 + 30000).cast("long").alias("wage"),
    )


def pairs(orders: DataFrame, case: int | Column | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    """o_orderkey, case, source_text, easy_text, ref_date, and columns that are kept. case: as in facts."""
    f = facts(orders, case, kept)
    c = F.col("case")
    won = lambda x: F.concat(F.format_number(x, 0), F.lit("원"))
    day = lambda d: F.concat(_s(F.col("y")), F.lit("년 "), _s(F.col("m")), F.lit("월 "), _s(d), F.lit("일"))
    source = F.concat(
        F.lit("대금 "), won(F.col("amount")), F.lit("을 "), day(F.col("d")), F.lit("까지 강서구청에 납부하시기 바랍니다. 만 "), _s(F.col("age")),
        F.lit("세 이상은 대상에서 제외됩니다. 소득이 "), won(F.col("wage")), F.lit(" 미만이면 지원합니다. 정원은 "), _s(F.col("n")), F.lit("명입니다. 문의 "), F.col("phone"),
    )
    wrong_day = F.when(F.col("d") > 20, F.col("d") - 7).otherwise(F.col("d") + 7)
    when = F.when(c == 2, day(wrong_day)).when(c == 11, F.concat(_s(F.col("m")), F.lit("월 "), _s(F.col("d")), F.lit("일"))).otherwise(day(F.col("d")))
    easy = F.concat(
        F.lit("돈 "), won(F.when(c == 1, F.col("amount") + 7).otherwise(F.col("amount"))), F.lit("을 "), when, F.when(c == 3, " 전에 ").otherwise("까지 "),
        F.when(c == 7, "송파구청").otherwise("강서구청"), F.lit("에 내세요. 만 "), _s(F.col("age")), F.lit("세 "), F.when(c == 5, "이하").otherwise("이상"), F.lit("은 대상에서 "),
        F.when(c == 4, "포함됩니다").otherwise("제외됩니다"), F.lit(". 소득이 "), won(F.col("wage")), F.when(c == 6, " 이하").otherwise(" 미만"), F.lit("이면 도와줘요. 정원은 "),
        _s(F.when(c == 9, F.col("n") + 1000).otherwise(F.col("n"))), F.lit("명이에요."), F.when(c == 10, "").otherwise(F.concat(F.lit(" 문의 "), F.col("phone"))),
        F.when(c == 8, " 자세한 내용은 국민건강보험공단에 문의하세요.").otherwise(""),
    )
    # the texts are put together once a row, however often they are used
    return computed(f, {"source_text": source, "easy_text": easy}).select("o_orderkey", "case", "source_text", "easy_text", F.lit(REF_DATE).cast("date").alias("ref_date"), *kept)


CHUNKS = ("경", "조", "억", "만", "")  # of four digits each


def spelled(number: Column) -> Column:
    """A whole number above 0 in Korean numerals."""
    digits = F.array(*(F.lit(d) for d in " 일이삼사오육칠팔구"))

    # digits are read off, since quotients of decimals are rounded to six places
    written = F.lpad(number.cast("decimal(38,0)").cast("string"), 38, "0")

    def part(first: int) -> Column:
        places = enumerate(("천", "백", "십", ""))
        return F.concat(*(F.when(d > "0", F.concat(F.get(digits, d.cast("int")), F.lit(unit))).otherwise("") for i, unit in places for d in [F.substring(written, first + i, 1)]))

    pieces = [(39 - 4 * (len(CHUNKS) - i), unit) for i, unit in enumerate(CHUNKS)]
    return F.concat(*(F.when(F.substring(written, first, 4) > "0000", F.concat(part(first), F.lit(unit))).otherwise("") for first, unit in pieces))


def spelled_pairs(orders: DataFrame) -> DataFrame:
    """o_orderkey, amount, source_text, easy_text, ref_date: amounts of about 10^11 in Korean numerals; of odd keys the easy text names another one."""
    f = orders.select("o_orderkey", (F.floor("o_totalprice").cast("long") * 1000003 + F.col("o_custkey")).alias("amount"))
    other = F.when(F.col("o_orderkey") % 2 == 1, F.col("amount") + 10**9).otherwise(F.col("amount"))
    texts = {"source_text": F.concat(F.lit("보증금 "), spelled(F.col("amount")), F.lit("원을 내야 합니다.")), "easy_text": F.concat(F.lit("돈 "), spelled(other), F.lit("원을 내요."))}
    return computed(f, texts).withColumn("ref_date", F.lit(REF_DATE).cast("date"))


def wide_pairs(orders: DataFrame) -> DataFrame:
    """o_orderkey, source_text, easy_text, ref_date: dates, amounts and counts in full-width digits, in both texts or in the source alone; of keys divisible by 3 the easy text has another date."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    wide = lambda c: F.translate(c, "0123456789", "０１２３４５６７８９")
    date = lambda d: F.concat(_s(F.year(d)), F.lit("년 "), _s(F.month(d)), F.lit("월 "), _s(F.dayofmonth(d)), F.lit("일까지 "))
    tail = F.concat(_s(F.floor("o_totalprice").cast("long")), F.lit("원을 내고 "), _s(F.col("o_custkey") % 900 + 5), F.lit("명이 와요."))
    easy = F.concat(date(F.when(key % 3 == 0, F.date_add(day, 40)).otherwise(day)), tail)
    texts = {"source_text": wide(F.concat(date(day), tail)), "easy_text": F.when(key % 2 == 0, wide(easy)).otherwise(easy)}
    return computed(orders.select("o_orderkey", "o_orderdate", "o_totalprice", "o_custkey"), texts).select("o_orderkey", "source_text", "easy_text", F.lit(REF_DATE).cast("date").alias("ref_date"))


BENEFIT_CASES = 9


def benefit_pairs(orders: DataFrame) -> DataFrame:
    """o_orderkey, case, source_text, easy_text, ref_date: another notice, a numbered list with dates in points, a telephone in brackets and a bound on income.

    case: 0 the date with hyphens, 1 another amount, 2 the telephone with other separators, 3 no telephone, 4 an operator that takes in its bound, 5 a refusal turned to a grant,
    6 the year left out, 7 another office, 8 the amount in Korean numerals."""
    key, cust, day = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    f = orders.select(
        "o_orderkey", (key % BENEFIT_CASES).cast("int").alias("case"), (F.floor("o_totalprice").cast("long") + 1).alias("amount"), (cust % 300 * 1000 + 1030000).cast("long").alias("wage"),
        F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d"), _s(key % 900 + 100).alias("middle"), _s(cust % 9000 + 1000).alias("last"),
    )
    c, won = F.col("case"), lambda x: F.concat(F.format_number(x, 0), F.lit("원"))
    joined = lambda by: F.concat_ws(by, *(_s(F.col(x)) for x in ("y", "m", "d")))
    source = F.concat(
        F.lit("[지원금 안내]\n1. 기한: "), joined("."), F.lit(" 까지\n2. 지원금: "), won(F.col("amount")), F.lit("\n3. 소득 "), won(F.col("wage")), F.lit(" 초과 가구는 신청이 불가합니다.\n4. 접수: 행복동주민센터, 전화 (02)"),
        F.col("middle"), F.lit("-"), F.col("last"),
    )
    when = F.when(c == 0, joined("-")).when(c == 6, F.concat(_s(F.col("m")), F.lit("월 "), _s(F.col("d")), F.lit("일"))).otherwise(joined("."))
    money = F.when(c == 1, won(F.col("amount") + 30)).when(c == 8, F.concat(spelled(F.col("amount")), F.lit("원"))).otherwise(won(F.col("amount")))
    phone = F.when(c == 2, F.concat(F.lit("전화는 02-"), F.col("middle"), F.lit(" "), F.col("last"))).when(c == 3, "").otherwise(F.concat(F.lit("전화는 (02)"), F.col("middle"), F.lit("-"), F.col("last")))
    easy = F.concat(
        F.lit("지원금은 "), money, F.lit("이에요. "), when, F.lit(" 까지 오세요. 소득 "), won(F.col("wage")), F.when(c == 4, " 이상").otherwise(" 초과"), F.lit(" 가구는 신청이 "), F.when(c == 5, "가능").otherwise("불가"),
        F.lit("합니다. "), F.when(c == 7, "사랑동주민센터").otherwise("행복동주민센터"), F.lit("로 오세요. "), phone,
    )
    return computed(f, {"source_text": source, "easy_text": easy}).select("o_orderkey", "case", "source_text", "easy_text", F.lit(REF_DATE).cast("date").alias("ref_date"))
