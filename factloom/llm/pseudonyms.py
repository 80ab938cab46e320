"""Format-preserving Feistel pseudonyms for personal numbers and dates, in built-in functions only.

Validated values are permuted by a keyed Feistel network over exactly the values of their format, so that a
pseudonym is again a valid value of that format, equal values stay equal across documents, and different values
stay different:

* card: 13 to 19 digits, four groups of four, or groups of 4, 6 and 5, that pass the Luhn check; the check digit is made anew
* phone: +1 (ddd) ddd-dddd and the like, also without +1: all ten digits; other numbers with +: what follows the first three digits (of +82: what follows the
  area); Korean numbers that begin with 0: what follows the area
* ip: four numbers up to 255
* ssn: ddd-dd-dddd within the ranges that are issued
* date: yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy that exist, in the 400 years from 1800 on (146,097 days) for those in them, else in all other years from 1 to 9999
* email: letters and digits of the part before @ are replaced by a keyed digest of it (one way)

What is not valid (a wrong check digit, 31 February) stays as it is. Null texts stay null, empty ones empty; null ids,
and repeated rows pass, further columns are not part of the result. No row moves between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?![0-9A-Za-z])|\+[2-9](?:[ .-]?\(?\d\)?){7,14}(?![0-9A-Za-z])|(?<![0-9A-Za-z.+-])(?:(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}|(?:\(0\d{1,2}\)[ .-]?|0\d{1,2}[ .-])\d{3,4}[ .-]\d{4}|01[016-9]\d{7,8})(?![0-9A-Za-z])(?![.-]\d)",
    "date": r"(?<![0-9A-Za-z.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![0-9A-Za-z])(?![.-]\d)",
    "ssn": r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z])(?!-\d)",
    "ip": r"(?<![0-9A-Za-z.])\d{1,3}(?:\.\d{1,3}){3}(?![0-9A-Za-z])(?!\.\d)",
    "card": r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![0-9A-Za-z])",
}
ANY = "|".join(FORMS.values())


def _random(key: str, *parts: Column) -> Column:
    """52 keyed bits as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 256), 1, 13), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """A keyed permutation of the pairs (left < a, right < b) as a struct l, r."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        l = F.when(even, F.pmod(acc["l"] + _random(key, F.lit(kind), i, a, b, acc["r"]), a)).otherwise(acc["l"])
        r = F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + _random(key, F.lit(kind), i, a, b, acc["l"]), b))
        return F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _bound(x: Column, f) -> Column:
    """f of x, with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _digits(n: Column, width: Column) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """Another string of as many digits."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), a).cast("long"), F.substring(digits, a + 1, n - a).cast("long")
    mod = lambda w: F.pow(F.lit(10.0), w).cast("long")
    return _bound(feistel(key, kind, left, right, mod(a), mod(n - a)), lambda s: F.concat(_digits(s["l"], a), _digits(s["r"], n - a)))


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits where every second one from the right, beginning with the last (0) or the one before (1), is doubled."""
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when((n - i) % 2 == doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)


def _filled(form: Column, digits: Column) -> Column:
    """form with its digits replaced in turn."""

    def step(acc: Column, i: Column) -> Column:
        c = F.substring(form, i, F.lit(1))
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["k"], F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.length(form)), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step)["out"]


def _card(key: str, m: Column) -> Column:
    def of(digits: Column) -> Column:
        payload = permuted_digits(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
        full = _bound(payload, lambda p: F.concat(p, F.pmod(-luhn_sum(p, 0), F.lit(10)).cast("string")))
        return F.when(luhn_sum(digits, 1) % 10 == 0, _filled(m, full))

    return _bound(F.regexp_replace(m, r"\D", ""), of)


def _phone(key: str, m: Column) -> Column:
    def of(digits: Column) -> Column:
        kept = F.when(m.startswith("+"), F.regexp_extract(digits, r"^(?:1|82(?:2|[13-7]\d)|\d{3})", 0)).otherwise(F.regexp_extract(digits, r"^(?:02|0\d\d)?", 0))
        return _bound(kept, lambda k: F.concat(k, permuted_digits(key, "phone", F.substring(digits, F.length(k) + 1, F.length(digits)))))

    return _filled(m, _bound(F.regexp_replace(m, r"\D", ""), of))


def _ip(key: str, m: Column) -> Column:
    part = [F.split(m, r"\.")[i].cast("int") for i in range(4)]
    two = F.lit(65536).cast("long")
    s = feistel(key, "ip", part[0] * 256 + part[1], part[2] * 256 + part[3], two, two)
    text = _bound(s, lambda x: F.concat_ws(".", F.floor(x["l"] / 256).cast("string"), (x["l"] % 256).cast("string"), F.floor(x["r"] / 256).cast("string"), (x["r"] % 256).cast("string")))
    return F.when((part[0] <= 255) & (part[1] <= 255) & (part[2] <= 255) & (part[3] <= 255), text)


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.split(m, "-")[i].cast("int") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    s = feistel(key, "ssn", area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"))
    text = _bound(s, lambda x: F.concat_ws("-", _digits(x["l"] + 1 + (x["l"] >= 665).cast("int"), F.lit(3)), _digits(F.floor(x["r"] / 9999) + 1, F.lit(2)), _digits(x["r"] % 9999 + 1, F.lit(4))))
    return F.when(valid, text)


FIRST_DAY = "1800-01-01"
A_DATES, B_DATES = 189, 773  # 146,097 days
EARLIEST, BEFORE_FIRST = "0001-01-01", 657071  # the days before FIRST_DAY
A_OTHER, B_OTHER = 762, 4601  # those and the days from 2200 to 9999


def _date(key: str, m: Column) -> Column:
    def of(how: str) -> Column:
        day = F.try_to_timestamp(m, F.lit(how)).cast("date")
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        s = feistel(key, "date", F.floor(n / B_DATES), F.pmod(n, F.lit(B_DATES)), F.lit(A_DATES).cast("long"), F.lit(B_DATES).cast("long"))
        new = _bound(s, lambda x: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (x["l"] * B_DATES + x["r"]).cast("int")), how))
        # the days before and after those years, as if they followed each other
        k = F.datediff(day, F.lit(EARLIEST).cast("date")) - F.when(n >= 0, A_DATES * B_DATES).otherwise(0)
        o = feistel(key, "other date", F.floor(k / B_OTHER), F.pmod(k, F.lit(B_OTHER)), F.lit(A_OTHER).cast("long"), F.lit(B_OTHER).cast("long"))
        at = _bound(o, lambda x: (x["l"] * B_OTHER + x["r"]).cast("int"))
        other = _bound(at, lambda x: F.date_format(F.date_add(F.lit(EARLIEST).cast("date"), x + F.when(x >= BEFORE_FIRST, A_DATES * B_DATES).otherwise(0)), how))
        return F.when(n.between(0, A_DATES * B_DATES - 1), new).when(day.isNotNull(), other)

    return F.when(m.contains("."), of("dd.MM.yyyy")).when(m.contains("/"), of("MM/dd/yyyy")).otherwise(of("yyyy-MM-dd"))


def _email(key: str, m: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    h = F.sha2(F.concat(F.lit(key + "|email|"), F.lower(m)), 256)

    def step(i: Column) -> Column:
        c = F.substring(local, i, F.lit(1))
        r = F.conv(F.substring(h, F.pmod(i * 2, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int") + i
        return F.when(c.between("0", "9"), (r % 10).cast("string")).when(F.lower(c).between("a", "z"), F.chr(97 + r % 26)).otherwise(c)

    return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(local)), step), ""), F.lit("@"), F.substring_index(m, "@", -1))


def _kind(m: Column) -> Column:
    out = F.when(m.contains("@"), "email").when(m.rlike(f"^(?:{FORMS['phone']})$"), "phone")
    return out.when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})$"), "date").when(m.contains("."), "ip").otherwise("card")


def pseudonym(m: Column, key: str) -> Column:
    """Of one value that a pattern found: a struct kind, new; new is null if the value is not valid."""
    kind = _kind(m)
    new = F.when(kind == "email", _email(key, m)).when(kind == "phone", _phone(key, m)).when(kind == "ssn", _ssn(key, m)).when(kind == "date", _date(key, m)).when(kind == "ip", _ip(key, m)).otherwise(_card(key, m))
    return F.struct(kind.alias("kind"), new.alias("new"))


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_found, and n_<kind> for each kind. key: a secret; who has it can undo all pseudonyms but those of e-mail addresses."""
    if not key:
        raise ValueError("pseudonyms need a secret key")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # \d\d and @ are looked for first: most texts hold neither
    rows = rows.withColumn("values", F.when(F.col("text").rlike(r"\d\d|@"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    rows = rows.withColumn("values", F.when(F.size("values") > 0, F.col("values")))
    rows = rows.withColumn("new", F.transform("values", lambda m: pseudonym(m, key)))
    pieces = F.split("text", ANY, -1)
    ends = F.zip_with("values", "new", lambda m, n: F.coalesce(n["new"], m))
    # one piece more than values; the last has nothing after it
    joined = F.array_join(F.zip_with(pieces, ends, lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), "")
    valid = F.filter("new", lambda n: n["new"].isNotNull())
    count = lambda k: F.coalesce(F.size(F.filter(valid, lambda n: n["kind"] == k)), F.lit(0)).cast("long")
    out = rows.withColumn("text", F.when(F.col("values").isNull(), F.col("text")).otherwise(joined))
    return out.select("doc_id", "text", F.when(F.col("values").isNull(), 0).otherwise(F.size(valid)).cast("long").alias("n_found"), *(F.when(F.col("values").isNull(), F.lit(0)).otherwise(count(k)).cast("long").alias(f"n_{k}") for k in FORMS))
