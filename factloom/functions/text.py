"""String expressions with Unicode white space, Unicode digits and ordered matches, all built-in. Null texts give null."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_END = r"(?U)(?<=[.!?。])\s+|\n+"
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
OTHER_DIGITS = [c for c in map(chr, range(0x80, sys.maxunicode)) if unicodedata.category(c) == "Nd"]
MATCHES = "array<struct<at:int,span:string>>"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(WHITE))


def ascii_digits(text: Column) -> Column:
    """Decimal digits of all scripts (full-width ones and the like) as 0 to 9; all else as it is."""
    plain = F.translate(text, "".join(OTHER_DIGITS), "".join(str(unicodedata.digit(c)) for c in OTHER_DIGITS))
    return F.when(text.rlike(r"[\p{Nd}&&[^0-9]]"), plain).otherwise(text)


def sentences(text: Column) -> Column:
    """Non-empty stripped sentences: after . ! ? 。 and white space, or at line breaks."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), stripped), lambda s: s != "")


def found(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """All matches (or one group of each) in order."""
    return F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(group))


def matches(text: Column, pattern: str, masked: Callable[[Column], Column] = lambda x: x) -> Column:
    """All matches in order with their places (characters before them) in the text.

    A match is the first occurrence of its characters after the match before, provided that they match wherever they stand. For a pattern that looks back, masked
    must change both texts and matches so that this holds."""
    start = F.struct(F.lit(0).alias("to"), F.array().cast(MATCHES).alias("out"))

    def step(seen: Column, acc: Column, span: Column) -> Column:
        at = F.call_function("locate", masked(span), seen, acc["to"] + 1) - 1
        return F.element_at(F.transform(F.array(at), lambda x: F.struct((x + F.length(span)).alias("to"), F.array_append(acc["out"], F.struct(x.alias("at"), span.alias("span"))).alias("out"))), 1)

    return bound(masked(text), lambda seen: F.aggregate(found(text, pattern), start, lambda acc, span: step(seen, acc, span), lambda acc: acc["out"]))


def place(part: Column, text: Column, first: Column | None = None) -> Column:
    """Where part stands in text at or after a place, counted from 1; 0 if it does not."""
    return F.call_function("locate", part, text, F.lit(1) if first is None else first)


def quoted(text: Column) -> Column:
    """text as a pattern that matches itself."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores as it needs not to be one of taken (case does not tell names apart)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it, also within functions of arrays."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def replaced_once(text: Column, old: str, new: str) -> Column:
    """The first occurrence replaced; null if there is none."""
    at = F.locate(old, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + len(old), F.length(text))))


def linear(x: Column, easy: float, hard: float) -> Column:
    """100 up to easy, 0 from hard on, a straight line between."""
    return F.when(x <= easy, 100.0).when(x >= hard, 0.0).otherwise(100.0 * (1 - (x - easy) / (hard - easy)))


def escaped(text: Column) -> Column:
    """For HTML; & first."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once a row: a generator of one row keeps the optimizer from copying their expressions into all that use them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))
