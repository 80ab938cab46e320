"""Documents into typed blocks: headings, list items, paragraphs; one projection, no row moves.

Null, empty and white-space texts are errors (parse_error), never empty documents. Rows are cut one by one, repeated ones too; an empty table gives an empty result. Columns of the input called
blocks or parse_error give way to the results, all others pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import computed, stripped

# Private-use characters that mark block ends and typed lines. Where a text has them itself they are written as MARK and a letter, and put back in the blocks.
END, TYPED, MARK = "\ue000", "\ue001", "\ue002"
WRITTEN = ((MARK, MARK + "c"), (END, MARK + "a"), (TYPED, MARK + "b"))
HEADING, ITEM = r"^(#{1,6})[ \t]+\S", r"^(?:[-*•]|\d+[.)])(?U:\s)+\S"
BLOCK = "array<struct<ord:int,type:string,level:int,text:string,confidence:double>>"


def _hidden(text: Column) -> Column:
    out = text
    for plain, written in WRITTEN:
        out = F.replace(out, F.lit(plain), F.lit(written))
    return F.when(text.rlike(f"[{END}{TYPED}{MARK}]"), out).otherwise(text)


def _shown(text: Column) -> Column:
    out = text
    for plain, written in reversed(WRITTEN):
        out = F.replace(out, F.lit(written), F.lit(plain))
    return F.when(text.contains(MARK), out).otherwise(text)


def blocks(text: Column) -> Column:
    """Blocks of a text in order; null for empty or white-space texts (see parse_error). text should be a column, as it is used twice."""

    def line(plain: Column) -> Column:
        heading = F.concat(F.lit(END + TYPED + "h"), F.length(F.regexp_extract(plain, HEADING, 1)).cast("string"), stripped(F.ltrim(plain, F.lit("#"))), F.lit(END))
        item = F.concat(F.lit(END + TYPED + "i0"), plain, F.lit(END))
        first = F.substring(plain, 1, 1)
        return (
            F.when(plain == "", END)
            .when((first == "#") & plain.rlike(HEADING), heading)
            .when((first.isin("-", "*", "•") | first.between("0", "9")) & plain.rlike(ITEM), item)
            .otherwise(F.concat(plain, F.lit("\n")))
        )

    lines = F.transform(F.split(F.ltrim(_hidden(text), F.lit("\ufeff")), "\n"), stripped)
    pieces = F.filter(F.split(F.array_join(F.transform(lines, line), ""), END), lambda p: p != "")

    def block(p: Column, i: Column) -> Column:
        typed = p.startswith(TYPED)
        kind = F.when(~typed, "paragraph").when(F.substring(p, 2, 1) == "h", "heading").otherwise("list_item")
        level = F.when(typed, F.substring(p, 3, 1).cast("int")).otherwise(0)
        body = F.when(typed, F.substring(p, F.lit(4), F.length(p))).otherwise(F.rtrim(p, F.lit("\n")))
        return F.struct(i.alias("ord"), kind.alias("type"), level.alias("level"), _shown(body).alias("text"), F.lit(1.0).alias("confidence"))

    return F.when(stripped(F.ltrim(text, F.lit("\ufeff"))) != "", F.transform(pieces, block).cast(BLOCK))


def parsed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds blocks and parse_error: a document without text is an error, never an empty document."""
    kept = [c for c in docs.columns if c.lower() not in ("blocks", "parse_error")]
    out = computed(docs if "blocks" not in docs.columns else docs.select(*kept), {"blocks": blocks(F.col(text_col))})
    return out.select(*kept, "blocks", F.when(F.col("blocks").isNull(), "empty document").alias("parse_error"))


def block_text(column: Column) -> Column:
    """The text of blocks: theirs, joined by line breaks."""
    return F.array_join(F.transform(column, lambda b: b["text"]), "\n")
