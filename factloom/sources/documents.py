"""Readers: text, markdown, PDF and HWPX files, paired corpora, word lists and package lists (file trees: trees.py). Bad files become rows with parse_error.

Empty files are errors (empty document), empty folders and lists give no rows. Files are read one by one, so equal ones give a row each.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import stripped
from factloom.operators.segment import BLOCK, blocks

# Kinds of files, and how sure their text is.
TEXT_MIMES, PDF, HWPX, HWP = ("text/plain", "text/markdown"), "application/pdf", "application/hwp+zip", "application/x-hwp"
BY_SUFFIX = {"txt": "text/plain", "md": "text/markdown", "pdf": PDF, "hwpx": HWPX, "hwp": HWP}
CONFIDENCE = {"pypdf": 1.0, "pdfminer": 0.6, "hwpx": 0.7}
PAIR = (
    "pair_id string, source_text string, easy_text string, source_license struct<type:string,attribution:string,url:string,date_fetched:string>, ker_score double,"
    " ker_rule_violations array<string>, fidelity_checks struct<numbers:boolean,dates:boolean,amounts:boolean,deadlines:boolean,eligibility:boolean,entities:boolean,distortions:array<string>>,"
    " pictogram_refs array<struct<concept:string,set:string,glyph_id:string,caption:string>>, reviewer string, review_date string"
)


def decoded(content: bytes) -> str:
    """UTF-8, else CP949; ValueError if neither."""
    for code in ("utf-8", "cp949"):
        try:
            return content.decode(code)
        except UnicodeDecodeError:
            pass
    raise ValueError("neither utf-8 nor cp949")


def hwpx_text(content: bytes) -> str:
    """Paragraphs of the sections of a HWPX archive (zipped XML), one a line."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            found = [(re.fullmatch(r"Contents/section(\d+)\.xml", x), x) for x in z.namelist()]
            names = [x for _, x in sorted((int(m[1]), x) for m, x in found if m)]  # section10 comes after section9
            lines = [
                "".join(t.text or "" for t in p.iter() if t.tag.rpartition("}")[2] == "t")
                for name in names
                for p in ElementTree.fromstring(z.read(name)).iter()
                if p.tag.rpartition("}")[2] == "p"
            ]
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
        raise ValueError(f"no HWPX file: {e}") from e
    return "\n".join(lines)


def pdf_text(content: bytes) -> tuple[str, str]:
    """Text of all pages, and the library that gave it."""
    reasons = []
    try:
        import pypdf

        text = "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages)
        if text.strip():
            return text, "pypdf"
    except Exception as e:  # noqa: BLE001  any failure of the first reader leaves it to the second
        reasons.append(repr(e))
    try:
        from pdfminer.high_level import extract_text

        text = extract_text(io.BytesIO(content))
        if text.strip():
            return text, "pdfminer"
    except Exception as e:  # noqa: BLE001
        reasons.append(repr(e))
    raise ValueError("no text in the PDF: " + "; ".join(reasons))


def _read(content: bytes, mime: str) -> tuple[str, str, float, str | None]:
    """Text, parser, confidence, and what went wrong."""
    try:
        if mime in TEXT_MIMES:
            return decoded(content), "text", 1.0, None
        if mime == PDF:
            text, parser = pdf_text(content)
            return text, parser, CONFIDENCE[parser], None
        if mime == HWPX:
            text = hwpx_text(content)
            return text, "hwpx", CONFIDENCE["hwpx"], None if text.strip() else "empty document"
        return "", "", 0.0, "unsupported format: legacy HWP" if mime == HWP else f"unsupported type: {mime}"
    except ValueError as e:
        return "", "", 0.0, str(e)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All files under path: path, source_mime, text, parser, blocks, parse_error. A file that cannot be read has parse_error and no blocks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.concat(F.lit("?/"), suffix)
    for k, v in BY_SUFFIX.items():
        mime = F.when(suffix == k, v).otherwise(mime)

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [_read(c, m) for c, m in zip(p.content, p.source_mime, strict=True)]
            yield pd.DataFrame({"path": p.path, "source_mime": p.source_mime, "text": [g[0] for g in got], "parser": [g[1] for g in got], "confidence": [g[2] for g in got], "parse_error": [g[3] for g in got]})

    out = files.select("path", mime.alias("source_mime"), "content").mapInPandas(parse, "path string, source_mime string, text string, parser string, confidence double, parse_error string")
    lines = F.filter(F.transform(F.split("text", r"\R"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    plain = F.transform(lines, lambda s, i: F.struct(i.alias("ord"), F.lit("paragraph").alias("type"), F.lit(0).alias("level"), s.alias("text"), F.col("confidence").alias("confidence"))).cast(BLOCK)
    made = F.when(F.col("parse_error").isNull(), F.when(F.col("source_mime").isin(*TEXT_MIMES), blocks(F.col("text"))).otherwise(plain))
    out = out.withColumn("blocks", made)
    return out.withColumn("parse_error", F.coalesce("parse_error", F.when(F.col("blocks").isNull(), "empty document"))).drop("confidence")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines corpus of pairs; malformed lines and missing texts fail."""
    rows = spark.read.schema(PAIR).option("mode", "FAILFAST").json(path)
    for c in ("pair_id", "source_text", "easy_text"):
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing")).cast("string")).otherwise(F.col(c)))
    return rows


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines, without blanks and # comments."""
    line = stripped(F.col("value"))
    return spark.read.text(path).select(line.alias("term")).where((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of packages: Name, Version, License."""
    return spark.read.schema("Name string, Version string, License string").option("multiLine", "true").json(path)
