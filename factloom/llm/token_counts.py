"""Token counts by separator scan over flat token files.

A token file is nothing but little-endian token ids of 2 or 4 bytes, each document's followed by the separator id; there is
no index. Files are cut into blocks that tasks read by their byte ranges and search for separators in numpy, each block once. A block
reports the lengths of the documents that end in it, the first of them only as far as it lies in the block, and what follows its last separator. A prefix scan over the
blocks of each file carries what earlier blocks left open, so a document may span any number of blocks. The scan sees two numbers a block, not the lengths, and has two levels:
within runs of RUN blocks, then over the runs of a file. So a file of any size is no large group.

Documents without tokens count 0. Tokens after the last separator are a document without end, reported with `ended` false. Empty files have no documents; files whose size is
no multiple of the id width raise an error. Writing: null and empty texts give a separator alone; the separator's own string in a text is
ordinary text. Null and repeated ids are counted row by row. Ranges of local files are read directly, of others by pyarrow's file systems.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.store import new_folder, written
from factloom.llm.tokens import word_ids
from factloom.llm.words import portions

SEPARATOR = 49407  # the end-of-text id of the default tokenizer
BLOCK_TOKENS = 1 << 20
RUN = 1 << 10  # blocks that are scanned together


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, separator: int = SEPARATOR) -> None:
    """Token files of 2-byte ids, one for each partition of docs, its rows in order; docs: text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer, "<u2", True)
        for part in portions(batches, cache="word_ids"):
            yield pa.RecordBatch.from_arrays([pa.array([ids_of.text(t) for t in part.column(0).to_pylist()], pa.binary())], ["ids"])

    ids = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(encode, "ids binary")
    # Spark's text writer puts bytes as they are and ends each row with its line separator: here the separator id
    end = int(separator).to_bytes(2, "little").decode("latin-1")
    ids.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", end).option("encoding", "ISO-8859-1").option("compression", "none").text(path)


def _bytes(path: str, at: int, size: int) -> bytes:
    """A range of a file: of local ones directly, of others by pyarrow's file systems."""
    if path.startswith("file:") or path.startswith("/"):
        from urllib.parse import unquote

        with open("/" + unquote(path.removeprefix("file:")).lstrip("/"), "rb") as f:
            f.seek(at)
            return f.read(size)
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        return f.read_at(size, at)


def carried(parts: DataFrame, within: list[str], order: str) -> DataFrame:
    """parts: ends (documents that end in a part), open (tokens after the last end, or all). Adds first (ends before the part, in its group) and carried (tokens that the parts before leave open)."""
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    # parts up to the next one with an end share a running count of such parts
    parts = parts.withColumn("stretch", F.coalesce(F.sum((F.col("ends") > 0).cast("long")).over(before), F.lit(0)))
    same = Window.partitionBy(*within, "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    opener = F.coalesce(F.last(F.when(F.col("ends") > 0, F.col("open")), ignorenulls=True).over(before), F.lit(0))
    return parts.withColumn("carried", opener + F.coalesce(F.sum(F.when(F.col("ends") == 0, F.col("open")).otherwise(0)).over(same), F.lit(0)))


def scan(spark: SparkSession, path: str, separator: int = SEPARATOR, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document of the files under path: file, ordinal (from 0), n_tokens (without the separator), ended."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select(F.col("path").alias("file"), "length")
    size = block_tokens * width
    blocks = files.withColumn("checked", F.when(F.col("length") % width != 0, F.raise_error(F.concat(F.lit("no whole tokens: "), F.col("file"))).cast("long")).otherwise(F.col("length")))
    blocks = blocks.where("checked > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("checked") - 1) / size))).alias("block"))
    blocks = blocks.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(_bytes(file, block * size, min(size, length - block * size)), f"<u{width}")
                ends = np.flatnonzero(ids == separator)
                within = np.diff(np.concatenate([[-1], ends])) - 1
                last = int(ends[-1]) + 1 if len(ends) else 0
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
                row = [[file], [block], [len(ends)], [len(ids) - last], [within], [(block + 1) * size >= length]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], ["file", "block", "ends", "open", "lengths", "final"])

    seen = written(blocks.mapInArrow(search, "file string, block long, ends long, open long, lengths array<long>, final boolean"), "token-blocks")
    narrow = seen.select("file", "block", "ends", "open", F.floor(F.col("block") / RUN).alias("run"))
    inner = carried(narrow, ["file", "run"], "block")
    runs = narrow.groupBy("file", "run").agg(F.sum("ends").alias("ends"), F.max(F.when(F.col("ends") > 0, F.col("block"))).alias("last"))
    tails = narrow.join(runs.select("file", "run", "last"), ["file", "run"]).where(F.col("last").isNull() | (F.col("block") >= F.col("last"))).groupBy("file", "run").agg(F.sum("open").alias("open"))
    outer = carried(runs.join(tails, ["file", "run"]), ["file"], "run").select("file", "run", F.col("first").alias("run_first"), F.col("carried").alias("run_carried"))
    # what comes before the run reaches a block if no document ends in between
    reach = F.when(F.col("first") == 0, F.col("run_carried")).otherwise(0)
    places = inner.join(outer, ["file", "run"]).select("file", "block", (F.col("first") + F.col("run_first")).alias("first"), (F.col("carried") + reach).alias("carried"))
    seen = seen.join(places, ["file", "block"])
    tail = F.when(F.col("ends") > 0, F.col("open")).otherwise(F.col("carried") + F.col("open"))
    document = lambda ordinal, tokens, ended: F.struct(ordinal.alias("ordinal"), tokens.alias("n_tokens"), F.lit(ended).alias("ended"))
    found = F.transform("lengths", lambda x, i: document(F.col("first") + i, x + F.when(i == 0, F.col("carried")).otherwise(0), True))
    rest = F.when(F.col("final") & (tail > 0), F.array(document(F.col("first") + F.col("ends"), tail, False)))
    return seen.select("file", F.inline(F.concat(found, F.coalesce(rest, F.slice(found, 1, 0)))))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Writes the token files of docs and scans them: doc_id, file_no, ordinal, n_tokens.

    The files carry no ids: a row is known by its place, the partition that wrote its file and its turn there. So docs must be read in the same order each time, as files are;
    a row without its document raises an error."""
    path = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs.select(F.col(text_col).alias("text")), path, tokenizer)
    found = scan(docs.sparkSession, path)
    found = found.select(F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long").alias("file_no"), "ordinal", "n_tokens")
    place = F.monotonically_increasing_id()
    ids = docs.select(F.col(id_col).alias("doc_id"), F.shiftright(place, 33).alias("file_no"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("ordinal"))
    lost = F.raise_error(F.lit("the table was read in another order than it was written")).cast("long")
    return ids.join(found.hint("merge"), ["file_no", "ordinal"], "left").select("doc_id", "file_no", "ordinal", F.coalesce("n_tokens", lost).alias("n_tokens"))
