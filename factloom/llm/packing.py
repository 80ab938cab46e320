"""Packing by power-of-two decomposition.

Each document's ids (with the end id) are cut into whole blocks of the capacity and then into pieces by the
binary digits of the rest, longest first. Every piece is a sequence of its own, so none crosses documents and
none is padded; pieces of one length share a bucket. No row moves between tasks.

Null or empty texts give one piece, the end id. Null ids and repeated rows are packed like any others; extra
columns are not read. Of an empty table the result is empty. Sequence ids are unique; sorted, they run bucket
by bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tokens import word_table
from factloom.llm.words import portions


MOST = 1 << 15  # tokens of a sequence


def lengths(n: int, capacity: int) -> list[int]:
    """Whole blocks, then the binary digits of the rest."""
    return [capacity] * (n // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (n % capacity) >> b & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, bucket (log2 of length), sequence_id, offset (always 0)."""
    if capacity < 1 or capacity & (capacity - 1) or capacity > MOST:
        raise ValueError(f"the capacity is a power of two up to {MOST}: the class of a length takes four binary digits of a sequence id")
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "bucket"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer)
        for part in portions(batches, most=1 << 20, cache="word_table"):
            rows: list[tuple] = []
            found, first = table.rows(part.column(1))
            written, to = found.astype("<u4", copy=False).tobytes(), (4 * first).tolist()
            for doc, a, b in zip(part.column(0).to_pylist(), to, to[1:], strict=False):
                ids = written[a:b] + end
                n, at = len(ids) // 4, 0
                for k in lengths(n, capacity):
                    rows.append((doc, at, k, ids[4 * at : 4 * (at + k)], n, k.bit_length() - 1))
                    at += k
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = cut.mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int")
    # the bucket stands in the four highest bits: sequences of one length are neighbours in the order of their ids
    return cut.withColumn("sequence_id", F.monotonically_increasing_id() + F.shiftleft(F.col("bucket").cast("long"), 59)).withColumn("offset", F.lit(0).cast("long"))
