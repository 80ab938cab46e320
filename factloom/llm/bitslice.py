"""Exact top-k inner products over a bit-sliced index.

Vectors become whole numbers (floor of scale * x). Rows are dealt into blocks; of each block and component the
values, less the component's smallest in the block, are kept as bit slices: bitmaps over the rows, one per binary digit. A query
adds the slices of each component, shifted for each binary digit of its own component, with carry-save bitmap
arithmetic into the slices of the scores; negative query components take the slices' complement. Rows are then chosen from the most significant
score slice downward, and the rows that tie at the boundary are resolved exactly by their id. All blocks meet all
blocks of queries (the stated query set); each pair keeps k rows a query, and the best k of these are the result.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id. Components may have any size: vectors with large ones are dealt into
small blocks of their own, whose slices and scores are whole numbers without a limit. Ranks always follow the exact scores; a score that no long can hold is null.
Vectors are compared with those of the same length, and ranks are given for each length; empty vectors score 0. Rows with the query's id are not its candidates.
Repeated rows are candidates of their own; of queries with the same id and length the smallest vector asks. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.store import small, written

ROWS_A_BLOCK, LARGE_ROWS_A_BLOCK = 1 << 16, 1 << 10
QUERIES_A_BLOCK, MOST_QUERIES_A_BLOCK = 1 << 7, 1 << 10
LARGE = float(1 << 24)  # vectors with such components have blocks of their own


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dims, values (components, whose scaled floors count), large, of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("values"))
    finite = F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("values").isNotNull()).where(finite)
    return rows.select("vec_id", F.size("values").alias("dims"), "values", F.exists("values", lambda x: F.abs(x) >= LARGE / scale).alias("large"))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int, scale: int) -> np.ndarray:
    """Scaled floors, a row for each vector: as int64 or, where they are large, as Python's whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy().reshape(len(column), dims)
    with np.errstate(over="ignore"):
        floors = np.floor(values * scale)
    if np.abs(floors).max(initial=0) <= LARGE:
        return floors.astype(np.int64)
    # what a double cannot hold once it is scaled is a whole number before
    return np.array([[int(f) if np.isfinite(f) else int(x) * scale for x, f in zip(*both, strict=True)] for both in zip(values, floors, strict=True)], object).reshape(len(column), dims)


def _dot(a: np.ndarray, b: np.ndarray) -> int:
    if a.dtype == b.dtype == np.int64 and len(a) and float(np.abs(a).max()) * float(np.abs(b).max()) * len(a) < 2.0**62:
        return int(a @ b)
    return sum(int(x) * int(y) for x, y in zip(a, b, strict=True))


def _numbers(x: list[int]) -> np.ndarray:
    return np.array(x, np.int64 if all(abs(y) < 2**62 for y in x) else object)


def sort_key(score: int) -> bytes:
    """Bytes in the order of the whole numbers."""
    size = abs(score).bit_length() // 8 + 1
    digits = abs(score).to_bytes(size, "big")
    return (0x8000 + size).to_bytes(2, "big") + digits if score >= 0 else (0x8000 - size).to_bytes(2, "big") + bytes(255 - d for d in digits)


def _bitmap(bits: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    packed = np.packbits(bits, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def sliced(ids: np.ndarray, values: np.ndarray) -> tuple[bytes, str, bytes, bytes]:
    """Of a block of rows (at least one): ids in order, smallest value and number of slices of each component, and the slices."""
    order = np.argsort(ids, kind="stable")  # so that bits stand in the order of ids
    ids, values = ids[order].astype(np.int64), values[order]
    low, words = values.min(0) if values.shape[1] else values[0], -(-len(ids) // 64)
    shifted = values - low
    depth = np.array([int(x).bit_length() for x in (shifted.max(0) if values.shape[1] else [])], np.int64)
    bits = [_bitmap((shifted[:, d] >> b & 1).astype(bool), words) for d in range(values.shape[1]) for b in range(depth[d])]
    return ids.tobytes(), ",".join(map(str, low)), depth.tobytes(), b"".join(x.tobytes() for x in bits)


class Sliced:
    """The bit slices of a block of rows, as made by sliced()."""

    def __init__(self, ids: bytes, low: str, depth: bytes, bits: bytes):
        self.ids, self.depth = (np.frombuffer(x, np.int64) for x in (ids, depth))
        self.low = _numbers([int(x) for x in low.split(",") if x])
        self.n, self.words = len(self.ids), -(-len(self.ids) // 64)
        each = iter(np.frombuffer(bits, np.uint64).reshape(-1, self.words))
        self.slices = [[next(each) for _ in range(k)] for k in self.depth]
        self.full = _bitmap(np.ones(self.n, bool), self.words)
        self.top = _numbers([(1 << int(k)) - 1 for k in self.depth])
        self.flipped = [[self.full & ~s for s in group] for group in self.slices]

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the scores less a constant, and that constant. A negative component c is c * top + |c| * (top - value)."""
        base = _dot(query, self.low) + _dot(np.minimum(query, 0), self.top)
        waiting: list[list[np.ndarray]] = []  # per digit, the slices still to be added
        for d in np.flatnonzero(query):
            c, group = abs(int(query[d])), self.slices[d] if query[d] > 0 else self.flipped[d]
            for p in range(c.bit_length()):
                if c >> p & 1:
                    while len(waiting) < p + len(group):
                        waiting.append([])
                    for b, s in enumerate(group):
                        waiting[p + b].append(s)
        out, digit = [], 0
        while digit < len(waiting):
            stack = waiting[digit]
            if len(stack) > 1 and digit + 1 == len(waiting):
                waiting.append([])
            while len(stack) > 2:  # full adders: three slices become a sum and a carry
                x, y, z = stack.pop(), stack.pop(), stack.pop()
                half = x ^ y
                waiting[digit + 1].append(x & y | half & z)
                stack.append(half ^ z)
                stack.insert(0, stack.pop())
            if len(stack) == 2:
                x, y = stack
                waiting[digit + 1].append(x & y)
                stack = [x ^ y]
            out.append(stack[0] if stack else np.zeros(self.words, np.uint64))
            digit += 1
        return out, base

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list[int]]:
        """Rows and scores of the k best candidates; of ties at the boundary those with the smallest ids."""
        slices, base = self.scores(query)
        maybe = self.full.copy()
        lo, hi = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")
        for r in range(lo, hi):
            maybe[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        sure, n_sure = np.zeros(self.words, np.uint64), 0
        for s in reversed(slices):
            more = maybe & s
            n = int(np.bitwise_count(more).sum())
            if n_sure + n >= k:
                maybe = more
            else:
                sure, n_sure, maybe = sure | more, n_sure + n, maybe & ~s
        rows = self._rows(sure)
        ties = self._rows(maybe)[: k - n_sure]  # all have the boundary's score; bits stand in the order of ids
        rows = np.concatenate([rows, ties])
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        scores = [base] * len(rows)
        for at in range(0, len(slices), 62):
            part = sum(((s[word] >> bit & np.uint64(1)).astype(np.int64) << digit for digit, s in enumerate(slices[at : at + 62])), np.zeros(len(rows), np.int64))
            scores = [x + (y << at) for x, y in zip(scores, part.tolist(), strict=True)]
        return rows, scores

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on vec_id."""
    rows = quantised(vectors, scale, id_col, vector_col)
    kind = ["dims", "large"]
    n = rows.groupBy(*kind).agg(F.count("*").alias("n"), F.coalesce(F.sum(is_query.cast("long")), F.lit(0)).alias("q"))
    n = n.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / F.when(F.col("large"), LARGE_ROWS_A_BLOCK).otherwise(ROWS_A_BLOCK))).cast("long"))
    # of many blocks each meets more queries at once, so that blocks travel less often
    at_once = F.least(F.lit(MOST_QUERIES_A_BLOCK), QUERIES_A_BLOCK * F.ceil(F.sum("blocks").over(Window.partitionBy("dims")) / 8))
    n = n.withColumn("q_blocks", F.ceil(F.sum("q").over(Window.partitionBy("dims")) / at_once).cast("long"))
    n = small(written(n.where("q_blocks > 0").select(*kind, "blocks", "q_blocks"), "vector-counts"))  # two rows per vector length
    dealt = rows.join(n, kind)

    def index(block: pa.Table) -> pa.Table:
        dims = block.column("dims")[0].as_py()
        parts = sliced(block.column("vec_id").to_numpy(), _matrix(block.column("values"), dims, scale))
        kinds = (pa.binary(), pa.string(), pa.binary(), pa.binary())
        head = [block.column(c).slice(0, 1) for c in ("dims", "large", "block", "q_blocks")]
        return pa.table([*head, *(pa.array([x], t) for x, t in zip(parts, kinds, strict=True))], names=["dims", "large", "block", "q_blocks", "ids", "low", "depth", "bits"])

    blocks = dealt.select(*kind, F.pmod(F.xxhash64("vec_id", "values"), F.col("blocks")).alias("block"), "q_blocks", "vec_id", "values")
    blocks = blocks.groupBy(*kind, "block").applyInArrow(index, "dims int, large boolean, block long, q_blocks long, ids binary, low string, depth binary, bits binary")
    # each block of rows meets each block of queries once
    left = blocks.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - 1)))
    asked = dealt.where(is_query).groupBy("dims", "vec_id").agg(F.min("values").alias("values"))
    right = asked.join(n, "dims").select(*kind, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("vec_id"), F.col("q_blocks")).alias("q_block"), "vec_id", "values")
    keys = [*kind, "block", "q_block"]

    def meet(block: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if block.num_rows and queries.num_rows:
            slices = Sliced(*(block.column(c)[0].as_py() for c in ("ids", "low", "depth", "bits")))
            dims = len(slices.depth)
            for own, query in zip(queries.column("vec_id").to_pylist(), _matrix(queries.column("values"), dims, scale), strict=True):
                at, scores = slices.best(query, own, k)
                out += [(own, dims, i, s if -(2**63) <= s < 2**63 else None, sort_key(s)) for i, s in zip(slices.ids[at].tolist(), scores, strict=True)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["query_id", "dims", "vec_id", "score", "key"])

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, dims int, vec_id long, score long, key binary")
    order = Window.partitionBy("query_id", "dims").orderBy(F.col("key").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
