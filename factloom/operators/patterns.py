"""Texts against lists of strings of any size: all occurrences, overlapping ones too.

The list is measured first. Up to most_chars characters it becomes an Aho-Corasick automaton, made once in each worker from a broadcast list, through which texts run batch by batch without a shuffle; time
grows with the text and with what is found, not with the list. A larger list stays a table: a Bloom filter of BITS bits a string (a size that is known before it is broadcast, and capped: a fuller filter
lets more through, and nothing is lost) screens the texts' windows, for each length that the list has, by hashes that cost the same for any length; windows that pass join the list as strings. They are written
to spark.checkpoint.dir first (if there is one): the strings that stand in texts go to all tasks, if they are few, and no window moves; else both meet by merging, where a string that very many texts hold
is one key, which Spark splits (spark.sql.adaptive.skewJoin).

Null and empty strings of the list match nothing; repeated ones count once. Null and empty texts hold nothing. Rows are searched one by one, repeated ones too; columns of the input that are called
like a result (pattern, at) give way to it, all others but the text come with each occurrence. An empty table or list gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources.shared import few, written

MOST_CHARS = 4_000_000  # of a list that becomes an automaton: some hundred bytes of memory each
BITS, HASHES, MOST_BITS = 16, 4, 1 << 31
MOST_BROADCAST = 200_000  # strings that texts and the list have in common
PORTION = 1 << 20  # characters that are screened at once
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_made: dict[str, ahocorasick.Automaton] = {}  # the last list's automaton, in a worker


def _automaton(token: str, listed: Broadcast) -> ahocorasick.Automaton:
    if token not in _made:
        _made.clear()
        automaton = ahocorasick.Automaton()
        for pattern in listed.value:
            automaton.add_word(pattern, pattern)
        if len(automaton):
            automaton.make_automaton()
        _made[token] = automaton
    return _made[token]


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of all windows of some length of a text, by prefix sums: each costs the same."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(len(codes), _BASE, np.uint64))
            self.down = np.cumprod(np.full(len(codes), _UNBASE, np.uint64))
            self.sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(mixed(codes + np.uint64(1)) * powers, out=self.sums[1:])

    def of(self, length: int) -> np.ndarray:
        n = max(len(self.sums) - length, 0)
        with np.errstate(over="ignore"):
            return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n] + np.uint64(length))


def _bit(hashes: np.ndarray, k: int, size: int) -> np.ndarray:
    """The k-th place of each hash in a filter of `size` bits (a power of two)."""
    with np.errstate(over="ignore"):
        return mixed(hashes + np.uint64(k)) & np.uint64(size - 1)


def _filter(listed: DataFrame, n: int) -> np.ndarray:
    """The Bloom filter of a list as 64-bit words, put together by Spark."""
    size = min(max(1 << (BITS * n - 1).bit_length(), 64), MOST_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes = np.concatenate([Windows(p).of(len(p)) for p in batch.column(0).to_pylist()])
                at = np.unique(np.concatenate([_bit(hashes, k, size) for k in range(HASHES)]))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((at & np.uint64(63)).astype(np.int32))], ["word", "bit"])

    words = listed.mapInArrow(places, "word long, bit int").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _pieces(text: str, portion: int, longest: int) -> Iterator[tuple[int, str]]:
    """A long text in pieces that overlap, so that memory is bounded; each window begins in one of them."""
    for at in range(0, len(text), portion):
        yield at, text[at : at + portion + longest - 1]


def occurrences(docs: DataFrame, patterns: DataFrame, text_col: str = "text", pattern_col: str = "pattern", most_chars: int = MOST_CHARS, portion: int = PORTION) -> DataFrame:
    """One row for each place where a string of the list stands: the columns of docs but the text, pattern, at (characters before it). portion: characters that are screened, and places that are held, at once."""
    spark = docs.sparkSession
    listed = patterns.select(F.col(pattern_col).cast("string").alias("pattern")).where("pattern <> ''").distinct()
    n, chars = listed.agg(F.count("*"), F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()
    kept = [c for c in docs.columns if c not in (text_col,) and c.lower() not in ("pattern", "at")]
    rows = docs.select(*kept, F.col(text_col).cast("string").alias("at")).where("at is not null")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("pattern", T.StringType()), T.StructField("at", T.LongType())])

    def with_rows(batch: pa.RecordBatch, found: list[tuple[int, str, int]]) -> pa.RecordBatch:
        held = batch.select(kept).take(pa.array([r for r, _, _ in found], pa.int64()))
        return pa.RecordBatch.from_arrays([*held.columns, pa.array([p for _, p, _ in found], pa.string()), pa.array([a for _, _, a in found], pa.int64())], [*kept, "pattern", "at"])

    if chars <= most_chars:
        shared, token = spark.sparkContext.broadcast([r.pattern for r in listed.collect()]), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(token, shared)
            for batch in batches if len(automaton) else ():
                for row, text in enumerate(batch.column(len(kept)).to_pylist()):
                    found = []
                    for end, pattern in automaton.iter(text):
                        found.append((row, pattern, end + 1 - len(pattern)))
                        if len(found) == portion:
                            yield with_rows(batch, found)
                            found = []
                    if found:
                        yield with_rows(batch, found)

        return rows.mapInArrow(search, schema)

    lengths = [r.n for r in listed.select(F.length("pattern").alias("n")).distinct().collect()]
    shared = spark.sparkContext.broadcast(_filter(listed, n))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for row, text in enumerate(batch.column(len(kept)).to_pylist()):
                for base, piece in _pieces(text, portion, max(lengths)):
                    windows, found = Windows(piece), []
                    for length in lengths:
                        here = windows.of(length)[:portion]
                        at = np.arange(len(here))
                        for k in range(HASHES):
                            place = _bit(here[at], k, len(words) * 64)
                            at = at[(words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
                        found += [(row, piece[a : a + length], base + a) for a in at.tolist()]
                    if found:
                        yield with_rows(batch, found)

    passed = rows.mapInArrow(screen, schema)
    if spark.conf.get("spark.checkpoint.dir", None):
        # windows that passed are written once: strings that texts and list have in common are found first, and if they are few, the windows stay where they are
        passed = written(passed, "windows")
        common = written(listed.join(passed.select("pattern").distinct(), "pattern"), "listed-windows")
        if few(common, MOST_BROADCAST):
            return passed.join(F.broadcast(common), "pattern", "left_semi").select(*kept, "pattern", "at")
        listed = common
    return passed.join(listed.hint("merge"), "pattern", "left_semi").select(*kept, "pattern", "at")
