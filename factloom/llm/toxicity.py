"""Toxicity by compression distance under two zstandard dictionaries.

A window is WORDS consecutive words with borders, A-Z lower-cased and punctuation stripped. Both dictionaries are trained by zstandard: the ordinary one on words of ordinary text, the toxic
one on the beginnings of words of toxic text. Toxic documents are ordinary prose but for few words, so a dictionary of whole toxic documents would learn what both kinds share; those word occurrences of
toxic documents are its training samples whose beginning is far more frequent there (likelihood ratio), cut after that beginning. Windows are
compressed with the ordinary dictionary, and with the toxic one before the same ordinary one, so that windows of neither kind cost the same under both. A window is a hit
if the toxic dictionary saves at least `threshold` bytes; the threshold, and the share of toxic documents among those with 0, 1, 2 ... hits, which is the
score, are calibrated on the training sample.

The model is fitted on a bounded sample of labelled rows: TOXIC_DOCS and ORDINARY_DOCS, drawn by a hash of their ids, of each label as many as fit SAMPLE_BYTES; of
which those that share word sequences with one another count once. Scores cover whole texts of all rows; lengths of windows are remembered in a bounded cache of each worker.

Null and empty texts have no window and score as texts without hits. Null ids are scored and never held out; repeated rows get equal scores; without toxic or ordinary labels all scores are
the share of toxic labels. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.words import mix, portions

TOXIC_DOCS, ORDINARY_DOCS = 1000, 2000
SAMPLE_BYTES = 32 << 20  # of text, for each label
WORDS = 3  # of a window
CUT = 0.3
PUNCTUATION = b".,!?;:\"()[]'*#&$|=-_"
OPEN, CLOSE, END = b"\n<window opens>", b" <window closes>\n", b"|the end of a dictionary|"
LONGEST = 96  # bytes of a window; longer ones are several
ORDINARY_BYTES, TOXIC_BYTES = 2048, 1024
SIGNATURE = 24
SEGMENT, MATCH = 16, 8  # of zstandard's trainer, in bytes
LEAST_RATIO = 28.0
MOST_HITS = 4


def core(word: bytes) -> bytes:
    return word.strip(PUNCTUATION).lower()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def windows(text: str | None) -> list[bytes]:
    cores = [c for c in map(core, words(text)) if c]
    whole = [b" ".join(cores[i : i + WORDS]) for i in range(0, len(cores), WORDS)]
    return [w[i : i + LONGEST] for w in whole for i in range(0, len(w), LONGEST)]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int
    shares: list[float]  # by the number of hits
    cache: dict[bytes, int] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "threshold": self.threshold, "shares": self.shares}

    def __setstate__(self, state):
        self.__dict__ |= state | {"cache": {}}

    def _compressor(self, content: bytes):
        import zstandard

        held = zstandard.ZstdCompressionDict(content + b"|" + CLOSE + b"|" + OPEN + END, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, strategy=zstandard.STRATEGY_GREEDY, min_match=5, window_log=14, search_log=5, target_length=32, hash_log=12, chain_log=12)
        held.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress

    def gain(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves over the ordinary one."""
        if not hasattr(self, "_pair"):
            self._pair = self._compressor(self.ordinary), self._compressor(self.toxic)
        body = OPEN + b" " + window + CLOSE
        return len(self._pair[0](body)) - len(self._pair[1](body))

    def hit(self, window: bytes) -> bool:
        found = self.cache.get(window)
        if found is None:
            if len(self.cache) >= 200_000:
                self.cache.clear()
            found = self.cache[window] = self.gain(window)
        return found >= self.threshold

    def hits(self, text: str | None) -> int:
        return sum(map(self.hit, windows(text)))

    def score(self, hits: int) -> float:
        return self.shares[min(hits, len(self.shares) - 1)]


def _signatures(words: list[bytes], k: int = 4) -> list[int]:
    """Smallest hashes of word sequences, under SIGNATURE hash functions."""
    runs = np.array([zlib.crc32(b" ".join(words[i : i + k])) for i in range(max(1, len(words) - k + 1))], np.uint64)
    return [int(mix(runs + np.uint64(j << 32)).min()) for j in range(SIGNATURE)]


def _apart(texts: list[str | None]) -> list[list[bytes]]:
    """Words of each text that shares no signature with an earlier one."""
    seen: set[int] = set()
    out = []
    for t in texts:
        whole = words(t)
        if not whole:
            continue
        marks = _signatures(whole)
        if not seen.intersection(marks):
            out.append([c for c in map(core, whole) if c])
        seen.update(marks)
    return out


def _beginnings(words: set[bytes]) -> set[bytes]:
    return {w[:k] for w in words for k in (4, 5, 6, 7, 8)} | words


def _ratio(a: int, b: int, n: int, m: int) -> float:
    """Likelihood ratio that a of n and b of m come from different shares."""
    p = (a + b) / (n + m)
    return 2 * sum(k * math.log(k / (of * p)) for k, of in ((a, n), (b, m)) if k)


def _trained(samples: list[bytes], size: int, **how: int) -> bytes:
    """zstandard's dictionary of samples; too few to train on stand for themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(sorted(set(samples)))[-size:]


def fit(toxic: list[str | None], ordinary: list[str | None]) -> Model:
    base = len(toxic) / max(1, len(toxic) + len(ordinary))
    t, o = _apart(toxic), _apart(ordinary)
    if not t or not o:
        return Model(b"", b"", 1 << 20, [base])
    count: Counter[bytes] = Counter()
    for w in t:
        count.update(x for x in _beginnings({c[:LONGEST] for c in w}) if len(x) >= 4)
    often = {x: c for x, c in count.items() if c >= 4}
    other: Counter[bytes] = Counter()
    for w in o:
        other.update(_beginnings({c[:LONGEST] for c in w}) & often.keys())
    more = lambda x, c: c / len(t) > 8 * (other[x] + 0.5) / len(o) and _ratio(c, other[x], len(t), len(o)) > LEAST_RATIO
    chosen = {x for x, c in often.items() if more(x, c)}
    # a passage that several toxic documents share counts once: a document counts for a beginning if it has it between other words than those before
    seen: set[tuple[bytes, bytes, bytes]] = set()
    anew: Counter[bytes] = Counter()
    for w in t:
        places = {(x, a, z) for a, c, z in zip([b"", *w], w, [*w[1:], b""], strict=False) for x in {c[:k] for k in (*range(4, 9), LONGEST)} & chosen}
        anew.update({x for x, *_ in places - seen})
        seen |= places
    chosen = {x for x in chosen if more(x, anew[x])}
    # each occurrence of a word with such a beginning is a sample: its shortest one, with borders
    first = lambda w: next((w[:k] for k in (*range(4, 9), len(w)) if w[:k] in chosen), None)
    samples = [b"  " + x + b"    " for w in t for x in map(first, w) if x]
    usual: Counter[bytes] = Counter()
    for w in o:
        usual.update({c[:LONGEST] for c in w})
    plain = [b" " + x + b" " for x, c in sorted(usual.items()) for _ in range(min(c, 20)) if c > 1]
    content = _trained([b"".join(plain[i::997]) for i in range(min(997, len(plain)))], ORDINARY_BYTES)
    model = Model(content, _trained(samples, TOXIC_BYTES, k=SEGMENT, d=MATCH) + b"|" + content if samples else content, 1, [])
    gains = [[max(map(model.gain, windows(text)), default=0) for text in side] for side in (toxic, ordinary)]
    # the threshold that tells most documents right, counting both kinds alike; the higher of equals
    model.threshold = max(range(1, 9), key=lambda g: (round(sum(x >= g for x in gains[0]) / len(toxic) - 4 * sum(x >= g for x in gains[1]) / len(ordinary), 6), g))
    totals = [[0, 0] for _ in range(MOST_HITS)]
    for label, texts in ((1, toxic), (0, ordinary)):
        for text in texts:
            totals[min(model.hits(text), MOST_HITS - 1)][label] += 1
    model.cache.clear()
    share = [(a[1] + base) / (sum(a) + 1) for a in totals]
    model.shares = [max(share[: k + 1]) for k in range(MOST_HITS)]  # more hits never mean less
    return model


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows that are not held out. docs: doc_id, text; labels: doc_id, toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 2))
    order = F.xxhash64("doc_id")
    drawn = known.where("toxic = 1").orderBy(order, "doc_id").limit(TOXIC_DOCS).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(ORDINARY_DOCS))
    toxic = {r.doc_id: r.toxic for r in drawn.collect()}  # at most TOXIC_DOCS + ORDINARY_DOCS
    ids = docs.sparkSession.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy(order, "doc_id"))
    texts = texts.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") <= SAMPLE_BYTES).select("doc_id", "text").collect()
    texts.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in texts if toxic[r.doc_id]], [r.text for r in texts if not toxic[r.doc_id]])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text. One row per document: doc_id, held_out, score, predicted, hits."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            hits = [model.hits(t) for t in part.column(1).to_pylist()]
            scores = [model.score(h) for h in hits]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], ["doc_id", "score", "hits"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double, hits long")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "hits")


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text is not predicted toxic, with all their columns."""
    model = trained(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            yield part.filter(pa.array([model.score(model.hits(t)) < CUT for t in part.column(part.schema.get_field_index("text")).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
