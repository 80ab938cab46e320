"""Hashed maximum-entropy language model with a class-factored softmax.

A text is its words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased), then one end. A token's probability is that of its class, given the
tokens before it, times its share of the class. The most frequent training words and the end are classes of
their own; all others fall into classes by a hash of their first two bytes and last byte. The class is predicted by a softmax over
hashed features: the word before (n-gram), the two before (n-gram), the words two and three before (skips) and the
classes of the two before. Within a class a word's weight is log(count + 1), with a place for unknown words, plus a weight of the pair it makes with the word before, if
training has it: log(1 + c / (T * share)), where c is the pair's count, T how many different words of the class follow that word before, and share the word's part of the class.
The normaliser is then 1 + C / T (C: the sum of c in the class), so that probabilities of all words add up to one. Pairs are not cut: their table grows with the texts.

Counts cover all training texts: per task first, then by hash. The softmax is trained by distributed gradient updates. Tasks sum, over all training texts, how
often each feature value comes with each class; less what the model expects, that is the gradient. The first update is made from the model without features, whose
expected counts are known without a pass over the texts: half a step of iterative scaling, with smoothed counts. Then come rounds, each over its part of the texts, in which tasks also sum one class
a token that is drawn from the model's shares (an unbiased estimate of the expected counts that touches five weights a token instead of all), and the driver makes a damped Newton step. Draws follow from the texts, so the
model is the same however the table is partitioned. Sums travel as sparse blocks of the weights and are added in two levels, so no task gets those of all tasks. What reaches
the driver is as large as the weights, whatever the input. The number of slots follows the training tokens up to MOST_SLOTS.

Scores are made in numpy batches of sparse rows: five weight rows a token. Counts of words beyond the most frequent ones (a bounded list that every task
gets) are joined by hash, so the vocabulary is never broadcast. Pairs are dealt by the hash of the word before and the class into buckets, whose number
follows the tokens; a bucket counts the training pairs, finds the weights of all, and its sums go back to the texts. No pair reaches the driver.

Null and empty texts are the end alone. Null ids are not held out. Repeated rows are scored (and counted) each. Without
training texts N = V = 0 and every token is unknown. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.store import written
from factloom.llm.words import Words, mix, portions

OWN, SPELT = 32, 32  # classes of one token; classes by spelling
CLASSES = OWN + SPELT
FREQUENT = 1 << 16  # words whose counts every task gets
LEAST_SLOTS, MOST_SLOTS, TOKENS_A_SLOT = 1024, 4096, 512  # hash values of a feature
FEATURES = 5
BATCH = 8192
FIRST_STEP, ROUNDS, RATE = 0.5, 2, 0.3
PRIOR = 50.0  # tokens that each feature value has before it is seen, shared by class
DAMPING = 10.0
BLOCK = 1 << 14  # weights that are summed together
FAN_IN = 256  # tasks whose sums are added at once
PAIRS_A_BUCKET = 1 << 20
GROUP_BITS = 27  # of the hash of the word before, besides those that pick the bucket
MERGED_AT = 1 << 20
END = np.uint64(0x3C79AC492BA7B653)
BEFORE = np.uint64(0x1C69B3F74AC4AE35)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hash, spelling class and row of each token, the rows' ends included, in order; and the rows."""
    words = Words(column, lower=True)
    data = words.data
    second = np.where(words.end - words.start > 1, data[np.minimum(words.start + 1, max(len(data) - 1, 0))] if len(data) else 0, 0)
    spelt = mix((data[words.start].astype(np.uint64) << np.uint64(16)) | (second.astype(np.uint64) << np.uint64(8)) | data[words.end - 1].astype(np.uint64)) % np.uint64(SPELT) if len(data) else np.zeros(0, np.uint64)
    at = np.arange(len(words.start)) + words.row
    n = len(words.start) + words.rows
    hashes, kind, row = np.full(n, END), np.zeros(n, np.int64), np.repeat(np.arange(words.rows), words.count + 1)
    hashes[at], kind[at] = words.hash, spelt.astype(np.int64)
    return hashes, kind, row, words.rows


def counted(docs: DataFrame) -> DataFrame:
    """docs: text. h (hash of a token), kind (spelling class), c (its count)."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        h, kind, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, first, which = np.unique(h, return_index=True, return_inverse=True)
        return [(h, kind[first], np.bincount(which, c, len(h)).astype(np.int64))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            for h, kind, c in parts:
                for i in range(0, len(h), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 17)].view(np.int64)), pa.array(kind[i : i + (1 << 17)].astype(np.int32)), pa.array(c[i : i + (1 << 17)])], ["h", "kind", "c"])

        for part in portions(batches):
            h, kind, _, _ = tokens(part.column(0))
            h, first, c = np.unique(h, return_index=True, return_counts=True)
            parts.append((h, kind[first], c))
            if sum(len(p[0]) for p in parts) > MERGED_AT:
                parts = merged(parts)
                if len(parts[0][0]) > MERGED_AT // 2:
                    yield from out()
                    parts = []
        if parts:
            parts = merged(parts)
            yield from out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "h long, kind int, c long").groupBy("h").agg(F.min("kind").alias("kind"), F.sum("c").alias("c"))


@dataclass
class Frequent:
    """What every task gets of the tokens: sorted hashes of the most frequent ones, their counts, the class of those that have their own (else -1), and the slots of a feature."""

    hashes: np.ndarray
    counts: np.ndarray
    own: np.ndarray
    slots: int = LEAST_SLOTS

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        return at, (self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool))


class Batch:
    """Tokens of some rows with their classes and features."""

    def __init__(self, column: pa.Array, frequent: Frequent):
        self.h, kind, self.row, self.rows = tokens(column)
        at, known = frequent.find(self.h)
        own = np.where(known, frequent.own[at] if len(frequent.own) else -1, -1)
        self.at, self.known = at, known
        self.target = np.where(own >= 0, own, OWN + kind)
        n = len(self.h)

        def earlier(values: np.ndarray, by: int, none) -> np.ndarray:
            out = np.full(n, none, values.dtype)
            if n > by:
                same = self.row[by:] == self.row[:-by]
                out[by:] = np.where(same, values[:-by], none)
            return out

        one, two, three = (earlier(self.h, k, BEFORE) for k in (1, 2, 3))
        self.before = one
        near = earlier(self.target, 1, CLASSES), earlier(self.target, 2, CLASSES)
        hashed = [one, two + np.uint64(1), three + np.uint64(2), one * np.uint64(3) ^ mix(two)]
        slots = frequent.slots
        self.features = np.stack([*((mix(x) % np.uint64(slots)).astype(np.int64) for x in hashed), (near[0] * (CLASSES + 1) + near[1]) % slots])
        self.features += (np.arange(FEATURES) * slots)[:, None]

    def draws(self) -> np.ndarray:
        """A number from 0 to 1 for each token that follows from its text and place."""
        n = len(self.h)
        starts = np.searchsorted(self.row, np.arange(self.rows))
        text = np.add.reduceat(mix(self.h + mix((np.arange(n) - starts[self.row]).astype(np.uint64))), starts) if n else np.zeros(0, np.uint64)
        return (mix(text[self.row] + np.arange(n).astype(np.uint64) - starts[self.row].astype(np.uint64)) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)


class Softmax:
    """Scores of the classes: a bias and a row of weights per feature value."""

    def __init__(self, weights: np.ndarray):
        self.w = weights  # FEATURES * slots + 1 rows, the last the bias

    def _scores(self, features: np.ndarray) -> np.ndarray:
        s = self.w[features[0]]
        for f in features[1:]:
            s += self.w[f]
        s += self.w[-1]
        s -= s.max(1, keepdims=True)
        return s

    def log_shares(self, features: np.ndarray) -> np.ndarray:
        s = self._scores(features)
        return s - np.log(np.exp(s).sum(1, keepdims=True))

    def drawn(self, features: np.ndarray, u: np.ndarray) -> np.ndarray:
        """A class for each token, drawn from its shares by u."""
        s = self._scores(features)
        np.exp(s, out=s)
        np.cumsum(s, axis=1, out=s)
        return np.minimum((s <= (u * s[:, -1])[:, None]).sum(1), CLASSES - 1)


def _short(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as they need, after a byte that tells how many."""
    size = next(k for k in (1, 2, 4, 8) if len(x) == 0 or np.abs(x).max() < 1 << (8 * k - 1))
    return bytes([size]) + x.astype(f"<i{size}").tobytes()


def _long(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<i{x[0]}", offset=1).astype(np.int64)


def _sums(docs: DataFrame, frequent: Frequent, weights: np.ndarray | None = None) -> np.ndarray:
    """How often each feature value (and any, for the bias) comes with each class over all texts of docs, less how often it does with the classes that weights draw."""
    rows = FEATURES * frequent.slots + 1
    size = rows * CLASSES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, softmax = np.zeros(size, np.int64), Softmax(weights)
        for part in portions(batches):
            b = Batch(part.column(0), frequent)
            places = np.concatenate([b.features, np.full((1, len(b.h)), rows - 1)]) * CLASSES
            total += np.bincount((places + b.target).ravel(), minlength=size)
            if weights is not None:
                u = b.draws()
                drawn = [softmax.drawn(b.features[:, i : i + BATCH], u[i : i + BATCH]) for i in range(0, len(b.h), BATCH)]
                total -= np.bincount((places + np.concatenate(drawn)).ravel(), minlength=size)
        for block in range(0, size, BLOCK):
            x = total[block : block + BLOCK]
            at = np.flatnonzero(x)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_short(np.diff(at, prepend=0))], pa.binary()), pa.array([_short(x[at])], pa.binary())], ["block", "gaps", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for gaps, sums in zip(table.column("gaps"), table.column("sums"), strict=True):
            total[np.cumsum(_long(gaps.as_py()))] += _long(sums.as_py())
        at = np.flatnonzero(total)
        return pa.table([table.column("block").slice(0, 1), pa.array([_short(np.diff(at, prepend=0))], pa.binary()), pa.array([_short(total[at])], pa.binary())], names=["block", "gaps", "sums"])

    schema = "block long, gaps binary, sums binary"
    made = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(add, schema)
    tasks = made.rdd.getNumPartitions()
    if tasks > FAN_IN:
        made = made.withColumn("group", F.spark_partition_id() % -(-tasks // FAN_IN)).groupBy("block", "group").applyInArrow(merge, schema)
    out = np.zeros(-(-size // BLOCK) * BLOCK)
    for r in made.groupBy("block").applyInArrow(merge, schema).collect():  # as large as the weights
        out[r.block + np.cumsum(_long(r.gaps))] = _long(r.sums)
    return out[:size].reshape(rows, CLASSES)


@dataclass
class Model:
    frequent: Frequent
    weights: np.ndarray
    size: int  # N
    distinct: int  # V
    denominator: np.ndarray  # of each class: its training tokens + its words + 1 for unknown ones; of one word: count + 1


def trained(docs: DataFrame) -> tuple[Model, DataFrame]:
    """docs: doc_id, text, all of them training texts. The model, and the counts of all its tokens (h, c)."""
    counts = written(counted(docs), "token-counts")
    size, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    # words that occur often enough, by a histogram of the logarithms of their counts
    level = F.floor(F.log2("c") * 16)
    shown, cut = 0, -1
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # some hundreds of rows at most
        shown += r["count"]
        if shown > FREQUENT:
            cut = r.level
            break
    end = int(END.astype(np.int64))
    first = counts.orderBy(F.col("c").desc(), "h").limit(OWN).select("h")
    top = counts.where((level > cut) | (F.col("h") == end)).union(counts.join(F.broadcast(first), "h", "left_semi")).distinct()
    top = top.orderBy(F.col("c").desc(), "h").select("h", "c", "kind").toPandas()  # bounded by FREQUENT and OWN
    h, c, kind = top.h.to_numpy(np.int64).view(np.uint64), top.c.to_numpy(np.int64), top.kind.to_numpy(np.int64)
    own = np.full(len(h), -1)
    chosen = np.concatenate([np.flatnonzero(h == END), np.flatnonzero(h != END)[:OWN]]).astype(np.int64)[:OWN]
    own[chosen] = np.arange(len(chosen))
    denominator = np.ones(CLASSES)
    for r in counts.groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # SPELT rows
        mine = chosen[kind[chosen] == r.kind]
        denominator[OWN + r.kind] = r.c - c[mine].sum() + r.v - len(mine) + 1
    denominator[: len(chosen)] = c[chosen] + 1
    order = np.argsort(h)
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << math.ceil(math.log2(1 + (size or 0) / TOKENS_A_SLOT))))
    frequent = Frequent(h[order], c[order], own[order], slots)

    shares = denominator.copy()
    shares[len(chosen) : OWN] = 1e-9  # classes without a word
    p = shares / shares.sum()
    # the first update, from no weights but the bias, whose expected counts are n * p
    seen = _sums(docs, frequent)
    weights = FIRST_STEP * (np.log(seen + PRIOR * p) - np.log((seen.sum(1, keepdims=True) + PRIOR) * p))
    weights[-1] = np.log(p)
    weights = weights.astype(np.float32)
    for r in range(ROUNDS):
        gradient = _sums(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == r), frequent, weights)
        step = gradient / (seen / ROUNDS * (1 - p) + PRIOR * p + DAMPING)
        weights = weights + (RATE * np.clip(step, -1, 1)).astype(np.float32)
    return Model(frequent, weights, int(size or 0), int(distinct), denominator), counts


def _planes(x: np.ndarray) -> bytes:
    """x by bytes of the same place, so that small numbers compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _whole(planes: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _joined(column: pa.ChunkedArray, kind, read=np.frombuffer) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of all rows in one, and the row that each entry is from."""
    parts = [read(x, kind) for x in column.to_pylist()]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])


def pairs_of(b: Batch, train: np.ndarray, buckets: int) -> Iterator[tuple[int, list[bytes]]]:
    """bucket, (groups, words, rows) of the pairs with frequent words and the same of those with other words. A class of one word needs no pair. rows: 2 * row + 1 if it is training."""
    inner = np.flatnonzero(b.target >= OWN)
    kind = (b.target[inner] - OWN).astype(np.uint64)
    mixed = mix(b.before[inner] * np.uint64(0x9FB21C651E98DF25) + kind)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    group = ((mixed & np.uint64((1 << GROUP_BITS) - 1)) << np.uint64(5) | kind).astype(np.uint32)
    row = (2 * b.row[inner] + train[b.row[inner]]).astype(np.uint32)
    place = 2 * bucket + ~b.known[inner]
    order = np.argsort(place.astype(np.uint16) if 2 * buckets < 1 << 16 else place, kind="stable")
    inner, group, row = inner[order], group[order], row[order]
    present, first = np.unique(place[order], return_index=True)
    found: dict[int, list[bytes]] = {}
    for p, lo, hi in zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        word = b.h[inner[lo:hi]] if p & 1 else b.at[inner[lo:hi]].astype(np.uint16)
        found.setdefault(p >> 1, [b""] * 6)[3 * (p & 1) : 3 * (p & 1) + 3] = [group[lo:hi].tobytes(), word.tobytes(), _planes(row[lo:hi])]
    yield from found.items()


def weighed(group: np.ndarray, word: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair: log10 of T / (C + T), and c / T; without training pairs in the group 0 and 0. Words of a group are told apart by 32 bits of their hash."""
    key = group.astype(np.uint64) << np.uint64(32) | word >> np.uint64(32)
    order = np.argsort(key)
    key, train = key[order], train[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    pair = np.cumsum(new) - 1
    c, of_pair = np.bincount(pair, train), key[new] >> np.uint64(32)
    of_pair = np.cumsum(np.append(False, of_pair[1:] != of_pair[:-1])[: len(of_pair)])
    t, total = np.bincount(of_pair, c > 0), np.bincount(of_pair, c)
    rest = np.log10(np.where(t > 0, t, 1) / np.where(t > 0, total + t, 1))
    out, share = np.empty(len(key)), np.empty(len(key))
    out[order], share[order] = rest[of_pair][pair], (c / np.maximum(t, 1)[of_pair])[pair]
    return out, share


def scored(docs: DataFrame, model: Model, counts: DataFrame, held: Column) -> DataFrame:
    """docs: doc_id, text; held: a condition on doc_id, false for the texts that the model was trained on. doc_id, n_tokens, n_known, base_score, score."""
    log_all = float(np.log10(model.size + model.distinct + 1))
    in_class = np.log10(model.denominator)
    inner = model.denominator[OWN:]
    frequent, log_counts = model.frequent, np.log10(model.frequent.counts + 1.0)
    buckets = max(1, -(-model.size // PAIRS_A_BUCKET))
    n_blobs = 6

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        softmax = Softmax(model.weights)
        for part in portions(batches):
            b = Batch(part.column(3), frequent)
            classes = np.empty(len(b.h))
            for i in range(0, len(b.h), BATCH):
                t = b.target[i : i + BATCH]
                classes[i : i + BATCH] = softmax.log_shares(b.features[:, i : i + BATCH])[np.arange(len(t)), t]
            classes = classes / np.log(10) - in_class[b.target]
            known = np.where(b.known, log_counts[b.at] if len(log_counts) else 0.0, 0.0)
            by_row = lambda x: np.bincount(b.row, x, b.rows)
            own = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(by_row(np.ones(len(b.h))).astype(np.int64)), pa.array(by_row(b.known).astype(np.int64)), pa.array(by_row(known)), pa.array(by_row(classes))], ["row", "doc_id", "n_tokens", "frequent", "log_counts", "classes"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as stream:
                stream.write_batch(own)
            at = part.column(0)[0].as_py()  # a part is named by its first row
            train = part.column(2).to_numpy(zero_copy_only=False)
            out = [(at, at % buckets, sink.getvalue().to_pybytes(), *[None] * n_blobs), *((at, k, None, *x) for k, x in pairs_of(b, train, buckets))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), *[pa.binary()] * (1 + n_blobs)], strict=True)], ["part", "bucket", "own", "groups", "words", "rows", "rare_groups", "rare_words", "rare_rows"])

    def weigh(table: pa.Table) -> pa.Table:
        """Of each part in a bucket: sums by row, and for words whose counts are not here the inputs of theirs."""
        out = [(p, x, *[None] * 5) for p, x in zip(table.column("part").to_pylist(), table.column("own").to_pylist(), strict=True) if x is not None]
        table = table.filter(pa.compute.is_null(table.column("own")))
        if table.num_rows:
            (g, at), (w, _), (r, _) = (_joined(table.column(c), kind, read) for c, kind, read in (("groups", np.uint32, np.frombuffer), ("words", np.uint16, np.frombuffer), ("rows", np.uint32, _whole)))
            (rare_g, rare_at), (rare_w, _), (rare_r, _) = (_joined(table.column(c), kind, read) for c, kind, read in (("rare_groups", np.uint32, np.frombuffer), ("rare_words", np.uint64, np.frombuffer), ("rare_rows", np.uint32, _whole)))
            group, hashes = np.concatenate([g, rare_g]), np.concatenate([frequent.hashes[w] if len(w) else np.zeros(0, np.uint64), rare_w])
            gain, share = weighed(group, hashes, np.concatenate([r, rare_r]) & 1)
            share *= inner[group & 31]
            if len(w):
                gain[: len(w)] += np.log10(1 + share[: len(w)] / (frequent.counts[w] + 1.0))
            of = np.concatenate([at, rare_at])
            # all pairs of a part and row, in order
            key = of.astype(np.int64) << 32 | (np.concatenate([r, rare_r]) >> 1)
            keys, which = np.unique(key, return_inverse=True)
            sums, rows = np.bincount(which, gain).astype(np.float32), (keys & 0xFFFFFFFF).astype(np.uint32)
            n = table.num_rows
            cut, rare_cut = np.searchsorted(keys >> 32, np.arange(n + 1)), np.searchsorted(rare_at, np.arange(n + 1))
            rare_rows, rare_share = rare_r >> 1, share[len(w) :].astype(np.float32)
            for i, p in enumerate(table.column("part").to_pylist()):
                a, b, x, y = cut[i], cut[i + 1], rare_cut[i], rare_cut[i + 1]
                out.append((p, None, _planes(rows[a:b]), sums[a:b].tobytes(), _planes(rare_rows[x:y]), rare_w[x:y].tobytes(), rare_share[x:y].tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), *[pa.binary()] * 6], strict=True)], names=["part", "own", "rows", "sums", "rare_rows", "rare_words", "rare_shares"])

    def gather(table: pa.Table) -> pa.Table:
        own = pa.ipc.open_stream(next(x for x in table.column("own").to_pylist() if x is not None)).read_all()
        table, n = table.filter(pa.compute.is_null(table.column("own"))), own.num_rows
        classes, h, share, row = own.column("classes").to_numpy(), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64)
        if table.num_rows:
            rows, sums, row, h, share = (_joined(table.column(c), kind, read)[0] for c, kind, read in (("rows", np.uint32, _whole), ("sums", np.float32, np.frombuffer), ("rare_rows", np.uint32, _whole), ("rare_words", np.int64, np.frombuffer), ("rare_shares", np.float32, np.frombuffer)))
            classes = classes + np.bincount(rows, sums, n)
        order = np.argsort(row, kind="stable")
        ends = pa.array(np.searchsorted(row[order], np.arange(n + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (h, share)]
        return pa.table([*(own.column(c) for c in ("row", "doc_id", "n_tokens", "frequent", "log_counts")), pa.array(classes), *lists], names=["row", "doc_id", "n_tokens", "frequent", "log_counts", "classes", "rare", "shares"])

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~held, F.lit(False)).alias("train"), F.col("text").cast("string").alias("text"))
    pairs = texts.mapInArrow(score, "part long, bucket long, own binary, groups binary, words binary, rows binary, rare_groups binary, rare_words binary, rare_rows binary")
    sums = pairs.groupBy("bucket").applyInArrow(weigh, "part long, own binary, rows binary, sums binary, rare_rows binary, rare_words binary, rare_shares binary")
    own = sums.groupBy("part").applyInArrow(gather, "row long, doc_id long, n_tokens long, frequent long, log_counts double, classes double, rare array<long>, shares array<float>")
    own = written(own, "own-scores")
    rest = own.select("row", F.explode(F.arrays_zip("rare", "shares")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.shares").alias("share"))
    rest = rest.join(counts.select("h", "c").hint("merge"), "h")
    rest = rest.groupBy("row").agg(F.count("*").alias("found"), F.sum(F.log10(F.col("c") + 1)).alias("more"), F.sum(F.log10(1 + F.col("share") / (F.col("c") + 1))).alias("gain"))
    out = own.drop("rare", "shares").join(rest.hint("merge"), "row", "left")
    logs = F.col("log_counts") + F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("frequent") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"), (logs - F.col("n_tokens") * log_all).alias("base_score"), (logs + F.col("classes") + F.coalesce("gain", F.lit(0.0))).alias("score"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def judged(docs: DataFrame) -> DataFrame:
    """Scores of all rows by a model of those that are not held out. doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model, counts = trained(docs.where(~held_out(F.col("doc_id"))))
    out = scored(docs, model, counts, held_out(F.col("doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.size).cast("long").alias("train_tokens"), "base_score", "score")
