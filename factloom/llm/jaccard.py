"""N-gram Jaccard join by parity sketches.

A document's set: hashes of its distinct k-word shingles (fewer words: the whole sequence as one). The parity sketch
of a set has 2^48 bits, of which each member flips the one at its hash; it is kept as the list of its set bits. The Hamming distance of two sketches
is at most the sets' symmetric difference, which for a Jaccard of J and sizes a, b is at most (a + b)(1 - J)/(1 + J). Folding a sketch, by XOR of bits, keeps that bound.

Join, a size band at a time: the sketch is cut into p = d + 1 + e ranges of bits, d being the band's largest distance. Sets that link
agree in at least e + 1 parts, so they share one of their d + 1 first parts in any common order; taking the parts with most
flipped bits first leaves out the empty ones that all sets share. A set is cut for its own band and for
those bands where larger sets may link with it. Parts travel as 48-bit digests of their bits, packed by shuffle bucket.

Equal sets are one class from the start, so copies never multiply. Of the classes that share a part, those whose folded sketches are near enough are tied together; what is tied, over all parts, is a
family. A common passage can give unrelated texts a part, but not near sketches. Families are compared exactly.

Both groups, sharers of a part and families, may be of any size and are connected without comparing all with all (see connected): blocks of bounded size within themselves, then one of each connected set
of a block with those of other blocks, then only what is outside the group's largest component with the rest. A group of near copies of one text takes time and
shuffle in proportion to its size. A group of which more than a block stays unconnected (texts on one template, say) is cut again, by single bits of the sketches, rarest first (see Cut): texts that have
only the template in common then share no group, so their number costs no square. What such a cut leaves together, near misses above all, is compared as before. The number of links of each class (n_links) does need all pairs of
a family, block by block, and is counted only on request.

Words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. Null, empty or blank texts have empty sets and link with nothing. Rows without an id
get their size but no component; rows that repeat an id are one node. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.store import forget, small, written
from factloom.llm.words import Words, mix, portions, shingles, within

K, NUM, DEN = 5, 4, 5  # words a shingle; a Jaccard of 4/5
GROWTH = 1.25  # of the size bands
NARROWEST, WIDEST = 256, 1 << 17  # bits of a sketch: a power of two, at least twice its members
TOKENS_A_BUCKET = 1 << 21
LEAST_BUCKETS = 64
ROWS_A_PORTION = 4096
CLASSES_A_BLOCK, MEMBERS_A_BLOCK = 1024, 1 << 20
SHARERS_A_BLOCK = 2048  # classes with one part that a task compares at once
ROWS_A_TASK = 1 << 17
NARROW = 1.06  # growth of the size bands of a group that is cut again
OFTEN = 1 << 18  # members whose counts every task gets for that


def sets_of(column: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(column, lower=True)
    starts, rows = within(words.first, k)
    all_shingles = shingles(words.hash, k)
    hashes = all_shingles[starts] if len(starts) else np.zeros(0, np.uint64)
    cuts = np.searchsorted(rows, np.arange(words.rows + 1))
    out = []
    for r in range(words.rows):
        if 0 < words.count[r] < k:
            n = int(words.count[r])
            out.append(mix(shingles(words.hash[words.first[r] : words.first[r] + n], n) + np.uint64(n)))
        else:
            out.append(np.unique(hashes[cuts[r] : cuts[r + 1]]))
    return out


def _key(members: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, as signed."""
    return tuple(int(np.add.reduce(mix(members ^ np.uint64(s)), dtype=np.uint64).astype(np.int64)) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


@functools.cache
def bands(num: int = NUM, den: int = DEN, largest: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Smallest size of each band, and the largest symmetric difference of two sets up to its largest size that link."""
    low = [1]
    while low[-1] < largest:
        low.append(max(low[-1] + 1, int(np.ceil(low[-1] * GROWTH))))
    most = [int(Fraction(2 * (hi - 1) * (den - num), den + num)) for hi in low[1:]]
    return np.array(low[:-1]), np.array(most)


def flipped(members: np.ndarray) -> np.ndarray:
    """The bits of the parity sketch that the sorted members flip, in order."""
    return members >> np.uint64(16)


def tokens_of(members: np.ndarray, num: int = NUM, den: int = DEN) -> list[np.ndarray]:
    """For each band in which the set may link: its d + 1 fullest parts as words: 4 bits that are smaller for fuller parts, over 48 bits of hash."""
    low, most = bands(num, den)
    n, bits = len(members), flipped(members)
    mixed = mix(bits)
    first, last = np.searchsorted(low, [n, n * den // num], "right") - 1
    out = []
    for band in range(first, last + 1):
        d = int(most[band])
        parts = d + 1 + (d + 1) // 3 + 1
        # ranges of bits: the sorted bits fall into parts in order; bits that are flipped twice cancel in the XOR
        edges = np.searchsorted(bits, np.ceil(np.arange(parts) * (2.0**48 / parts)).astype(np.uint64))
        counts = np.diff(np.append(edges, n))
        sums = np.zeros(parts, np.uint64)
        full = np.flatnonzero(counts)
        sums[full] = np.bitwise_xor.reduceat(mixed, edges[full])
        salt = mix(np.array([band], np.uint64) + np.uint64(0xA0761D6478BD642F))[0]
        hashes = mix(mix(sums + np.arange(parts, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) ^ salt) >> np.uint64(16)
        ranked = np.sort((15 - np.minimum(counts, 15)).astype(np.uint64) << np.uint64(48) | hashes)
        out.append(ranked[: d + 1] & np.uint64(2**48 - 1))
    return out


def sketch(members: np.ndarray) -> bytes:
    """The parity sketch, folded to a width that suits the number of members."""
    width = min(WIDEST, max(NARROWEST, 1 << (2 * len(members) - 1).bit_length())) if len(members) else NARROWEST
    bits = np.bincount((mix(flipped(members)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> list[int]:
    """Sketches as numbers, all of the narrowest one's width: halves of a parity sketch are put together by XOR."""
    least, out = min(map(len, sketches)) * 8, []
    for s in sketches:
        x, width = int.from_bytes(s, "little"), len(s) * 8
        while width > least:
            width //= 2
            x = x >> width ^ x & ((1 << width) - 1)
        out.append(x)
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], num: int = NUM, den: int = DEN) -> np.ndarray:
    """Which sets of left link with which of right: a boolean matrix."""
    a, b = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    marks = folded([sketch(s) for s in (left if left is right else [*left, *right])])
    wide = max(1, max(map(int.bit_length, marks)) // 8 + 1) // 8 * 8 + 8
    bits = np.frombuffer(b"".join(x.to_bytes(wide, "little") for x in marks), np.uint64).reshape(len(marks), -1)
    sa, sb = bits[: len(left)], bits if left is right else bits[len(left) :]
    maybe = np.zeros((len(left), len(right)), bool)
    for i in range(len(left)):
        far = np.bitwise_count(sa[i] ^ sb).sum(1, dtype=np.int64)
        maybe[i] = (far * (num + den) <= (a[i] + b) * (den - num)) & (a[i] * num <= b * den) & (b * num <= a[i] * den)
    if left is right:
        np.fill_diagonal(maybe, False)
    rows, columns = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
    out = np.zeros_like(maybe)
    if len(rows) * len(columns) <= 64:
        for i in rows:
            for j in np.flatnonzero(maybe[i]):
                both = len(np.intersect1d(left[i], right[j], assume_unique=True))
                out[i, j] = both * (num + den) >= (a[i] + b[j]) * num
        return out
    some = [left[i] for i in rows], [right[j] for j in columns]
    value, which = np.unique(np.concatenate([*some[0], *some[1]]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows) + len(columns)), [len(s) for s in (*some[0], *some[1])])
    often = np.bincount(which, minlength=len(value)) > 1
    keep = often[which]
    which, owner = np.cumsum(often)[which[keep]] - 1, owner[keep]
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    both = np.zeros((len(rows), len(columns)), np.float32)
    for at in range(0, int(often.sum()), 2048):
        lo, hi = np.searchsorted(which, [at, at + 2048])
        held = np.zeros((len(rows) + len(columns), 2048), np.float32)
        held[owner[lo:hi], which[lo:hi] - at] = 1
        both += held[: len(rows)] @ held[len(rows) :].T
    exact = both.astype(np.int64) * (num + den) >= (a[rows][:, None] + b[columns][None, :]) * num
    out[np.ix_(rows, columns)] = exact & maybe[np.ix_(rows, columns)]
    return out


def labels(links: np.ndarray) -> np.ndarray:
    """The smallest index that each index is connected with, by a symmetric matrix."""
    now = np.arange(len(links))
    while True:
        new = np.minimum(now, np.array([now[row].min(initial=len(links)) for row in links]) if len(links) else now)
        new = new[new]
        if (new == now).all():
            return now
        now = new


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def members(docs: DataFrame, k: int = K) -> DataFrame:
    """docs: doc_id, text. doc_id, n (size of its set), k1, k2 (digests of the set), sketch."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            sets = sets_of(part.column(1), k)
            keys = [_key(s) for s in sets]
            numbers = (pa.array(c, pa.int64()) for c in ([len(s) for s in sets], [a for a, _ in keys], [b for _, b in keys]))
            yield pa.RecordBatch.from_arrays([part.column(0), *numbers, pa.array([sketch(s) for s in sets], pa.binary())], ["doc_id", "n", "k1", "k2", "sketch"])

    return docs.mapInArrow(digest, "doc_id long, n long, k1 long, k2 long, sketch binary")


def sharers(docs: DataFrame, buckets: int, k: int = K) -> DataFrame:
    """Sets of classes that share a part: g (a digest of the set), size, k1. Each task sends a class once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for portion in portions(batches):
            for at in range(0, portion.num_rows, ROWS_A_PORTION):
                tokens, owners, classes = [], [], []
                for s in sets_of(portion.column(1).slice(at, ROWS_A_PORTION), k):
                    key = _key(s)[0]
                    if not len(s) or key in sent:
                        continue
                    if len(sent) >= 1_000_000:
                        sent.clear()
                    sent.add(key)
                    for t in tokens_of(s):
                        tokens.append(t)
                        owners.append(np.full(len(t), len(classes), np.uint16))
                    classes.append(key)
                if not classes:
                    continue
                token, owner, of = np.concatenate(tokens), np.concatenate(owners), np.array(classes, np.int64)
                bucket = (mix(token) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                ids, cuts = np.unique(bucket[order], return_index=True)
                token, owner = token[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], owner[order]
                rows = []
                for i, (a, b) in zip(ids, zip(cuts, [*cuts[1:], len(order)], strict=True), strict=True):
                    here, local = np.unique(owner[a:b], return_inverse=True)
                    rows.append((int(i), of[here].tobytes(), local.astype("<u2").tobytes(), token[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "classes", "owners", "tokens"])

    def meet(rows: pa.Table) -> pa.Table:
        token, owner = [], []
        for classes, owners, tokens in zip(*(rows.column(c).to_pylist() for c in ("classes", "owners", "tokens")), strict=True):
            wide = np.zeros((len(tokens) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(tokens, np.uint8).reshape(-1, 6)
            token.append(wide.view("<u8")[:, 0])
            owner.append(np.frombuffer(classes, np.int64)[np.frombuffer(owners, "<u2")])
        token, owner = np.concatenate(token), np.concatenate(owner)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        again = np.zeros(len(token) + 1, bool)
        again[1:-1] = token[1:] == token[:-1]
        shared = again[:-1] | again[1:]
        token, owner = token[shared], owner[shared]
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[new], owner[new]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(token)))
        # parts that the same classes share count once
        digest = np.add.reduceat(mix(owner.view(np.uint64)), starts) if len(starts) else np.zeros(0, np.uint64)
        chosen = np.zeros(len(starts), bool)
        chosen[np.unique(digest, return_index=True)[1]] = True
        keep = np.repeat(chosen & (size > 1), size)
        return pa.table([pa.array(np.repeat(digest, size)[keep].view(np.int64)), pa.array(np.repeat(size, size)[keep]), pa.array(owner[keep])], names=["g", "size", "k1"])

    sent = docs.mapInArrow(send, "bucket long, classes binary, owners binary, tokens binary")
    return sent.groupBy("bucket").applyInArrow(meet, "g long, size long, k1 long").distinct()


def near(n: list[int], sketches: list[bytes], others: list[int], other_sketches: list[bytes], num: int = NUM, den: int = DEN) -> np.ndarray:
    """Which folded sketches are near enough that their sets, of n and others members, may link: a boolean matrix."""
    marks = folded([*sketches, *other_sketches])
    x, y = marks[: len(n)], marks[len(n) :]
    if len(n) * len(others) <= 64:
        fits = [[(p ^ q).bit_count() * (num + den) <= (a + b) * (den - num) and max(a, b) * num <= min(a, b) * den for q, b in zip(y, others, strict=True)] for p, a in zip(x, n, strict=True)]
        return np.array(fits, bool).reshape(len(n), len(others))
    wide = (max(1, *map(int.bit_length, marks)) + 63) // 64 * 8
    bits = np.frombuffer(b"".join(m.to_bytes(wide, "little") for m in marks), np.uint64).reshape(len(marks), -1)
    a, b, out = np.array(n), np.array(others), np.zeros((len(n), len(others)), bool)
    for i in range(len(n)):
        far = np.bitwise_count(bits[i] ^ bits[len(n) :]).sum(1, dtype=np.int64)
        out[i] = (far * (num + den) <= (a[i] + b) * (den - num)) & (a[i] * num <= b * den) & (b * num <= a[i] * den)
    return out


def near_items(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Of items (n, payload: a folded sketch) which are near."""
    return near(*(x.column(c).to_pylist() for x in (left, right) for c in ("n", "payload")))


def linked_items(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Of items (payload: a set) which link."""
    a, b = ([np.frombuffer(m.as_buffer(), np.uint64) for m in x.column("payload")] for x in (left, right))
    return linked(a, a if left is right else b)


Relation = Callable[[pa.Table, pa.Table], np.ndarray]


def _edges(table: pa.Table, left: np.ndarray, right: np.ndarray, relation: Relation, apart: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that connect rows left and right of a table (index arrays, equal or disjoint) as far as relation does; apart: only rows of different `at`."""
    reps, whole = table.column("rep").to_numpy(), left is right
    rows = left if whole else np.concatenate([left, right])
    one = table.take(pa.array(left))
    links = relation(one, one if whole else table.take(pa.array(right)))
    if apart:
        at = table.column("at").to_numpy()
        links &= at[left][:, None] != at[right][None, :]
    if not whole:
        square = np.zeros((len(rows), len(rows)), bool)
        square[: len(left), len(left) :] = links
        links = square | square.T
    np.fill_diagonal(links, False)
    least = labels(links)
    some = np.flatnonzero(reps[rows] != reps[rows[least]])
    return reps[rows[least[some]]], reps[rows[some]]


def connected(items: DataFrame, with_payload: Callable[[DataFrame], DataFrame], relation: Relation, tasks: int, block: int, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """items: g, blocks (of bounded size, into which the group is dealt), rep. with_payload adds n and payload. relation: which items of a group are related.

    Pairs a, b that connect what the relation connects within the groups. tasks: how many share the groups of one block; block: items that make a block.
    cut: smaller groups of the items (the same columns) in which all related ones of a group still meet, for groups that would be compared block by block."""
    schema = "g long, a long, b long"
    nothing = pa.table([pa.array([], pa.int64())] * 3, names=["g", "a", "b"])

    def out(parts: list[tuple[int, tuple[np.ndarray, np.ndarray]]]) -> pa.Table:
        made = [pa.table([pa.array(np.full(len(a), g)), pa.array(a), pa.array(b)], names=["g", "a", "b"]) for g, (a, b) in parts if len(a)]
        return pa.concat_tables(made) if made else nothing

    def inside(table: pa.Table) -> pa.Table:
        table = table.sort_by([("g", "ascending"), ("rep", "ascending")])
        g = table.column("g").to_numpy()
        cuts = [*np.flatnonzero(np.append(True, g[1:] != g[:-1])).tolist(), len(g)]
        return out([(int(g[lo]), _edges(table, rows, rows, relation)) for lo, hi in zip(cuts, cuts[1:], strict=False) for rows in [np.arange(lo, hi)]])

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        own, i, j = table.column("own").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left = np.flatnonzero(own == i)
        return out([(table.column("g")[0].as_py(), _edges(table, left, left if i == j else np.flatnonzero(own == j), relation))])

    def rest(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        few = table.column("few").to_numpy(zero_copy_only=False)
        return out([(table.column("g")[0].as_py(), _edges(table, np.flatnonzero(few), np.flatnonzero(~few), relation, apart=True))])

    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    dealt = with_payload(items).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    task = F.when(F.col("blocks") > 1, F.col("g")).otherwise(F.pmod(F.xxhash64("g"), F.lit(tasks)))
    found = written(dealt.withColumn("task", task).withColumn("alone", F.col("blocks") == 1).groupBy("task", "alone", "own").applyInArrow(inside, schema), "inside")
    many = items.where("blocks > 1")
    if many.isEmpty():
        return found
    # of each connected set of a block its smallest stands for it
    heads = many.join(found.select("g", F.col("b").alias("rep")).hint("merge"), ["g", "rep"], "left_anti")
    count = written(heads.groupBy("g").agg(F.ceil(F.count("*") / block).cast("long").alias("head_blocks")), "heads")
    if cut:
        loose = many.join(small(count.where("head_blocks > 1")), "g", "left_semi")
        if not loose.isEmpty():
            found = written(found.union(connected(cut(loose), with_payload, relation, tasks, block)), "cut")
            count = count.where("head_blocks = 1")
            many = many.join(small(count), "g", "left_semi")
    count = small(count)
    heads = with_payload(heads.join(count, "g")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("head_blocks"))).withColumn("o", numbers(F.col("head_blocks")))
    heads = heads.withColumn("i", F.least("own", "o")).withColumn("j", F.greatest("own", "o"))
    found = written(found.union(heads.groupBy("g", "i", "j").applyInArrow(across, schema)), "across")
    # what no head connects: all outside the largest component meet all others of their group
    at = components(found.select("a", "b"))
    at = written(many.join(at.hint("merge"), F.col("rep") == F.col("node"), "left").select(*items.columns, F.coalesce("component", "rep").alias("at")), "parts")
    size = at.groupBy("g", "at").agg(F.count("*").alias("n_at"))
    most = size.groupBy("g").agg(F.max(F.struct("n_at", "at")).alias("most"), F.sum("n_at").alias("all"))
    most = most.where(F.col("most.n_at") < F.col("all")).select("g", F.col("most.at").alias("main"), F.ceil((F.col("all") - F.col("most.n_at")) / block).cast("long").alias("few_blocks"))
    most = written(most, "open")
    if cut:
        loose = at.join(small(most.where("few_blocks > 1")), "g", "left_semi").select(*items.columns)
        if not loose.isEmpty():
            found = written(found.union(connected(cut(loose), with_payload, relation, tasks, block)), "cut")
            most = most.where("few_blocks = 1")
    left = at.join(small(most), "g")
    if left.isEmpty():
        return found
    few = with_payload(left.where("at <> main")).withColumn("s", F.pmod(F.xxhash64("rep"), F.col("few_blocks"))).withColumn("o", numbers(F.col("blocks"))).withColumn("few", F.lit(True))
    others = with_payload(left).withColumn("o", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("s", numbers(F.col("few_blocks"))).withColumn("few", F.lit(False))
    return found.union(few.unionByName(others).groupBy("g", "s", "o").applyInArrow(rest, schema))


def _of_sets(docs: DataFrame, keys: DataFrame, k: int, make: Callable[[list[pa.Array], list[np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """keys: rep, k1, k2 (of the class), and more. make gives rows of schema from the columns but k1 and k2 and the sets of some classes, which come from the texts of docs."""
    others = [c for c in keys.columns if c not in ("k1", "k2")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            sets = sets_of(part.column(0), k)
            right = [i for i, (s, a, b) in enumerate(zip(sets, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)) if _key(s) == (a, b)]
            if right:
                yield make([c.take(pa.array(right)) for c in part.columns[3:]], [sets[i] for i in right])

    texts = docs.join(small(keys, 500_000), F.col("doc_id") == F.col("rep")).select("text", "k1", "k2", *others)
    return texts.mapInArrow(run, schema)


def _sets(docs: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """keys: rep, k1, k2 (of the class), and more. Adds n and payload, the set of the class, from the texts of docs."""
    others = [c for c in keys.columns if c not in ("k1", "k2")]

    def full(columns: list[pa.Array], sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*columns, pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], [*others, "n", "payload"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.select(*others).schema)
    return _of_sets(docs, keys, k, full, f"{kinds}, n long, payload binary")


@functools.cache
def narrow_bands(largest: int = 1 << 40) -> np.ndarray:
    """Smallest size of each narrow band."""
    low = [1]
    while low[-1] < largest:
        low.append(max(low[-1] + 1, int(np.ceil(low[-1] * NARROW))))
    return np.array(low)


def rarest(members: np.ndarray, often: np.ndarray, counts: np.ndarray, num: int = NUM, den: int = DEN) -> list[tuple[np.ndarray, int]]:
    """For each narrow band of sizes in which a set that links may be: a part of the members, as words that tell both bands, and the side (1: of the smaller band, 2: of the larger, 3: both are one).

    often: sorted members of high count, with counts. All sets rank their members in one order, others first, then those in often by count. Sets of a and b members that link have
    num * (a + b) / (num + den) in common, so they meet in what is left of a when one less than that is taken from its end, and likewise of b."""
    n, low = len(members), narrow_bands()
    if len(often):
        at = np.minimum(np.searchsorted(often, members), len(often) - 1)
        level = np.where(often[at] == members, counts[at], 0)
    else:
        level = np.zeros(n, np.int64)
    mixed = mix(members)
    mixed = mixed[np.lexsort((mixed, level))]
    least, most = -(-n * num // den), n * den // num
    own, first, last = (int(x) for x in np.searchsorted(low, [n, least, most], "right") - 1)
    out = []
    for band in range(first, last + 1):
        common = -(-num * (n + max(int(low[band]), least)) // (num + den))
        salt = mix(np.array([min(own, band) << 20 | max(own, band)], np.uint64) + np.uint64(0x8EBC6AF09C88C6E3))[0]
        out.append((mix(mixed[: n - common + 1] ^ salt), 1 if own < band else 2 if own > band else 3))
    return out


class Cut:
    """Smaller groups for classes whose groups are large: those that share one of the members that are rarest among all such classes.

    docs: doc_id, text; classes: rep, k1, k2, n. What the driver and each task get is bounded by OFTEN; the order of members beyond it follows their hashes, which any order may."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, block: int):
        self.docs, self.classes, self.k, self.block = docs, classes, k, block

    def often(self, keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The members that most classes hold, and their counts."""

        def count(columns: list[pa.Array], sets: list[np.ndarray]) -> pa.RecordBatch:
            value, c = np.unique(np.concatenate(sets), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(c)], ["member", "c"])

        counts = _of_sets(self.docs, keys, self.k, count, "member long, c long").groupBy("member").agg(F.sum("c").alias("c")).where("c > 1")
        counts = written(counts, "member-counts")
        level = F.floor(F.log2("c") * 16)
        shown, least = 0, -1
        for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # some hundreds of rows at most
            shown += r["count"]
            if shown > OFTEN:
                least = r.level
                break
        top = counts.where(level > least).toPandas()  # OFTEN rows at most
        forget(counts)
        member, c = top.member.to_numpy(np.int64).view(np.uint64), top.c.to_numpy(np.int64)
        order = np.argsort(member)
        return member[order], c[order]

    def __call__(self, items: DataFrame) -> DataFrame:
        items = written(items.drop("g", "blocks").distinct(), "loose")
        keys = written(items.select("rep").distinct().join(self.classes.select("rep", "k1", "k2", "n").hint("merge"), "rep"), "loose-classes")
        often, counts = self.often(keys.drop("n"))

        def send(columns: list[pa.Array], sets: list[np.ndarray]) -> pa.RecordBatch:
            found = [(i, *x) for i, s in enumerate(sets) for x in rarest(s, often, counts)]
            lengths = [len(t) for _, t, _ in found]
            of = np.repeat([i for i, _, _ in found], lengths)
            side = np.repeat([x for _, _, x in found], lengths).astype(np.int32)
            return pa.RecordBatch.from_arrays([columns[0].take(pa.array(of)), pa.array(np.concatenate([t for _, t, _ in found]).view(np.int64)), pa.array(side), columns[1].take(pa.array(of))], ["rep", "token", "side", "n"])

        sent = _of_sets(self.docs, keys.select("k1", "k2", "rep", "n"), self.k, send, "rep long, token long, side int, n long")
        # who shares a token, as a sum of digests; tokens that the same classes share count once
        shared = sent.groupBy("token").agg(F.bit_or("side").alias("sides"), F.count("*").alias("size"), F.sum("n").alias("members"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"))
        shared = shared.where("sides = 3 and size > 1").groupBy("who", "size").agg(F.min("token").alias("g"), F.first("members").alias("members"))
        blocks = F.greatest(F.ceil(F.col("size") / self.block), F.ceil(F.col("members") / MEMBERS_A_BLOCK)).cast("long")
        shared = written(shared.select("g", blocks.alias("blocks")), "shared-members")
        small_groups = sent.select("rep", F.col("token").alias("g")).join(small(shared), "g").distinct()
        return written(small_groups.join(items.hint("merge"), "rep"), "cut-groups")


def block_links(sets: DataFrame) -> DataFrame:
    """sets: rep, g, blocks, payload. How many others of its family each links with: node, n_links. All pairs of blocks of a family are compared."""
    own = sets.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    tasks = own.withColumn("o", other).select("g", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "rep", "payload")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rep")
        reps, own = rows.column("rep").to_numpy(), rows.column("own").to_numpy()
        sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in rows.column("payload")]
        # a row may come twice where its id does
        once = np.concatenate([[True], [reps[x] != reps[x - 1] or len(sets[x]) != len(sets[x - 1]) or bool((sets[x] != sets[x - 1]).any()) for x in range(1, len(reps))]])
        reps, own, sets = reps[once], own[once], [s for s, x in zip(sets, once, strict=True) if x]
        i, j = key[1].as_py(), key[2].as_py()
        if i == j:
            count = linked(sets, sets).sum(1)
        else:
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            links, count = linked([sets[x] for x in left], [sets[x] for x in right]), np.zeros(len(sets), np.int64)
            count[left], count[right] = links.sum(1), links.sum(0)
        some = np.flatnonzero(count)
        return pa.table([pa.array(reps[some]), pa.array(count[some].astype(np.int64))], names=["node", "n_links"])

    return tasks.groupBy("g", "i", "j").applyInArrow(compare, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def join(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id with the same set), component_id; with count_links also n_links (other sets that its set links with)."""
    docs = _texts(docs, id_col, text_col)
    rows = written(members(docs, k), "members")
    classes = written(rows.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-int(total * 0.6) // TOKENS_A_BUCKET))
    shared = sharers(docs.where("doc_id is not null"), buckets, k).withColumnRenamed("size", "blocks")
    shared = written(shared.withColumn("blocks", F.ceil(F.col("blocks") / SHARERS_A_BLOCK).cast("long")), "sharers")
    tasks = max(LEAST_BUCKETS, -(-shared.count() // ROWS_A_TASK))
    # of classes whose k1 agrees by chance each takes part
    sketches = classes.select("k1", "n", F.col("sketch").alias("payload"), F.col("rep").alias("at_rep"))
    known = written(shared.join(classes.select("k1", "rep").hint("merge"), "k1"), "known-sharers")
    marked = lambda x: x.join(sketches.hint("merge"), (F.col("k1_") == F.col("k1")) & (F.col("rep") == F.col("at_rep"))).drop("k1", "k1_", "at_rep")
    keys = classes.drop("sketch")
    ties = connected(known.withColumnRenamed("k1", "k1_"), marked, near_items, tasks, SHARERS_A_BLOCK, Cut(docs, keys, k, SHARERS_A_BLOCK))
    family = components(ties.select("a", "b"))
    family = written(family.union(family.select("component", "component").distinct()).toDF("rep", "g"), "families")
    forget(shared, known)
    known = family.join(keys.hint("merge"), "rep")
    size = known.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / CLASSES_A_BLOCK), F.ceil(F.sum("n") / MEMBERS_A_BLOCK)).cast("long").alias("blocks"))
    large = written(size.where("blocks > 1"), "large-families")
    known = written(known.join(small(large), "g", "left").select("rep", "k1", "k2", "g", F.coalesce("blocks", F.lit(1).cast("long")).alias("blocks"), "n"), "candidates")
    tasks = max(LEAST_BUCKETS, -(-(known.agg(F.sum("n")).first()[0] or 0) // MEMBERS_A_BLOCK))
    known = known.drop("n")
    links = connected(known, lambda x: _sets(docs, x, k), linked_items, tasks, CLASSES_A_BLOCK, Cut(docs, keys, k, CLASSES_A_BLOCK))
    label = components(links.select("a", "b"))
    at = classes.join(label.hint("merge"), F.col("rep") == F.col("node"), "left").select("n", "k1", "k2", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    if count_links:
        degree = block_links(_sets(docs, known, k))
        at = at.join(degree.hint("merge"), F.col("class_id") == F.col("node"), "left").drop("node").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    out = rows.join(at.hint("merge"), ["n", "k1", "k2"], "left")
    own = F.when(F.col("n") == 0, F.col("doc_id"))
    more = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", own).alias("class_id"), *more, F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", own)).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: the smallest id of each component; rows without an id all stay."""
    found = join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
