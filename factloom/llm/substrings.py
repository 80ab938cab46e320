"""Removal of repeated passages with compressed FM-indexes per shard.

A window is n consecutive words of one document. Words are removed that a window covers whose word sequence also starts
in a document with a smaller id; windows are judged on the input.

1. One pass gives each row's words, their digest and, per class of equal word sequences, the smallest id and a row that has it. All windows
   of a copy start in that row too, so only one of each class goes on.
2. Screens without loss spare the index what no other class can have: of each window the smallest hash of its 5-word shingles (about one in five shingles is that of any window),
   then, where those are shared, the hash of the window itself, are brought together by hash. Equal windows have equal hashes, so what only one class has is settled; that hashes are shared
   settles nothing. Values that classes of one portion of a task share are known there: their owners go on at once, and the value's bucket gets one owner a portion, so a
   passage that all documents have is no large bucket.
3. Runs of windows that are left and have the same smallest shingle are segments; the shingle picks the shard, so equal windows meet. Of equal
   segments one goes on, with its smallest id, so a passage with equal neighbours counts once however many have it. Within a shard, segments of earlier documents are indexed (an FM-index over a wavelet
   matrix) and those of later ones stream through it, in as many rounds as the largest group of one shingle needs to be halved (see rounds); no segment meets itself. Matching statistics decide:
   where they reach n, the suffix interval holds all places of the window in the index, and the smallest id of the interval is reported; where they stop short, the round finds nothing.
4. Segments go back to their documents and become intervals of words.

Words `[^\\x20\\x09-\\x0D]+`, unchanged. Null, empty or short texts lose nothing. Rows without an id lose nothing and count for no other;
rows that repeat an id are judged one by one, each against the documents with smaller ids. An empty table gives an empty result; extra columns are not read. Rows are told apart by their place in the
table, which must be read in the same order each time, as files are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.buckets import packed, unpacked
from factloom.llm.fmindex import FMIndex
from factloom.llm.store import forget, rows_with, written
from factloom.llm.words import Words, portions, shingles, within

WINDOW, SHINGLE = 13, 5
VALUES_A_BUCKET, LEAST_BUCKETS = 1 << 21, 64
WORDS_A_SHARD = 1 << 19
ROWS_A_PORTION = 4096
LOW48 = np.uint64(2**48 - 1)


def _digest(text: str | None) -> tuple[int, str]:
    words = (text or "").encode("utf-8", "replace").split()
    return len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def _class(sha: str) -> int:
    return int.from_bytes(bytes.fromhex(sha[:16]), "big", signed=True)


def anchors(hashes: np.ndarray, window: int, shingle: int) -> np.ndarray:
    """For each start of a window the smallest hash of its shingles."""
    least = shingles(hashes, shingle)
    have, want = 1, window - shingle + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and rows of the windows, and the anchor of each."""
    starts, rows = within(words.first, window)
    return starts, rows, anchors(words.hash, window, SHINGLE)[starts] & LOW48 if len(starts) else np.zeros(0, np.uint64)


def digests(docs: DataFrame) -> DataFrame:
    """docs: row, doc_id, text. row, doc_id, n_words, sha (of the words joined by one space), k (its first 64 bits)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            found = [_digest(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.string()), pa.array([_class(s) for _, s in found], pa.int64())], ["row", "doc_id", "n_words", "sha", "k"])

    return docs.mapInArrow(of, "row long, doc_id long, n_words long, sha string, k long")


def shared_values(docs: DataFrame, buckets: int, window: int) -> DataFrame:
    """docs: k or doc_id, text, allowed. Values that two classes share, by class: k, values (array of long).

    allowed null: the anchors of all windows; else the hashes of those windows whose anchor is allowed."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for portion in portions(batches):
            for at in range(0, portion.num_rows, ROWS_A_PORTION):
                part = portion.slice(at, ROWS_A_PORTION)
                words = Words(part.column(0))
                classes = np.zeros(part.num_rows, np.int64)
                new = np.zeros(part.num_rows, bool)
                for r, text in enumerate(part.column(0).to_pylist()):
                    if words.count[r] >= window:
                        classes[r] = _class(_digest(text)[1])
                        if int(classes[r]) not in sent:
                            if len(sent) >= 1_000_000:
                                sent.clear()
                            sent.add(int(classes[r]))
                            new[r] = True
                starts, rows, value = _windows(words, window)
                keep = new[rows]
                if part.column(1).null_count < part.num_rows:
                    allowed = part.column(1).to_pylist()
                    cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
                    for r in range(part.num_rows):
                        keep[cuts[r] : cuts[r + 1]] &= np.isin(value[cuts[r] : cuts[r + 1]], np.array(allowed[r] or [], np.int64).view(np.uint64))
                    value = shingles(words.hash, window)[starts] & LOW48 if len(starts) else value
                value, rows = value[keep], rows[keep]
                order = np.argsort(value, kind="stable")
                value, rows = value[order], rows[order]
                first = np.ones(len(value), bool)
                first[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
                value, rows = value[first], rows[first]
                head = np.ones(len(value), bool)
                head[1:] = value[1:] != value[:-1]
                size = np.diff(np.append(np.flatnonzero(head), len(value)))
                known = np.repeat(size > 1, size)
                out = [(*x, False) for x in packed(value[head], rows[head], classes, buckets)] if len(value) else []
                if known.any():
                    # settled: they only pass through, dealt by their owner
                    for r in np.unique(rows[known]):
                        mine = known & (rows == r)
                        bucket = buckets + int(classes[r] % buckets)
                        out.append((bucket, classes[r : r + 1].tobytes(), np.zeros(int(mine.sum()), "<u2").tobytes(), value[mine].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), True))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], ["bucket", "owners", "indexes", "values", "known"])

    def meet(table: pa.Table) -> pa.Table:
        parts = [unpacked(*x) for x in zip(*(table.column(c).to_pylist() for c in ("owners", "indexes", "values")), strict=True)]
        value, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        if not table.column("known")[0].as_py():
            # a value is shared if two owners differ
            starts = np.flatnonzero(np.append(True, value[1:] != value[:-1])[: len(value)])
            ends = np.append(starts[1:], len(value)) - 1
            shared = np.repeat(owner[starts] != owner[ends], ends - starts + 1) if len(starts) else np.zeros(0, bool)
            value, owner = value[shared], owner[shared]
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
        new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))[: len(value)]
        value, owner = value[new], owner[new]
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(value)), pa.int32()), pa.array(value.astype(np.int64)))
        return pa.table([pa.array(owner[cuts], pa.int64()), lists], names=["k", "values"])

    sent = docs.select("text", F.col("allowed").cast("array<long>").alias("allowed")).mapInArrow(send, "bucket long, owners binary, indexes binary, values binary, known boolean")
    met = sent.groupBy("bucket").applyInArrow(meet, "k long, values array<long>")
    return met.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("values"))).alias("values"))


def segments(docs: DataFrame, window: int) -> DataFrame:
    """docs: row, doc_id, text, windows (what is left of them). Runs of windows with one anchor: anchor, row, doc_id, start (word), body (words joined by one space)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            words = Words(part.column(2))
            starts, rows, anchor = _windows(words, window)
            hashes = shingles(words.hash, window)[starts] & LOW48 if len(starts) else anchor
            left, keep = part.column(3).to_pylist(), np.zeros(len(starts), bool)
            cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
            for r in range(part.num_rows):
                keep[cuts[r] : cuts[r + 1]] = np.isin(hashes[cuts[r] : cuts[r + 1]], np.array(left[r] or [], np.int64).view(np.uint64))
            starts, rows, anchor = starts[keep], rows[keep], anchor[keep]
            if not len(starts):
                continue
            new = np.ones(len(starts), bool)
            new[1:] = (starts[1:] != starts[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
            at = np.flatnonzero(new)
            end = starts[np.append(at[1:], len(starts)) - 1] + window
            data = words.data.tobytes()
            lo, hi = words.start[starts[at]], words.end[end - 1]
            body = [b" ".join(data[a:b].split()) for a, b in zip(lo, hi, strict=True)]
            of = pa.array(rows[at])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[at].astype(np.int64)), part.column(0).take(of), part.column(1).take(of), pa.array(starts[at] - words.first[rows[at]], pa.int64()), pa.array(body, pa.binary()).cast(pa.string())], ["anchor", "row", "doc_id", "start", "body"])

    return docs.select("row", "doc_id", "text", "windows").mapInArrow(cut, "anchor long, row long, doc_id long, start long, body string")


def _laid(words: Words, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the rows `of`: their places in words, where they stand in a text in which a place follows each row, and where each row's first one is (and one past the last word)."""
    count = words.count[of]
    first = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(of)), count)
    return np.arange(first[-1]) - first[row] + words.first[of][row], np.arange(first[-1]) + row, first


def rounds(anchor: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which segments are indexed and which are streamed, round by round.

    Segments of one anchor are ranked by id. In the round of a bit, blocks of ranks that agree in all higher bits are halved: the lower half (the bit is 0) is indexed, the upper one streamed. Of two
    ranks the larger is streamed, once, while the smaller is indexed: at the highest bit in which they differ. A segment is never streamed through an index that holds it."""
    order = np.lexsort((doc, anchor))
    new = np.append(True, anchor[order][1:] != anchor[order][:-1])[: len(order)]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(order)))
    rank, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    rank[order], size[order] = np.arange(len(order)) - np.repeat(starts, sizes), np.repeat(sizes, sizes)
    for bit in range(int(sizes.max(initial=1) - 1).bit_length()):
        upper = (rank >> bit & 1).astype(bool)
        yield np.flatnonzero(~upper & ((rank >> bit | 1) << bit < size)), np.flatnonzero(upper)


def streamed(indexed: tuple[np.ndarray, np.ndarray], passing: np.ndarray, ends: np.ndarray, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """indexed: words (hashes) and their places in the indexed text, ids the owner of each of its places; passing: the words of the streamed text, 0 between its rows.

    The matching statistics of the streamed ends, and the smallest owner of each window that reaches the threshold (else the largest number there is)."""
    symbols, inverse = np.unique(indexed[0], return_inverse=True)
    text = np.zeros(len(ids), np.int64)
    text[indexed[1]] = inverse + 1
    index = FMIndex(text, window)
    at = np.minimum(np.searchsorted(symbols, passing), len(symbols) - 1)
    size, low, high = index.matching(np.where(symbols[at] == passing, at + 1, len(symbols) + 1), ends, window)
    least = np.full(len(ends), np.iinfo(np.int64).max)
    found = np.flatnonzero(size >= window)
    if len(found):
        # intervals of whole windows are disjoint or equal
        lows, which = np.unique(low[found], return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[which] = high[found]
        owners = ids[index.order]
        least[found] = np.minimum.reduceat(np.append(owners, owners[-1:]), np.stack([lows, highs], 1).ravel())[::2][which]
    return size, least


def earliest(distinct: DataFrame, window: int) -> DataFrame:
    """distinct: shard, anchor, key, key2, body, doc_id (smallest that has the segment). For each segment the smallest id that has each of its windows: key, key2, least."""

    def search(shard: pa.Table) -> pa.Table:
        words = Words(shard.column("body").combine_chunks())
        doc, anchor = (shard.column(c).to_numpy() for c in ("doc_id", "anchor"))
        starts, rows = within(words.first, window)
        cuts = np.searchsorted(rows, np.arange(words.rows + 1))
        least = doc[rows]
        for low, up in rounds(anchor, doc):
            (a, text, _), (b, passing, first) = _laid(words, low), _laid(words, up)
            ids = np.repeat(doc[low], words.count[low] + 1)
            between = np.zeros(len(b) + len(up), np.uint64)
            between[passing] = words.hash[b]
            begin, _ = within(first, window)
            upper = np.zeros(words.rows, bool)
            upper[up] = True
            mine = np.flatnonzero(upper[rows])
            _, other = streamed((words.hash[a], text), between, passing[begin] + window, ids, window)
            least[mine] = np.minimum(least[mine], other)
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(least, pa.int64()))
        return pa.table([shard.column("key"), shard.column("key2"), lists], names=["key", "key2", "least"])

    return distinct.groupBy("shard").applyInArrow(search, "key long, key2 long, least array<long>")


def _removed(docs: DataFrame, window: int) -> DataFrame:
    """docs: row, doc_id, text, found (array of start, least). row, n_removed, kept_sha256, kept_text, removed (array of start, end in words)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            out = []
            for row, doc, text, found in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = (text or "").encode("utf-8", "replace").split()
                gone = np.zeros(len(words) + 1, np.int64)
                for f in found or []:
                    hit = np.flatnonzero(np.array(f["least"], np.int64) < doc) + f["start"]
                    np.add.at(gone, hit, 1)
                    np.add.at(gone, hit + window, -1)
                lost = np.cumsum(gone)[:-1] > 0
                kept = b" ".join([w for w, x in zip(words, lost, strict=True) if not x])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]])))
                out.append((row, int(lost.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["row", "n_removed", "kept_sha256", "kept_text", "removed"])

    return docs.select("row", "doc_id", "text", "found").mapInArrow(cut, "row long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<start: long, end: long>>")


def repeated(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (null: the words of the text unchanged), removed (intervals of words)."""
    spark = docs.sparkSession
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(digests(docs), "digests")
    able = F.col("doc_id").isNotNull() & (F.col("n_words") >= window)
    classes = rows.where(able).groupBy("sha", "k").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.max("n_words").alias("n"))
    classes = written(classes.select("sha", "k", F.col("rep.doc_id").alias("rep"), F.col("rep.row").alias("row"), "n"), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(LEAST_BUCKETS, -(-total // (5 * VALUES_A_BUCKET)))

    whole = docs.where("doc_id is not null").withColumn("allowed", F.lit(None))
    by_anchor = written(shared_values(whole, buckets, window), "anchors")
    # one row of each class; digests that agree by chance only let more windows through. Texts are read again rather than kept
    of_class = classes.select("k", "row").hint("merge")
    allowed = written(by_anchor.join(of_class, "k").select("row", F.col("values").alias("allowed")), "allowed")
    forget(by_anchor)
    some = rows_with(docs, allowed.select("row"), "row").join(allowed.hint("merge"), "row")
    by_window = written(shared_values(some, buckets, window), "windows")
    forget(allowed)
    windows = written(by_window.join(of_class, "k").select("row", F.col("values").alias("windows")), "screened")
    forget(by_window)
    left = written(rows_with(docs, windows.select("row"), "row").join(windows.hint("merge"), "row"), "left")
    forget(windows)

    cut = segments(left, window)
    cut = written(cut.withColumn("key", F.xxhash64("anchor", "body")).withColumn("key2", F.xxhash64("body", F.lit(1))), "segments")
    distinct = cut.groupBy("anchor", "key", "key2").agg(F.min("doc_id").alias("doc_id"), F.first("body").alias("body"))
    words = cut.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(least, -(-words // (6 * WORDS_A_SHARD)))
    distinct = distinct.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    known = earliest(distinct, window)
    hits = cut.select("row", "doc_id", "start", "key", "key2").join(known.hint("merge"), ["key", "key2"])
    hits = hits.where(F.exists("least", lambda x: x < F.col("doc_id"))).select("row", F.struct("start", "least").alias("hit"))
    found = written(hits.groupBy("row").agg(F.collect_list("hit").alias("found")), "hits")
    forget(cut)
    changed = _removed(rows_with(left.select("row", "doc_id", "text"), found.select("row"), "row").join(found.hint("merge"), "row"), window)

    # results of a class hold for all its rows with the smallest id; rows with other ids are copies, which lose all
    results = classes.select("sha", "rep", "row").join(changed.hint("merge"), "row", "left").drop("row")
    out = rows.join(results.hint("merge"), "sha", "left")
    copy = F.coalesce(able & (F.col("doc_id") > F.col("rep")), F.lit(False))
    first = F.coalesce(F.col("doc_id") == F.col("rep"), F.lit(False))
    nothing = F.array().cast("array<struct<start: bigint, end: bigint>>")
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.when(first, F.coalesce("n_removed", F.lit(0))).otherwise(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(first, F.coalesce("kept_sha256", "sha")).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).when(first, F.col("kept_text")).alias("kept_text"),
        F.when(copy, all_words).when(first, F.coalesce("removed", nothing)).otherwise(nothing).alias("removed"),
    )
