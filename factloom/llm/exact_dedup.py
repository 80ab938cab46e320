"""Exact deduplication against immutable snapshots screened by static binary-fuse filters.

A snapshot is written once and never changes: a table of distinct digests, each with the row that stays and the number of its rows, and for each hash bucket a binary-fuse
filter. Any number of batches can be screened against it (see take and against); it is opened again by its path. Digests of a new batch
are grouped among themselves first; one of each group then probes the filter of its bucket, and only the positives
are joined with the snapshot's exact buckets, where normalised texts are compared byte by byte.

Texts are equal when identical after each run of white space became one space; null counts as empty. Of equal texts
the row with the smallest id stays, null ids last; of repeated rows with one id a single one stays. An empty table
gives an empty result; extra columns are not read. Rows are told apart by their place in the table, which must be read in the same order each time, as files are. One group may
hold any share of the rows: counts are combined before they are shuffled, and only the last join, of rows with their group, is dealt by the digest; there Spark splits a hot group (spark.sql.adaptive.skewJoin).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import free_name
from factloom.llm import fuse
from factloom.llm.store import new_folder, rows_with, written

LEAST_BUCKETS, KEYS_A_BUCKET = 512, 100_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (distinct long), doc_id, text_sha256 (hex), digest (64 bits of another hash, for filters and buckets)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    return rows.select("row", "doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), F.xxhash64("t").alias("digest"))


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")


def grouped(rows: DataFrame) -> DataFrame:
    """Equal digests of one batch or snapshot, map-side first: text_sha256, digest, first (the row that stays), n."""
    return rows.groupBy("text_sha256", "digest").agg(F.min(_order()).alias("first"), F.count("*").alias("n"))


def filters(groups: DataFrame, buckets: int) -> DataFrame:
    """A binary-fuse filter over the digests of each bucket: bucket, filter."""

    def build(table: pa.Table) -> pa.Table:
        keys = table.column("digest").to_numpy().view(np.uint64)
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int64()), "filter": pa.array([fuse.build(keys)], pa.binary())})

    return groups.select(_bucket(buckets), "digest").groupBy("bucket").applyInArrow(build, "bucket long, filter binary")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("long").alias("bucket")


def screened(groups: DataFrame, snapshot_filters: DataFrame, buckets: int) -> DataFrame:
    """The groups of a batch that may be in the snapshot: text_sha256, digest."""

    def probe(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = left.select(["text_sha256", "digest"])
        if not left.num_rows or not right.num_rows:
            return out.slice(0, 0)
        hit = fuse.probe(right.column("filter")[0].as_py(), left.column("digest").to_numpy().view(np.uint64))
        return out.filter(pa.array(hit))

    rows = groups.select(_bucket(buckets), "text_sha256", "digest")
    return rows.groupBy("bucket").cogroup(snapshot_filters.groupBy("bucket")).applyInArrow(probe, "text_sha256 string, digest long")


def _texts(docs: DataFrame, rows: DataFrame, name: str, text_col: str) -> DataFrame:
    """The normalised texts of some rows (a column called name) of docs."""
    numbered = docs.select(F.monotonically_increasing_id().alias(name), F.col(text_col).alias("t"))
    return rows_with(numbered, rows.select(name).distinct(), name).select(name, normalised(F.col("t")).alias(f"{name}_text"))


def same_bytes(docs: DataFrame, snapshot_docs: DataFrame, pairs: DataFrame, text_col: str = "text") -> DataFrame:
    """Of pairs (text_sha256, batch_row, snapshot_row: rows of docs and snapshot_docs) those whose normalised texts agree byte by byte: text_sha256."""
    known = pairs.join(_texts(docs, pairs, "batch_row", text_col), "batch_row").join(_texts(snapshot_docs, pairs, "snapshot_row", text_col), "snapshot_row")
    return known.where(F.col("batch_row_text") == F.col("snapshot_row_text")).select("text_sha256")


@dataclass
class Snapshot:
    """groups: text_sha256, digest, first (no_id, doc_id, row), n; filters: bucket, filter. Both are tables under a path and never change."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def take(rows: DataFrame, path: str) -> Snapshot:
    """Writes a snapshot of rows (see digests) to path."""
    grouped(rows).write.parquet(f"{path}/groups")
    groups = rows.sparkSession.read.parquet(f"{path}/groups")
    buckets = max(LEAST_BUCKETS, -(-groups.count() // KEYS_A_BUCKET))
    filters(groups, buckets).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")
    return opened(rows.sparkSession, path)


def opened(spark: SparkSession, path: str) -> Snapshot:
    """A snapshot that take() wrote before."""
    held = spark.read.parquet(f"{path}/filters")
    first = held.select("buckets").first()
    return Snapshot(spark.read.parquet(f"{path}/groups"), held.drop("buckets"), first[0] if first else LEAST_BUCKETS)


def against(batch: DataFrame, docs: DataFrame, snapshot: Snapshot, snapshot_docs: DataFrame, text_col: str = "text") -> DataFrame:
    """batch: groups of new rows, whose texts are in docs. Adds proved: whether the snapshot, whose texts are in snapshot_docs, holds the same bytes."""
    positive = screened(batch, snapshot.filters, snapshot.buckets)
    exact = positive.join(snapshot.groups.select("text_sha256", "digest", F.col("first.row").alias("snapshot_row")), ["text_sha256", "digest"])
    pairs = written(exact.join(batch.select("text_sha256", F.col("first.row").alias("batch_row")), "text_sha256").select("text_sha256", "batch_row", "snapshot_row"), "positives")
    proved = same_bytes(docs, snapshot_docs, pairs, text_col).select("text_sha256", F.lit(True).alias("proved"))
    return batch.join(proved, "text_sha256", "left").withColumn("proved", F.coalesce("proved", F.lit(False)))


def dedup(docs: DataFrame, in_snapshot: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows where in_snapshot holds become an immutable snapshot, against which the others, the new batch, are screened.

    One row per document: row, doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(digests(docs, id_col, text_col).withColumn("old", F.coalesce(in_snapshot, F.lit(False))), "digests")
    snapshot = take(rows.where("old"), new_folder(docs.sparkSession, "snapshot"))
    new = against(written(grouped(rows.where("not old")), "batch"), docs, snapshot, docs, text_col)
    # a batch group goes with the snapshot's only if its bytes were proved equal
    sides = snapshot.groups.select("text_sha256", F.lit(True).alias("with_old"), F.lit(True).alias("old"), "first", "n").union(new.select("text_sha256", "proved", F.lit(False), "first", "n"))
    whole = sides.groupBy("text_sha256", "with_old").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_set("old").alias("sides"))
    whole = whole.select("text_sha256", F.explode("sides").alias("old"), "first", "n")
    out = rows.join(whole.hint("merge"), ["text_sha256", "old"])
    return out.select("row", "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")


def earlier_half(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Ids up to the middle of their range, as a snapshot for tables that come as one."""
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    return F.col("doc_id") <= ((low or 0) + (high or 0)) // 2


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    row = free_name("row", docs.columns)
    kept = dedup(docs, earlier_half(docs)).where("kept").select(F.col("row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(kept.hint("merge"), row, "left_semi").select(*docs.columns)
