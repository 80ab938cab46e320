"""Merkle manifest of a dataset: a tree for each source, a tree of the sources' roots, and a proof for every row.

A leaf is the SHA-256 of a row's fields, so texts are read once and never move. Leaves are sorted into runs (ranges of source, id, leaf and row number, so that neither a large source
nor repeated rows fill a task), and a row's place in its source is its place in the run and what earlier runs hold. The node store is a Parquet table with a partition for each
level: every level is made from the one below it alone, `fan` neighbours a node, and keeps their digests. Proofs come from the top down: each level meets the
one above it in the order of the coordinates (tree, place div fan), a merge join, and takes over the path of its parent. A path is carried by nodes, not by leaves, until the
last join, so what moves is about a third of a path a row. Levels of at most SMALL_LEVEL nodes are broadcast instead, a bound in bytes, as a path has two digests a level.

Fields: `-` if null, else the number of UTF-8 bytes, a colon, the value. Leaves of a source ascend by id, rows without an id first, equal ids by their leaf; equal rows are interchangeable.
Sources ascend by their bytes, null first; an empty text is a value, not null. Runs of the last neighbours of a level may be shorter, down to one. Of an empty table the manifest has no
root and the result is empty. Further columns of the table are not read, those that are missing fail. A source that is the only one is still hashed as no run: one subroot is the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.store import new_folder, small, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SMALL_LEVEL = 4096  # nodes


def field(value: Column) -> Column:
    """A field as it is hashed."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*inputs: Column) -> Column:
    """Lowercase hex SHA-256 of the inputs, one after the other."""
    return F.sha2(F.concat(*inputs), 256)


def newlines_deleted(docs: DataFrame) -> Column:
    """The tampering of the query: texts of every other id (by its CRC-32) lose their line feeds; null where nothing changes."""
    return F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n")), F.replace("text", F.lit("\n"), F.lit("")))


@dataclass
class Manifest:
    """leaves: doc_id, leaf, altered (the leaf of the tampered row, null if it is the same), g (number of the source), idx, n (leaves of the source), subroot.
    store: the folder of the nodes, by tree (documents, sources) and level; levels of each tree, lowest first: g, idx, n (nodes of the tree on this level), digest, children."""

    leaves: DataFrame
    sources: DataFrame
    trees: dict[str, list[DataFrame]]
    store: str
    root: str | None
    fan: int


def _placed(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows as sorted runs (with run and line), and of each group and run: base (line less base is the place in the group), n (rows of the group)."""
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    runs = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    runs = written(runs.withColumn("run", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id()), name)
    parts = runs.groupBy(group, "run").agg(F.min("line").alias("first"), F.count("*").alias("rows"))
    earlier = F.coalesce(F.sum("rows").over(Window.partitionBy(group).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return runs, parts.select(group, "run", (F.col("first") - earlier).alias("base"), F.sum("rows").over(Window.partitionBy(group)).alias("n"))


def _levels(leaves: DataFrame, most: int, fan: int, store: str) -> list[DataFrame]:
    """The levels above leaves (g, idx, n, digest), of which the largest tree has `most`, each written before the next reads it."""
    made, below = [], leaves
    while most > 1:
        turn, parent = F.col("idx") % fan, F.expr(f"idx div {fan}")
        slots = [F.max(F.when(turn == i, F.col("digest"))).alias(f"c{i}") for i in range(fan)]
        up = below.where("n > 1").groupBy("g", parent.alias("idx"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n")).agg(*slots)
        up = up.select("g", "idx", "n", F.array_compact(F.array(*(f"c{i}" for i in range(fan)))).alias("children"))
        up = up.select("g", "idx", "n", F.sha2(F.array_join("children", ""), 256).alias("digest"), "children")
        folder = f"{store}/level={len(made) + 1}"
        up.write.parquet(folder)
        below = leaves.sparkSession.read.schema("g long, idx long, n long, digest string, children array<string>").parquet(folder)
        made.append(below)
        most = -(-most // fan)
    return made


def _step(children: Column, at: Column) -> Column:
    """What stands left and right of a node in its run."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), at), "").alias("left"), F.array_join(F.slice(children, at + 2, F.size(children)), "").alias("right"))


def _extended(nodes: DataFrame, above: DataFrame, fan: int, columns: list[str]) -> DataFrame:
    """nodes (g, idx, columns) with their path: their own step, then the path of their parent in above (g, idx, children, path; children are null where there is no step)."""
    up = above.select("g", F.col("idx").alias("parent"), F.col("children").alias("run"), F.col("path").alias("rest"))
    met = nodes.withColumn("parent", F.expr(f"idx div {fan}")).join(up, ["g", "parent"])
    at = (F.col("idx") % fan).cast("int")
    return met.select("g", "idx", *columns, F.when(F.col("run").isNull(), F.col("rest")).otherwise(F.array_prepend("rest", _step(F.col("run"), at))).alias("path"))


def _parents(levels: list[DataFrame], roots: DataFrame, fan: int) -> DataFrame:
    """Paths of the lowest level's nodes, from the top down; a tree of one leaf has a parent without children. roots: g, n, path. Returns g, idx, children, path."""
    here = None
    for level in reversed(levels):
        rows = level.select("g", "idx", "n", "children")
        tops = rows.where("n = 1").join(small(roots.select("g", "path")), "g").select("g", "idx", "children", "path")
        if here is None:
            here = tops
        else:
            few = level.count() <= SMALL_LEVEL
            here = _extended(rows.where("n > 1"), F.broadcast(here) if few else here.hint("merge"), fan, ["children"]).select("g", "idx", "children", "path").unionByName(tops)
    lone = roots.where("n = 1").select("g", F.lit(0).cast("long").alias("idx"), F.lit(None).cast("array<string>").alias("children"), "path")
    return lone if here is None else here.unionByName(lone)


def build(docs: DataFrame, tampered: Column | None = None, fan: int = 3) -> Manifest:
    """docs: the columns of FIELDS. tampered: what the text is replaced by in altered leaves, null where it stays."""
    spark, store = docs.sparkSession, new_folder(docs.sparkSession, "merkle-nodes")
    fields = [field(F.col(c)) for c in FIELDS[:-1]]
    other = F.lit(None).cast("string") if tampered is None else tampered
    rows = docs.select("doc_id", "source", digest(*fields, field(F.col("text"))).alias("leaf"), F.when(other.isNotNull(), digest(*fields, field(other))).alias("altered"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    runs, parts = _placed(rows, "source", ["doc_id", "leaf", "row"], "merkle-runs")
    parts = written(parts, "merkle-parts")
    sources, turns = _placed(parts.groupBy("source").agg(F.max("n").alias("leaves")).withColumn("g", F.lit(0).cast("long")), "g", ["source"], "merkle-sources")
    sources = sources.join(small(written(turns, "merkle-turns")), ["g", "run"]).select("source", "leaves", (F.col("line") - F.col("base")).alias("idx"), "n")
    sources = written(sources, "merkle-numbered")
    numbers = sources.select(F.col("source").alias("of"), F.col("idx").alias("g"))
    parts = written(parts.join(small(numbers), F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("run").alias("in"), "base", "n", "g"), "merkle-bases")
    leaves = runs.join(small(parts), F.col("source").eqNullSafe(F.col("of")) & (F.col("run") == F.col("in")))
    leaves = leaves.select("doc_id", "leaf", "altered", "g", (F.col("line") - F.col("base")).alias("idx"), "n")

    most, count = parts.agg(F.max("n"), F.max("g")).first()
    nodes = leaves.select("g", "idx", "n", F.col("leaf").alias("digest"))
    levels = _levels(nodes, most or 0, fan, f"{store}/tree=documents")
    tops = nodes.where("n = 1")
    for level in levels:
        tops = tops.unionByName(level.where("n = 1").select("g", "idx", "n", "digest"))
    subroots = written(tops.select(F.col("g").alias("idx"), "digest"), "merkle-subroots")
    sources = sources.join(subroots.hint("merge"), "idx").select(F.lit(0).cast("long").alias("g"), "idx", "n", "digest", "source", "leaves")
    sources = written(sources, "merkle-tree")
    above = _levels(sources.select("g", "idx", "n", "digest"), 0 if count is None else count + 1, fan, f"{store}/tree=sources")
    last = (above[-1] if above else sources).where("n = 1").select("digest").first()
    return Manifest(leaves, sources, {"documents": levels, "sources": above}, store, last and last[0], fan)


def proofs(made: Manifest) -> DataFrame:
    """One row per leaf: doc_id, leaf, altered, g, idx, subroot, path (array of left and right: the digests beside the node in its run, from the leaf's run to the root's)."""
    spark = made.leaves.sparkSession
    roots = spark.createDataFrame([(0, [])], "g long, path array<struct<left:string,right:string>>").join(made.sources.groupBy("g").agg(F.max("n").alias("n")), "g")
    subroots = _extended(made.sources, _parents(made.trees["sources"], roots, made.fan), made.fan, ["leaves", "digest"])
    subroots = written(subroots.select(F.col("idx").alias("g"), F.col("leaves").alias("n"), "path", F.col("digest").alias("subroot")), "merkle-paths")
    parents = _parents(made.trees["documents"], subroots, made.fan)
    out = _extended(made.leaves, parents.hint("merge"), made.fan, ["doc_id", "leaf", "altered"])
    return out.join(small(subroots.select("g", "subroot")), "g").select("doc_id", "leaf", "altered", "g", "idx", "subroot", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def verified(docs: DataFrame, tampered: Column | None = None, fan: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256 (of the siblings), folded_root (from the altered leaf, if there is one), verified."""
    made = build(docs, tampered, fan)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = proofs(made).select("doc_id", "leaf", "subroot", F.lit(made.root).cast("string").alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
