"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share `share` times the words of
all documents; no target exceeds `most` times its source's words, and the excess goes to the others by weight.
A source takes as many complete epochs as its target holds. For the rest, each document draws the key
-ln(u) / quality weight, u from its id (its row number, if it has none), and documents come in the order of their keys while their words fit the
budget; equal keys (repeated ids) come in the order of the rows. The document that would cross it gives way to the one, of all that did not come, whose size is
nearest to what is missing (none, if leaving the gap is nearer).

Prefix sums are made in two levels: sums per key bucket of each source, then rows within the one bucket where the
budget ends. A source of n rows has about sqrt(n) buckets of about sqrt(n) rows, so no task holds a source.

Null and empty texts have size 0 and are taken 0 times as words. Null sources are one source. Repeated rows are ordinary rows, of which some may come and others not. An empty
table gives an empty result. Row numbers are places in the table, which must be read in the same order each time, as files are. The targets are made in one task: a row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import free_name
from factloom.llm.store import small, written

WEIGHTS = (5, 2, 1)
QUALITY = {1: 1.0, 0: 0.5}  # of labels.quality
UNLABELLED = 0.8
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Runs of bytes outside 0x20 and 0x09-0x0D."""
    spaced = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(spaced == "", F.lit(0)).otherwise(F.size(F.split(spaced, " +"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """sizes: a row per source with source, source_size. Adds weight and target, by filling the sources in the order of their limit a weight."""
    turn = Window.orderBy(F.col("source").isNull(), "source")
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    num, den = share
    out = sizes.withColumn("weight", w.cast("long")).withColumn("all", F.sum("source_size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))))
    out = out.withColumn("full", F.coalesce(F.sum("source_size").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most)
    out = out.withColumn("open", F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
    # the level at which this and all later sources would share what is left; whole numbers as long as possible
    out = out.withColumn("left", F.col("all") * num - F.col("full") * den)
    capped = F.col("left") * F.col("weight") >= F.col("source_size") * most * den * F.col("open")
    out = out.withColumn("capped", capped)
    # the first source in order that stays below its limit fixes the level for itself and all later ones
    level = F.first(F.when(~F.col("capped"), F.struct("left", "open")), ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("level", level)
    shared = (F.col("level.left") * F.col("weight")).cast("double") / (F.col("level.open") * den).cast("double")
    return out.select("source", "source_size", "weight", F.when(F.col("level").isNull(), (F.col("source_size") * most).cast("double")).otherwise(shared).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """docs: doc_id, text, source. quality: doc_id, quality (0 or 1), or None.

    One row per document: doc_id, size, source_size, target, taken, times (that the document comes), source, row (its number by monotonically_increasing_id)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row"))
    if quality is not None:
        grade = quality.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
        rows = rows.join(grade, "doc_id", "left")
    else:
        rows = rows.withColumn("quality", F.lit(None).cast("int"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string"))))), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    weight = F.when(F.col("quality") == 1, QUALITY[1]).when(F.col("quality") == 0, QUALITY[0]).otherwise(UNLABELLED)
    # sizes and keys are made once from the texts; all that follows reads this narrow table
    rows = written(rows.withColumn("key", -F.log(u) / weight).drop("quality"), "mix-rows")

    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    plan = targets(sources).join(sources.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long"))
    plan = plan.withColumn("buckets", F.ceil(F.sqrt(F.col("rows"))))
    plan = written(plan.withColumnRenamed("source", "p_source"), "mix-plan")
    known = rows.join(small(plan), F.col("source").eqNullSafe(F.col("p_source")))
    # 1 - exp(-key) spreads the keys about evenly and keeps their order
    known = known.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")).cast("long"))

    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = known.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("budget").alias("limit"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    ends = sums.where((F.col("before") <= F.col("limit")) & (F.col("before") + F.col("words") > F.col("limit")))
    ends = written(ends.select(F.col("source").alias("e_source"), F.col("bucket").alias("e_bucket"), "before"), "mix-ends")
    inner = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    at_end = known.join(small(ends), F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("e_bucket")))
    at_end = at_end.withColumn("upto", F.sum("size").over(inner) + F.col("before"))
    # the order of a source ends before its first row that does not fit
    fit = at_end.groupBy("source").agg(F.max("e_bucket").alias("f_bucket"), F.min(F.when(F.col("upto") > F.col("budget"), F.struct("key", "doc_id", "size", "row"))).alias("stop"), F.max("before").alias("base"), F.max(F.when(F.col("upto") <= F.col("budget"), F.col("upto"))).alias("taken_upto"), F.max("budget").alias("limit"))
    fit = written(fit.select(F.col("source").alias("f_source"), "f_bucket", "stop", (F.col("limit") - F.coalesce("taken_upto", "base")).alias("gap")), "mix-fit")
    here = F.col("source").eqNullSafe(F.col("f_source"))
    order = F.struct("key", "doc_id", "size", "row")
    seen = known.join(small(fit), here, "left")
    seen = seen.withColumn("comes", F.col("f_bucket").isNull() & (F.col("budget") > 0) | (F.col("bucket") < F.col("f_bucket")) | ((F.col("bucket") == F.col("f_bucket")) & (order < F.col("stop"))))
    spare = seen.where(F.col("stop").isNotNull() & ~F.col("comes") & (F.col("size") > 0) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
    spare = spare.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("miss"), "key", "doc_id", "size", "row")).alias("fill"))
    spare = written(spare.select(F.col("source").alias("x_source"), "fill"), "mix-spare")
    out = seen.join(small(spare), F.col("source").eqNullSafe(F.col("x_source")), "left")
    extra = F.coalesce(F.col("comes"), F.lit(False)) | (order.eqNullSafe(F.struct("fill.key", "fill.doc_id", "fill.size", "fill.row")) & F.col("fill").isNotNull())
    times = (F.col("epochs") + F.when(extra, 1).otherwise(0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"), "source", "row")


def mixture(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The rows of docs (a table that is read in the same order each time), each as often as the mix takes it."""
    row, times, turn = (free_name(c, docs.columns) for c in ("row", "times", "turn"))
    found = mix(docs, quality).where("times > 0").select(F.col("row").alias(row), F.sequence(F.lit(1).cast("long"), "times").alias(times))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(found.hint("merge"), row).withColumn(turn, F.explode(times)).select(*docs.columns)
