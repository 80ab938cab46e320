"""Summaries that merge: counts, sums and quantile sketches of scores at the finest grain, and their totals over every subset of the columns.

Rows are combined into sketches in each task before anything moves; subtotals are merged from the finest cells, so the rows are read once however many grouping sets there are. A sketch has a fixed size (about SIZE numbers), so
a cell that holds a third of all rows costs no more than another. A quantile has a rank that is off by about ERROR of the cell's rows at most.

Null scores count as rows, but not in sums and quantiles; a cell without scores has null quantiles. Null groups are groups of their own, told from totals by `level` (bits of grouping_id: 1 where a column is summed over,
the first column highest). Repeated rows count each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, ERROR = 400, 0.01  # of sketches


def cells(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """The finest cells: columns `by`, n, n_scores, total, least, most, sketch. Cells of parts of a table are merged by merged()."""
    x = F.col(score).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count(x).alias("n_scores"), F.sum(x).alias("total"), F.min(x).alias("least"), F.max(x).alias("most"), F.kll_sketch_agg_double(x, SIZE).alias("sketch"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Cells of the same groups as one."""
    return parts.groupBy(*by).agg(*_merges())


def _merges() -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("n_scores").alias("n_scores"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", SIZE).alias("sketch")]


def totals(finest: DataFrame, by: list[str]) -> DataFrame:
    """Cells of every subset of the columns `by`, and of all rows: `by` (null where summed over), level, and the columns of cells()."""
    return finest.cube(*by).agg(F.grouping_id().cast("int").alias("level"), *_merges())


def quantiles(summed: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Adds the mean and, by name, the quantiles of the scores."""
    some = F.col("n_scores") > 0
    each = {name: F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(share))) for name, share in shares.items()}
    return summed.withColumn("mean", F.when(some, F.col("total") / F.col("n_scores"))).withColumns(each).drop("sketch")
