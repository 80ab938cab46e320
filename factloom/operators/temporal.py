"""Joins by time: the latest version before a moment, and periods that overlap.

All cut time into buckets, so that one key with very many rows is shared by many tasks, and neither compares rows of different keys or distant times. Keys and times that are null match nothing; rows of the left table
stay in an as-of join, with nulls. Repeated rows are joined each. Empty tables give what follows from that: all left rows without a match, or no pairs. Names that both tables use must be renamed by the caller: they raise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import free_name

BUCKETS = 64  # of time, for each key
ERROR = 0.001  # of the quantiles that bound the buckets
SHARE = 50_000  # rows of both tables for which overlap_totals has a bucket
NEVER = np.iinfo(np.int64).max
LEVELS = (0.5, 0.75, 0.9, 0.97)  # quantiles of length that bound the classes of periods


def _seconds(time: Column) -> Column:
    return time.cast("timestamp").cast("double")


def _quantiles(numbers: DataFrame, shares: list[float]) -> list[float]:
    """Quantiles of the only column; none of an empty table."""
    return numbers.approxQuantile(numbers.columns[0], shares, ERROR) if shares else []


def _bounds(times: DataFrame, buckets: int) -> list[float]:
    """Times between which about as many rows lie: a row of numbers, whatever the size of the table."""
    return sorted(set(_quantiles(times, [i / buckets for i in range(1, buckets)])))


def _bucket(time: Column, bounds: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b <= time)) if bounds else F.lit(0)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, buckets: int = BUCKETS) -> DataFrame:
    """Left rows with the columns of the latest right row of the same keys (columns `by` of both) at or before their time; of equally late ones the largest row, column by column.

    Both tables are sorted together within buckets of time, and the last right row of each bucket is carried on to later ones: a key has one row a bucket for that, not all its rows."""
    extra = [c for c in right.columns if c not in by]
    if {c.lower() for c in extra} & {c.lower() for c in left.columns}:
        raise ValueError("columns of the right table have names of the left one")
    taken = [*left.columns, *right.columns]
    time, found, row, bucket, kept = (free_name(c, taken) for c in ("asof_time", "asof_found", "asof_row", "asof_bucket", "asof_kept"))
    version = F.struct(F.col(right_time).alias("t"), F.struct(*(F.col(c) for c in extra)).alias("r"))
    whole = F.struct(*(F.col(c) for c in left.columns))
    a = left.select(*by, _seconds(F.col(left_time)).alias(time), whole.alias(row))
    b = right.where(F.col(right_time).isNotNull()).select(*by, _seconds(F.col(right_time)).alias(time), version.alias(found))
    for c in by:
        b = b.where(F.col(c).isNotNull())
    bounds = _bounds(b.select(time), buckets)
    both = a.withColumn(found, F.lit(None).cast(b.schema[found].dataType)).unionByName(b.withColumn(row, F.lit(None).cast(a.schema[row].dataType)))
    both = both.withColumn(bucket, _bucket(F.col(time), bounds))
    # versions come before left rows of the same time, ordered among themselves
    order = [F.col(time), F.col(row).isNotNull(), F.col(found)]
    here = F.last(found, ignorenulls=True).over(Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    lasts = b.withColumn(bucket, _bucket(F.col(time), bounds)).groupBy(*by, bucket).agg(F.max(found).alias(found))
    # of each key: the last version of a bucket counts in all later buckets up to the next that has one
    until = F.coalesce(F.lead(bucket).over(Window.partitionBy(*by).orderBy(bucket)), F.lit(len(bounds)))
    lasts = lasts.select(*by, F.col(found).alias(kept), F.col(bucket).alias(time), until.alias(found))
    carried = lasts.select(*by, kept, F.explode(F.sequence(F.col(time) + 1, F.greatest(F.col(found), F.col(time) + 1))).alias(bucket))
    rows = both.withColumn(found, here).where(F.col(row).isNotNull())
    rows = rows.join(carried, [*by, bucket], "left")
    best = F.when(F.col(time).isNotNull(), F.coalesce(found, kept))
    return rows.select(row, best.alias(found)).select(f"{row}.*", *(F.col(found)["r"][c].alias(c) for c in extra))


def _valid(rows: DataFrame, by: list[str], period: tuple[str, str]) -> DataFrame:
    """Rows with keys whose period does not end before it begins."""
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    return rows.where(F.col(period[0]) <= F.col(period[1]))


def overlaps(left: DataFrame, right: DataFrame, by: list[str], left_period: tuple[str, str], right_period: tuple[str, str], levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Pairs of a left and a right row of the same keys whose periods (first and last moment, both included) share a moment, each pair once.

    Periods fall into classes of length, bounded by quantiles; a class has bins as long as its longest period, so a period touches two at most. A pair meets in the bins of its longer class: periods are put
    into those of their own class and, with the mark that they are guests, of all longer ones; guests do not meet guests. It counts in the one bin in which the later of the two begins. Periods that end before they begin match nothing."""
    if {c.lower() for c in left.columns if c not in by} & {c.lower() for c in right.columns}:
        raise ValueError("both tables have columns of one name")
    taken = [*left.columns, *right.columns]
    names = {k: free_name(f"overlap_{k}", taken) for k in ("a", "b", "level", "bin", "a_own", "b_own")}

    sides = [_valid(left, by, left_period), _valid(right, by, right_period)]
    lengths = [rows.select((_seconds(F.col(p[1])) - _seconds(F.col(p[0]))).alias("n")) for rows, p in zip(sides, (left_period, right_period), strict=True)]
    every = lengths[0].unionByName(lengths[1])
    longest = every.agg(F.max("n")).first()[0]
    if longest is None:
        return left.where("false").join(right.where("false"), by)
    widths = sorted({max(w, 1.0) for w in [*_quantiles(every, list(levels)), longest]})

    def placed(rows: DataFrame, period: tuple[str, str], side: str) -> DataFrame:
        start, end = (_seconds(F.col(c)) for c in period)
        own = F.size(F.filter(F.array(*map(F.lit, widths)), lambda w: w < end - start))
        bins = [F.when(F.lit(i) >= own, F.struct(F.lit(i).alias("level"), F.sequence(F.floor(start / w), F.floor(end / w)).alias("bins"), (own == i).alias("own"))) for i, w in enumerate(widths)]
        out = rows.select(F.struct(*rows.columns).alias(names[side]), *by, F.explode(F.array_compact(F.array(*bins))).alias("at"))
        return out.select(names[side], *by, F.col("at.level").alias(names["level"]), F.explode("at.bins").alias(names["bin"]), F.col("at.own").alias(names[f"{side}_own"]))

    left_rows, right_rows = placed(sides[0], left_period, "a"), placed(sides[1], right_period, "b")
    on = [*by, names["level"], names["bin"]]
    # guests of both tables are kept apart before they are joined: a wide bin holds nearly all rows of a key as guests
    met = left_rows.where(names["a_own"]).join(right_rows, on).unionByName(left_rows.where(~F.col(names["a_own"])).join(right_rows.where(names["b_own"]), on))
    a, b = F.col(names["a"]), F.col(names["b"])
    later = F.greatest(_seconds(a[left_period[0]]), _seconds(b[right_period[0]]))
    width = F.get(F.array(*map(F.lit, widths)), F.col(names["level"]))
    pairs = met.where((a[left_period[0]] <= b[right_period[1]]) & (b[right_period[0]] <= a[left_period[1]])).where(F.floor(later / width) == F.col(names["bin"]))
    return pairs.select(*(a[c].alias(c) for c in left.columns), *(b[c].alias(c) for c in right.columns if c not in by))


def _micros(time: Column, local: bool) -> Column:
    """A moment as a whole number, in its order; local: times without a zone, which no zone may move."""
    if not local:
        return F.unix_micros(time.cast("timestamp"))
    seconds = (F.unix_date(time.cast("date")).cast("long") * 24 + F.hour(time)) * 60 + F.minute(time)
    return seconds * 60_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


def _range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first:last] for many ranges: the least of all runs of a power of two are made once, and two of them cover a range."""
    out, size = np.full(len(first), NEVER), last - first
    runs, width = values, 1
    while width <= len(values):
        here = (size >= width) & (size < 2 * width)
        out[here] = np.minimum(runs[first[here]], runs[last[here] - width])
        runs = np.minimum(runs[:-width], runs[width:]) if len(runs) > width else runs[:0]
        width *= 2
    return out


def _least_over(points: int, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of each of some points the least value of the ranges [first, last) of points that hold it: each range is laid on two runs of a power of two, and runs are halved down to points."""
    size, top = last - first, int(points).bit_length()
    runs = np.full(max(points, 1), NEVER)
    for width in (1 << k for k in range(top, -1, -1)):
        # runs: the least of those that begin here and are twice as long
        half = runs.copy()
        half[width:] = np.minimum(half[width:], runs[: len(runs) - width] if width < len(runs) else runs[:0])
        here = (size >= width) & (size < 2 * width)
        np.minimum.at(half, first[here], values[here])
        np.minimum.at(half, last[here] - width, values[here])
        runs = half
    return runs[:points]


def _bucket_totals(of: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Of one key and bucket: counts, sums and least values for the left rows that begin or end in it. Rows: see overlap_totals."""

    def numbers(table: pa.Table, name: str, null: int) -> np.ndarray:
        return table[name].fill_null(null).to_numpy().astype(np.int64)

    def totals(table: pa.Table) -> pa.Table:
        role = table["role"].to_numpy()
        left, right, before = (table.filter(pa.array(role == r)) for r in (0, 1, 2))
        begins, ends = (~left[c].is_null().to_numpy() for c in ("first", "last"))
        first, last = numbers(left, "first", -NEVER), numbers(left, "last", NEVER)
        n, total = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        own, value, known = numbers(right, "value", 0), numbers(right, "value", NEVER), {}
        for side, name in (("starts", "first"), ("stops", "last")):
            has = ~right[name].is_null().to_numpy()
            at = numbers(right, name, 0)[has]
            order = np.argsort(at, kind="stable")
            known[side] = at[order], np.concatenate([[0], np.cumsum(own[has][order])]), value[has][order]
        (starts, start_sums, start_values), (stops, stop_sums, _) = known["starts"], known["stops"]
        offset = {c: int(numbers(before, c, 0).sum()) for c in ("n_starts", "n_stops", "starts", "stops")}
        # right rows that have begun by the end, less those that were over before the beginning
        until, over = np.searchsorted(starts, last, "right"), np.searchsorted(stops, first, "left")
        n += np.where(ends, until + offset["n_starts"], 0) - np.where(begins, over + offset["n_stops"], 0)
        total += np.where(ends, start_sums[until] + offset["starts"], 0) - np.where(begins, stop_sums[over] + offset["stops"], 0)
        least = _range_least(start_values, np.searchsorted(starts, first, "left"), until)
        # those that go on at the beginning
        points = np.sort(first[begins])
        a = np.searchsorted(points, numbers(right, "first", -NEVER), "right")
        b = np.searchsorted(points, numbers(right, "last", NEVER), "right")
        some = a < b
        on = _least_over(len(points), value[some], a[some], b[some])
        on = np.minimum(on, numbers(before, "value", NEVER).min(initial=NEVER))
        if len(points):
            least[begins] = np.minimum(least[begins], on[np.searchsorted(points, first[begins], "left")])
        return pa.table({**{c: left[c] for c in of}, "n": pa.array(n), "total": pa.array(total), "least": pa.array(least, mask=least == NEVER)})

    return totals


def overlap_totals(left: DataFrame, right: DataFrame, by: list[str], left_period: tuple[str, str], right_period: tuple[str, str], of: list[str], value: str, share: int = SHARE) -> DataFrame:
    """What overlaps() pairs, counted without listing the pairs, whose number may grow with the square of the rows: columns `of` of the left table (their groups), n (pairs), total and least (of a whole number of the right table). Groups without a pair are left out.

    n and total are differences: right rows that have begun by a period's end, less those that were over before its beginning. least is the smaller of two: over those that begin within the period, and over those
    that go on at its beginning. Time is cut into buckets, one for each `share` rows; a left row goes to the buckets of its two ends, a right row too, and what lies between counts by whole buckets. So rows move
    once, and a task holds a key's rows of a bucket (all rows of one moment are in one). A null value counts as a pair, but not in total (0 if there is no other) and least (null)."""
    if {c.lower() for c in left.columns if c not in by} & {c.lower() for c in right.columns}:
        raise ValueError("both tables have columns of one name")
    a, b = _valid(left, by, left_period), _valid(right, by, right_period)
    local = all(isinstance(rows.schema[c].dataType, T.TimestampNTZType) for rows, p in ((left, left_period), (right, right_period)) for c in p)
    moment = lambda c: _micros(F.col(c), local)
    keys = [F.col(c).alias(f"key_{i}") for i, c in enumerate(by)]
    on, groups = [f"key_{i}" for i in range(len(by))], [f"of_{i}" for i in range(len(of))]
    a = a.select(*keys, *(F.col(c).alias(g) for c, g in zip(of, groups, strict=True)), moment(left_period[0]).alias("t"), moment(left_period[1]).alias("u"))
    b = b.select(*keys, F.col(value).cast("long").alias("value"), moment(right_period[0]).alias("t"), moment(right_period[1]).alias("u"))
    times = a.select(F.col("t").cast("double").alias("t")).unionByName(b.select(F.col("t").cast("double").alias("t")))
    cuts = np.array(_bounds(times, max(1, -(-times.count() // share))), np.float64).astype(np.int64)

    @F.pandas_udf("int")
    def bucket(time: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, time.to_numpy(), "right").astype(np.int32))

    a, b = (rows.withColumns({"from": bucket("t"), "to": bucket("u")}) for rows in (a, b))
    here = F.col("from") == F.col("to")
    none = F.lit(None).cast("long")
    # one row for each end of a period, or one for both; an end elsewhere is null
    both = lambda rows: rows.withColumn("end", F.explode(F.when(here, F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2))))).select(
        "*", F.when(F.col("end") < 2, F.col("from")).otherwise(F.col("to")).alias("bucket"), F.when(F.col("end") < 2, F.col("t")).alias("first"), F.when(F.col("end") != 1, F.col("u")).alias("last")
    )
    parts, pieces = both(a), both(b)
    between = lambda rows: rows.where("to > `from` + 1").select("*", F.explode(F.sequence(F.col("from") + 1, F.col("to") - 1)).alias("bucket"))
    # right rows of whole buckets: those that begin, that stop, and the least of those that go through
    began, stopped = F.col("first").isNotNull(), F.col("last").isNotNull()
    sums = pieces.groupBy(*on, "bucket").agg(
        F.count_if(began).alias("n_starts"), F.count_if(stopped).alias("n_stops"), F.coalesce(F.sum(F.when(began, F.col("value"))), F.lit(0)).alias("starts"), F.coalesce(F.sum(F.when(stopped, F.col("value"))), F.lit(0)).alias("stops"), F.min(F.when(began, F.col("value"))).alias("least"),
    )
    through = between(b.groupBy(*on, "from", "to").agg(F.min("value").alias("value"))).groupBy(*on, "bucket").agg(F.min("value").alias("value"))
    counted = ("n_starts", "n_stops", "starts", "stops")
    every = sums.select(*on, "bucket", *counted, none.alias("value")).unionByName(through.select(*on, "bucket", *(F.lit(0).cast("long").alias(c) for c in counted), "value"))
    every = every.unionByName(parts.select(*on, "bucket").distinct().select(*on, "bucket", *(F.lit(0).cast("long").alias(c) for c in counted), none.alias("value")))
    every = every.groupBy(*on, "bucket").agg(*(F.sum(c).alias(c) for c in counted), F.min("value").alias("value"))
    earlier = Window.partitionBy(*on).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = every.select(*on, "bucket", "value", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in counted))

    kinds = {g: a.schema[g].dataType for g in groups}
    shape = lambda rows, role, **made: rows.select(
        *on, "bucket", F.lit(role).alias("role"), *(made.get(g, F.lit(None)).cast(kinds[g]).alias(g) for g in groups), *(made.get(c, none).cast("long").alias(c) for c in ("first", "last", "value", *counted))
    )
    take = lambda *names: {c: F.col(c) for c in names}
    rows = shape(parts, 0, **take(*groups, "first", "last")).unionByName(shape(pieces, 1, **take("first", "last", "value"))).unionByName(shape(before, 2, **take("value", *counted)))
    schema = T.StructType([*(T.StructField(g, kinds[g]) for g in groups), *(T.StructField(c, T.LongType()) for c in ("n", "total", "least"))])
    found = rows.groupBy(*on, "bucket").applyInArrow(_bucket_totals(groups), schema)
    # left rows over whole buckets
    spans = between(a.select(*on, "from", "to").where("to > `from` + 1").distinct()).join(sums.select(*on, "bucket", "least"), [*on, "bucket"]).groupBy(*on, "from", "to").agg(F.min("least").alias("least"))
    over = a.where("to > `from` + 1").join(spans, [*on, "from", "to"]).select(*groups, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"), "least")
    out = found.unionByName(over).groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least")).where("n > 0")
    return out.select(*(F.col(g).alias(c) for g, c in zip(groups, of, strict=True)), "n", "total", "least")
