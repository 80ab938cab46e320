"""As-of and overlap joins against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import temporal

START = datetime.datetime(2024, 1, 1)


def at(s):
    return None if s is None else START + datetime.timedelta(seconds=s)


def key(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_asof(spark, buckets):
    rng = random.Random(1)
    k = lambda: rng.choice([0, 0, 0, 0, 1, 2, 3, None])
    left = [(i, k(), at(rng.choice([None, *range(0, 900, 3)]))) for i in range(400)] + [(5, 0, at(30)), (5, 0, at(30))]
    right = [(k(), at(rng.choice([None, *range(0, 900, 7)])), rng.choice([None, 1, 2, 3])) for i in range(150)]
    right += [(0, at(30), 2), (0, at(30), 9), (0, at(30), 9), (7, at(1), 1)]
    order = lambda r: (r[1], r[2] is not None, r[2] or 0)  # noqa: E731  null is the smallest
    want = []
    for i, a, t in left:
        fit = [r for r in right if a is not None and r[0] == a and t is not None and r[1] is not None and r[1] <= t]
        best = max(fit, key=order, default=(None, None, None))
        want.append((i, a, t, best[1], best[2]))
    a = spark.createDataFrame(left, "id int, k int, t timestamp").repartition(3)
    b = spark.createDataFrame(right, "k int, since timestamp, v int").repartition(3)
    got = temporal.asof_join(a, b, ["k"], "t", "since", buckets)
    assert got.columns == ["id", "k", "t", "since", "v"] and key(map(tuple, got.collect())) == key(want)
    assert key(map(tuple, temporal.asof_join(a, b.where("false"), ["k"], "t", "since", buckets).collect())) == key((*r, None, None) for r in left)
    assert temporal.asof_join(a.where("false"), b, ["k"], "t", "since", buckets).count() == 0
    with pytest.raises(ValueError):
        temporal.asof_join(a, b.withColumn("id", F.lit(1)), ["k"], "t", "since")


def test_a_hot_key_is_shared_by_buckets(spark):
    a = spark.range(20_000).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("t"))
    b = spark.range(0, 20_000, 50).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("s"), F.col("id").alias("v"))
    got = temporal.asof_join(a, b, ["k"], "t", "s", 32)
    assert got.where("v = floor(unix_seconds(t) / 50) * 50").count() == 20_000
    # one key, but no group of the sort holds more than a few buckets' rows
    cuts = temporal._bounds(b.select(F.col("s").cast("double")), 32)
    sizes = [r["count"] for r in a.select(temporal._bucket(F.col("t").cast("double"), cuts).alias("x")).groupBy("x").count().collect()]
    assert len(sizes) == 32 and max(sizes) < 20_000 / 10


def test_overlaps(spark):
    rng = random.Random(2)
    period = lambda long: (lambda s: (at(s), at(s + rng.choice([0, 0, 1, 5, 20, long]))))(rng.randrange(2000))
    k = lambda: rng.choice([0, 0, 0, 1, 2, None])
    left = [(i, k(), *period(1500)) for i in range(200)] + [(900, 0, at(9), at(3)), (901, 0, None, at(3)), (902, 0, at(3), None), (1, 0, at(-5000), at(9000)), (1, 0, at(-5000), at(9000))]
    right = [(k(), f"r{i}", *period(700)) for i in range(200)] + [(0, "back", at(9), at(3)), (0, "r1", at(100), at(100)), (0, "r1", at(100), at(100))]
    want = [(i, a, s, e, n, u, v) for i, a, s, e in left for b, n, u, v in right if a is not None and a == b and None not in (s, e, u, v) and s <= e and u <= v and s <= v and u <= e]
    x = spark.createDataFrame(left, "id int, k int, s timestamp, e timestamp").repartition(3)
    y = spark.createDataFrame(right, "k int, name string, u timestamp, v timestamp").repartition(3)
    for levels in (temporal.LEVELS, (), (0.01, 0.5)):
        got = temporal.overlaps(x, y, ["k"], ("s", "e"), ("u", "v"), levels)
        assert got.columns == ["id", "k", "s", "e", "name", "u", "v"] and key(map(tuple, got.collect())) == key(want)
    assert temporal.overlaps(x.where("false"), y, ["k"], ("s", "e"), ("u", "v")).count() == 0
    none = temporal.overlaps(x.where("false"), y.where("false"), ["k"], ("s", "e"), ("u", "v"))
    assert none.count() == 0 and set(none.columns) == {"id", "k", "s", "e", "name", "u", "v"}


def test_guests_of_wide_bins_do_not_meet(spark):
    # short periods of one key, and a long one of each table, in whose bin all short ones are guests
    rows = lambda n: spark.range(n).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 5).alias("t"), F.timestamp_seconds(F.col("id") * 5 + F.when(F.col("id") == 0, 100_000).otherwise(2)).alias("u"))
    a, b = rows(2000), rows(3000).select("k", F.col("t").alias("s"), F.col("u").alias("e"))
    got = temporal.overlaps(a, b, ["k"], ("t", "u"), ("s", "e"))
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 2 and not any("own" in x for x in joins)  # which of two rows is a guest decides before they are paired
    assert got.count() == 2000 + 3000 - 1 + 1999


@pytest.mark.parametrize("share", [3, 40, 50_000])
def test_overlap_totals_are_those_of_the_pairs(spark, share):
    rng = random.Random(share)
    period = lambda long: (lambda s: (at(s), at(s + rng.choice([0, 0, 1, 5, 20, long]))))(rng.randrange(2000))
    k = lambda: rng.choice([0, 0, 0, 1, 2, None])
    left = [(rng.choice([i, i, 7]), k(), *period(1500)) for i in range(300)] + [(900, 0, at(9), at(3)), (901, 0, None, at(3)), (902, 0, at(3), None), (1, 0, at(-5000), at(9000)), (1, 0, at(-5000), at(9000)), (903, 5, at(1), at(2))]
    right = [(k(), rng.choice([rng.randrange(-50, 10**6), None]), *period(700)) for i in range(300)] + [(0, 3, at(9), at(3)), (0, -7, at(100), at(100)), (0, 5, at(100), at(100)), (2, 1, at(-9000), at(9000))]
    for kind in ("timestamp", "timestamp_ntz"):
        x = spark.createDataFrame(left, f"id int, k int, s {kind}, e {kind}").repartition(3)
        y = spark.createDataFrame(right, f"k int, x long, u {kind}, v {kind}").repartition(3)
        pairs = temporal.overlaps(x, y, ["k"], ("s", "e"), ("u", "v"))
        want = pairs.groupBy("id").agg(F.count("*"), F.coalesce(F.sum("x"), F.lit(0)), F.min("x")).collect()
        got = temporal.overlap_totals(x, y, ["k"], ("s", "e"), ("u", "v"), ["id"], "x", share)
        assert got.columns == ["id", "n", "total", "least"] and key(map(tuple, got.collect())) == key(map(tuple, want)) and len(want) > 100
    assert temporal.overlap_totals(x.where("false"), y, ["k"], ("s", "e"), ("u", "v"), ["id"], "x").count() == 0
    assert temporal.overlap_totals(x, y.where("false"), ["k"], ("s", "e"), ("u", "v"), ["id"], "x").count() == 0


def test_totals_list_no_pairs(spark):
    """A key whose rows all overlap: pairs are the square of the rows, and none is made."""
    n = 20_000
    a = spark.range(n).select("id", F.lit(1).alias("k"), F.timestamp_seconds("id").alias("s"), F.timestamp_seconds(F.col("id") + n).alias("e"))
    b = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("x"), F.timestamp_seconds("id").alias("u"), F.timestamp_seconds(F.col("id") + n).alias("v"))
    r = temporal.overlap_totals(a, b, ["k"], ("s", "e"), ("u", "v"), ["id"], "x", 1000).agg(F.count("*"), F.sum("n"), F.sum("total"), F.min("least"), F.max("least")).first()
    assert tuple(r) == (n, n * n, n * n * (n - 1) // 2, 0, 0)
