"""Mergeable summaries and sessions: bounds, subtotals, and streams that agree with tables."""

import bisect
import collections
import datetime
import random

from pyspark.sql import functions as F

from factloom.operators import sessions, summaries

BY = ["kind", "month"]


def scores():
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([1, 2, None]), rng.choice([None, rng.gauss(50, 20), rng.expovariate(0.1), 7.0])) for _ in range(30_000)]
    return [*rows, ("none", 3, None), ("one", 3, 5.0)]


def test_subtotals_and_rank_errors(spark):
    rows = scores()
    df = spark.createDataFrame(rows, "kind string, month int, score double").repartition(5)
    shares = {"q10": 0.1, "median": 0.5, "q99": 0.99}
    got = summaries.quantiles(summaries.totals(summaries.cells(df, BY, "score"), BY), shares).collect()
    want = collections.defaultdict(list)
    for kind, month, score in rows:
        for level in range(4):
            want[(None if level & 2 else kind, None if level & 1 else month, level)].append(score)
    assert len(got) == len(want)
    for r in got:
        every = want[r.kind, r.month, r.level]
        some = sorted(x for x in every if x is not None)
        assert (r.n, r.n_scores) == (len(every), len(some))
        if not some:
            assert r["mean"] is None and r["median"] is None and r.total is None
            continue
        assert abs(r["mean"] - sum(some) / len(some)) < 1e-6 and (r.least, r.most) == (some[0], some[-1])
        for name, share in shares.items():
            low, high = bisect.bisect_left(some, r[name]) / len(some), bisect.bisect_right(some, r[name]) / len(some)
            assert low - summaries.ERROR <= share <= high + summaries.ERROR + 1 / len(some)
    assert summaries.totals(summaries.cells(df.where("false"), BY, "score"), BY).where("n > 0").count() == 0


def test_parts_merge(spark):
    df = spark.createDataFrame(scores(), "kind string, month int, score double")
    parts = [summaries.cells(df.where(F.pmod(F.hash("score"), F.lit(3)) == i), BY, "score") for i in range(3)]
    one = summaries.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), BY)
    columns = [*BY, "n", "n_scores", "least", "most"]
    key = lambda d: sorted(str(r) for r in d.select(columns).collect())
    assert key(one) == key(summaries.cells(df, BY, "score"))


START = datetime.datetime(2024, 1, 1)
EVENTS = "user long, ts timestamp, value long"


def plain(rows, gap):
    by, out = collections.defaultdict(list), []
    for user, ts, value in rows:
        if user is not None and ts is not None:
            by[user].append((ts, value))
    for user, some in by.items():
        run = []
        for ts, value in sorted(some):
            if run and (ts - run[-1][0]).total_seconds() > gap:
                out.append((user, run[0][0], run[-1][0], len(run), sum(v for _, v in run)))
                run = []
            run.append((ts, value))
        out.append((user, run[0][0], run[-1][0], len(run), sum(v for _, v in run)))
    return sorted(out)


def events(rng, n):
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), START + datetime.timedelta(seconds=rng.randrange(40_000)), rng.randrange(9)) for _ in range(n)]
    # pauses of exactly the gap are within a session
    return rows + [(7, START, 1), (7, START + datetime.timedelta(seconds=60), 1), (7, START + datetime.timedelta(seconds=119), 1), (8, None, 1), rows[0], rows[0]]


def test_sessions_of_a_table(spark):
    rows = events(random.Random(2), 900)
    got = sessions.sessions(spark.createDataFrame(rows, EVENTS), "user", "ts", "60 seconds", {"total": F.sum("value")})
    assert got.columns == ["user", "start", "finish", "n_events", "total"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 60)
    assert sessions.sessions(spark.createDataFrame([], EVENTS), "user", "ts", "60 seconds", {}).count() == 0


def test_a_stream_gives_the_sessions_of_the_table(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    rng = random.Random(3)
    rows = sorted((r for r in events(rng, 600) if r[1]), key=lambda r: (r[1] - START).total_seconds() + rng.random() * 300)
    end = [(0, START + datetime.timedelta(days=2), 0)]
    late = [(1, START + datetime.timedelta(seconds=5), 100)]

    def run(part):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        query = sessions.sessions(stream, "user", "ts", "60 seconds", {"total": F.sum("value")}, late="10 minutes").writeStream
        query = query.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(200)
        return sorted(tuple(r) for r in spark.read.parquet(out).where("user > 0").collect())

    # events come up to five minutes out of order, and the stream is started again between the parts
    first = run(rows[:300])
    run(rows[300:])
    assert set(first) <= set(plain(rows, 60))
    assert run(end) == plain(rows, 60)
    # what comes behind the watermark changes nothing
    assert run([*late, (0, START + datetime.timedelta(days=4), 0)]) == plain(rows, 60)
