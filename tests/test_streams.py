"""Answers that are asked once, and the revision loop over a stream, also after a restart."""

import datetime
import os
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from factloom.plans import answers, revision, revision_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have the tests


class Counted:
    """Says what it was asked, and notes it in a file; fails where it is told to."""

    def __init__(self, folder, fail_at=None):
        self.folder, self.fail_at = folder, fail_at

    def generate(self, prompt, *, system=None, max_tokens=2048):
        with open(os.path.join(self.folder, "asked"), "a") as f:
            f.write(prompt + "\n")
        if prompt == self.fail_at:
            raise OSError("no connection")
        return f"answer to {prompt}"


class Dies(Counted):
    """Ends its worker at a prompt."""

    def generate(self, prompt, *, system=None, max_tokens=2048):
        if prompt == self.fail_at:
            os._exit(1)
        return super().generate(prompt)


def noted(folder):
    path = os.path.join(folder, "asked")
    return sorted(open(path).read().split("\n")[:-1]) if os.path.exists(path) else []


def test_answers_are_asked_once(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path)
    prompts = spark.createDataFrame([(i, f"p{i % 6}" if i != 9 else None, "x") for i in range(10)], "id int, prompt string, response string")
    got = {r.id: r.response for r in answers.asked_once(prompts, lambda: Counted(folder), log).collect()}
    assert got == {i: f"answer to p{i % 6}" if i != 9 else None for i in range(10)}
    assert noted(folder) == [f"p{i}" for i in range(6)]
    more = prompts.union(spark.createDataFrame([(10, "p7", "x")], prompts.schema))
    assert answers.asked_once(more, lambda: Counted(folder), log).where("response is not null").count() == 10
    assert noted(folder) == [*(f"p{i}" for i in range(6)), "p7"]
    # another system text is another question
    answers.asked_once(prompts.limit(1), lambda: Counted(folder), log, system="s").count()
    assert len(noted(folder)) == 8
    assert answers.asked_once(prompts.where("false"), lambda: Counted(folder), log).count() == 0


def test_failures_are_repeated_and_what_fails_is_asked_in_the_next_run(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path)
    prompts = spark.createDataFrame([("a",), ("b",)], "prompt string")
    got = {r.prompt: r.response for r in answers.asked_once(prompts, lambda: Counted(folder, "b"), log, retries=2, pause=0.01).collect()}
    assert got == {"a": "answer to a", "b": None} and noted(folder) == ["a", "b", "b", "b"]
    got = {r.prompt: r.response for r in answers.asked_once(prompts, lambda: Counted(folder), log).collect()}
    assert got == {"a": "answer to a", "b": "answer to b"} and noted(folder) == ["a", "b", "b", "b", "b"]


def test_a_lost_worker_asks_nothing_twice(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path)
    prompts = spark.createDataFrame([(f"p{i}",) for i in range(40)], "prompt string")
    with pytest.raises(Exception):
        answers.asked_once(prompts, lambda: Dies(folder, "p17"), log).count()
    before = noted(folder)
    assert before and "p17" not in before
    got = answers.asked_once(prompts, lambda: Counted(folder), log).collect()
    assert {r.prompt: r.response for r in got} == {f"p{i}": f"answer to p{i}" for i in range(40)} and len(got) == 40
    assert noted(folder) == sorted(f"p{i}" for i in range(40))
    assert not os.path.exists(os.path.join(log, "open"))


def gate(docs):
    """Passes texts that say ok, gives bad ones to a person."""
    text = F.coalesce("easy_text", F.lit(""))
    return docs.withColumn("failed", F.array().cast("array<string>")).withColumn("verdict", F.when(text.contains("ok"), "pass").when(text.contains("bad"), "human_review").otherwise("revise"))


SCHEMA = "k long, source_text string, ref_date date, attempt int, response string, at timestamp"
START = datetime.datetime(2024, 1, 1)


def said(rng):
    rows = []
    for k in range(60):
        end = rng.choice((0, 1, 2, 3, 5))
        for attempt in range(4):
            rows.append((k, "s", datetime.date(2024, 1, 1), attempt, None if k % 17 == 5 and attempt == 1 else (" ok " if attempt >= end else "bad" if k % 11 == 3 and attempt == 1 else f"no {attempt}"), START + datetime.timedelta(minutes=rng.randrange(50))))
    return rows


def run(spark, source, out, checkpoint, **options):
    stream = revision_stream.revised_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), gate, "k", **options)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    return sorted(map(tuple, spark.read.schema("k long, easy_text string, verdict string, revisions int").parquet(out).collect()))


def test_stream_equals_the_loop_over_tables_and_goes_on_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", revision_stream.ROCKSDB)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    rows = said(random.Random(6))
    docs = spark.createDataFrame([(k, "s", datetime.date(2024, 1, 1)) for k in range(60)], "k long, source_text string, ref_date date")
    answered = spark.createDataFrame([(k, a, r) for k, _, _, a, r, _ in rows], "k long, attempt int, response string")
    want = sorted(map(tuple, revision.revised(docs, answered, gate, "k").select("k", "easy_text", "verdict", "revisions").collect()))
    random.Random(7).shuffle(rows)
    write = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    write(rows[:150])
    first = run(spark, source, out, checkpoint)
    assert set(first) <= set(want) and len(first) < len(want)
    # the rest, rows that came before, and rows without a key
    write(rows[150:] + rows[:40] + [(None, "s", None, 0, "ok", START)])
    assert run(spark, source, out, checkpoint) == want


def test_documents_that_wait_in_vain_go_to_a_person(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", revision_stream.ROCKSDB)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    row = lambda k, attempt, text, hours: (k, "s", datetime.date(2024, 1, 1), attempt, text, START + datetime.timedelta(hours=hours))
    parts = [[row(1, 0, "no", 0), row(2, 1, "ok", 0)], [row(3, 0, "ok", 60)], [row(1, 1, "ok", 61), row(4, 0, "ok", 61)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        got = run(spark, source, out, checkpoint)
    # 1 waited for an answer to a revision, 2 for its first answer; what comes later changes nothing
    assert got == [(1, "no", "human_review", 0), (2, None, "human_review", 0), (3, "ok", "pass", 0), (4, "ok", "pass", 0)]


def test_a_new_document_that_ends_at_once_needs_few_calls_of_the_state():
    import pandas as pd

    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or (False if name == "exists" else [])

    loop = revision_stream._Loop("k", 3, 1000, 1000)
    loop.handle = loop.turn = loop.early = State()
    rows = pd.DataFrame({"attempt": [2, 1, 0], "easy_text": ["c", "b", "a"], "verdict": ["pass", "revise", "revise"], "at_ms": [3, 2, 1]})
    out = pd.concat(loop.handleInputRows((7,), iter([rows]), None))
    assert out.values.tolist() == [[7, "c", "pass", 2]]
    assert len(calls) <= 3
