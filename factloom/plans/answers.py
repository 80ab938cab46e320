"""Answers that are asked for once: a write-once log by the digest of what is asked.

A log is a folder that all executors reach: `answers` is a Parquet table of digests and responses, `open` holds a file for each answer of a run that has not ended. A task that is repeated, because its executor was lost or
another task failed, and a run that is started again find these files and do not ask again; when the run has ended, its answers are appended to the table and the files go. Prompts that are equal (with equal
system text and length) are one question. A provider that fails is asked again `retries` times; what still fails has no answer and is asked in the next run.

Null prompts have null answers and ask nothing. Repeated rows get the same answer. An empty table asks nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.revision import Answers, Provider, prompts_of
from factloom.sources.trees import located, qualified


def digest(prompt: Column, system: str | None, max_tokens: int) -> Column:
    """What tells questions apart."""
    return F.when(prompt.isNotNull(), F.sha2(F.concat(F.lit(json.dumps([system, max_tokens])), prompt), 256))


def known(spark: SparkSession, log: str) -> DataFrame:
    """digest, response of all answers in the log."""
    store, path = located(f"{qualified(spark, log)}/answers")
    if store.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        return spark.createDataFrame([], "digest string, response string")
    # a run that ended between its append and the deletion of its files may have left an answer twice
    return spark.read.schema("digest string, response string").parquet(f"{log}/answers").dropDuplicates(["digest"])


def _answer(model: Provider, prompt: str, system: str | None, max_tokens: int, retries: int, pause: float) -> str | None:
    for turn in range(retries + 1):
        try:
            return model.generate(prompt, system=system, max_tokens=max_tokens)
        except Exception:  # noqa: BLE001  any failure of a provider is one more reason to try again
            if turn < retries:
                time.sleep(pause * 2**turn)
    return None


def asked_once(prompts: DataFrame, provider: Callable[[], Provider], log: str, prompt_col: str = "prompt", name: str = "response", system: str | None = None, max_tokens: int = 2048, retries: int = 2, pause: float = 1.0) -> DataFrame:
    """prompts with the answers of a language model; only what the log does not have is asked for. pause: seconds before the first repetition, doubled each time."""
    spark, base = prompts.sparkSession, qualified(prompts.sparkSession, log)
    keyed = prompts.withColumn("answer_digest", digest(F.col(prompt_col), system, max_tokens))
    open_ = keyed.where("answer_digest is not null").groupBy(F.col("answer_digest").alias("digest")).agg(F.first(prompt_col).alias("prompt"))
    open_ = open_.join(known(spark, log).select("digest"), "digest", "left_anti")

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for part in parts:
            said = []
            for key, prompt in zip(part.digest, part.prompt, strict=True):
                store, path = located(f"{base}/open/{key[:2]}/{key}.json")
                if store.get_file_info(path).type == pyarrow.fs.FileType.File:
                    with store.open_input_stream(path) as f:
                        said.append(json.loads(f.read()))
                    continue
                model = model or provider()
                said.append(_answer(model, prompt, system, max_tokens, retries, pause))
                if said[-1] is not None:
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    # whole under a name of its own first, so that a file is there with its answer or not at all
                    with store.open_output_stream(own := f"{path}.{uuid.uuid4().hex}") as f:
                        f.write(json.dumps(said[-1]).encode())
                    store.move(own, path)
            yield pd.DataFrame({"digest": part.digest, "response": said})

    open_.mapInPandas(ask, "digest string, response string").where("response is not null").write.mode("append").parquet(f"{base}/answers")
    store, path = located(f"{base}/open")
    if store.get_file_info(path).type == pyarrow.fs.FileType.Directory:
        store.delete_dir(path)
    answers = known(spark, log).select(F.col("digest").alias("answer_digest"), F.col("response").alias(name))
    return keyed.drop(name).join(answers, "answer_digest", "left").drop("answer_digest")


def answers_logged(provider: Callable[[], Provider], key: str, log: str, level: str = "easy") -> Answers:
    """Answers of a language model for the revision loop; a loop that is run again, whole or in part, asks only what the log does not have."""

    def of(docs: DataFrame, attempt: int) -> DataFrame:
        prompts, system = prompts_of(docs, attempt, key, level)
        return asked_once(prompts, provider, log, system=system).select(key, "response")

    return of
