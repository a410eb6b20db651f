"""Asking a responder: any callable from prompt text to answer text, run next to the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plaudit.sources.staging import written

Responder = Callable[[str], str]

STORED = "prompt_hash string, response string, error string"
AT_ONCE = 8             # prompts a task has under way at a time
ROUND_PROMPTS = 2_000   # prompts answered between two additions to the store


class ResponderFailed(RuntimeError):
    """No prompt of a round was answered."""


def ask(prompts: DataFrame, responder: Responder, at_once: int = AT_ONCE) -> DataFrame:
    """``prompts`` with the columns ``response`` and ``error``, one of which is null.

    An exception costs its own prompt and is told in ``error``. A task has ``at_once`` prompts under way, in threads, as a responder
    mostly waits. The responder must be picklable. A task that is lost runs again, so it may see a prompt twice.
    """
    schema = T.StructType([*prompts.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def answer(prompt: str) -> tuple[str | None, str | None]:
        try:
            response = responder(prompt)
            return (response, None) if isinstance(response, str) else (None, f"no text but {type(response).__name__}")
        except Exception as error:  # the table tells it
            return None, f"{type(error).__name__}: {error}"

    def answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                found = list(pool.map(answer, frame["prompt"]))
                yield frame.assign(response=[response for response, _ in found], error=[error for _, error in found])

    return prompts.mapInPandas(answers, schema)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(STORED).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def answered(spark: SparkSession, prompts: DataFrame, responder: Responder, store: str, parallelism: int | None = None,
             at_once: int = AT_ONCE, round_prompts: int = ROUND_PROMPTS) -> DataFrame:
    """Prompts with ``response`` and ``error``, asking only for prompts the store has no answer to.

    The prompts are written to the shared folder first, so they are built once, and the answer
    takes the place of their text in the result. ``store`` is a Parquet folder all executors reach.
    Prompts are asked in rounds of about ``round_prompts``, each of which is added to the store: an interrupted run keeps all but
    its last round, and decoding never asks again. Prompts that failed stay in the store with their ``error`` (``failed_prompts``) and
    are asked again by the next run. A round without any answer ends the run. ``parallelism`` is the number of tasks that ask.
    """
    asked = written(spark, prompts, "prompts")
    answers = _stored(spark, store).filter("response is not null")
    missing = written(spark, asked.select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"]).join(
        answers, "prompt_hash", "left_anti"), "missing")
    rounds = -(-missing.count() // round_prompts)
    for nth in range(rounds):
        part = missing.filter(F.pmod(F.xxhash64("prompt_hash"), F.lit(rounds)) == nth)
        if parallelism:
            part = part.repartition(parallelism, "prompt_hash")
        found = written(spark, ask(part, responder, at_once).select("prompt_hash", "response", "error"), "round")
        found.write.mode("append").parquet(store)
        failed = found.agg(F.count("*").alias("n"), F.count("error").alias("failed"), F.max("error").alias("error")).first()
        if failed["n"] and failed["failed"] == failed["n"]:
            raise ResponderFailed(f"none of {failed['n']} prompts was answered: {failed['error']}")
    known = _stored(spark, store).groupBy("prompt_hash").agg(F.min("response").alias("response"), F.max("error").alias("error"))
    return asked.drop("prompt").join(known, "prompt_hash", "left").withColumn(
        "error", F.when(F.col("response").isNull(), F.col("error")))


def failed_prompts(answers: DataFrame) -> DataFrame:
    """The prompts of ``answered`` without an answer, with the error of the last try that told one."""
    return answers.filter(F.col("response").isNull()).drop("response")
