"""Calls of the caller's model: each distinct prompt once, few at a time, again after errors, finished answers kept."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.plans.prompts import whole_prompts
from fieldloom.session import materialize, shared_folder

#: Prompts whose answers are written before the next ones are asked: what a failing job can lose.
WAVE_PROMPTS = 20_000
#: Prompts handed to the model in one call, and the seconds before the second attempt, doubled for each further one.
CALL_PROMPTS, PAUSE = 64, 0.5
ANSWERS = "prompt_sha string, raw_text string"


def _asked(complete: Callable[[pd.Series], pd.Series], prompts: pd.Series, attempts: int, pause: float) -> list[str | None]:
    """The answers to some prompts; where the call fails each prompt is tried by itself, None where that fails too."""
    try:
        return list(complete(prompts))
    except Exception:  # noqa: BLE001 - whatever the caller's model raises
        answers = []
        for prompt in prompts:
            found = None
            for attempt in range(1, attempts):
                time.sleep(pause * 2 ** (attempt - 1))
                try:
                    found = list(complete(pd.Series([prompt])))[0]
                    break
                except Exception:  # noqa: BLE001
                    continue
            answers.append(found)
        return answers


def _answered(open_prompts: DataFrame, complete, max_calls: int, attempts: int, pause: float) -> DataFrame:
    """(prompt_sha, raw_text) of the prompts the model answered; at most `max_calls` tasks call it at a time."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), CALL_PROMPTS):
                some = frame.iloc[at : at + CALL_PROMPTS]
                answers = _asked(complete, some["prompt"].reset_index(drop=True), attempts, pause)
                done = pd.DataFrame({"prompt_sha": list(some["prompt_sha"]), "raw_text": answers})
                yield done[done["raw_text"].notna()]

    return open_prompts.repartition(max_calls).mapInPandas(batches, ANSWERS)


def _kept_answers(spark: SparkSession, folder: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(ANSWERS).parquet(folder) if there else spark.createDataFrame([], ANSWERS)


def answer(
    prompts: DataFrame, complete: Callable[[pd.Series], pd.Series], kept: str | None = None, max_calls: int = 8, attempts: int = 3,
    wave: int = WAVE_PROMPTS, pause: float = PAUSE,
) -> DataFrame:
    """(column_id, raw_text): the caller's model over prompts, each put together from its parts.

    Equal prompts are asked once. `complete` maps a series of prompts to a series of texts; at most `max_calls` calls run at
    a time. After an error the prompts of that call are tried one by one until each had `attempts` tries; a prompt without
    answer gives no row. Answers are appended to the folder `kept` wave by wave and prompts that have one there, by their
    hash, are not asked again: a job that is repeated goes on where it ended. A task that Spark repeats asks its wave's
    prompts again, but its answers are written once.
    """
    spark = prompts.sparkSession
    folder = kept or f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    whole = materialize(whole_prompts(prompts).withColumn("prompt_sha", F.sha2("prompt", 256)), "whole-prompts")
    once = whole.groupBy("prompt_sha").agg(F.first("prompt").alias("prompt"))
    todo = materialize(once.join(_kept_answers(spark, folder).select("prompt_sha"), "prompt_sha", "left_anti"), "open-prompts")
    waves = -(-todo.count() // wave)
    # The hash deals the prompts out, so a repeated job has waves of the prompts left.
    number = F.pmod(F.xxhash64("prompt_sha"), F.lit(max(1, waves)))
    for n in range(waves):
        _answered(todo.where(number == n), complete, max_calls, attempts, pause).write.mode("append").parquet(folder)
    # Two jobs on one folder may both have asked a prompt: the greatest text counts.
    answers = _kept_answers(spark, folder).groupBy("prompt_sha").agg(F.max("raw_text").alias("raw_text"))
    return whole.select("column_id", "prompt_sha").join(answers, "prompt_sha").select("column_id", "raw_text")
