"""Model calls against a model that fails: who is asked, how often, and what is kept."""

import os
import time
import uuid

import pandas as pd

from fieldloom.plans.model_calls import answer


def failing_model(folder, once=(), always=(), seconds=0.0):
    """Notes each call in a file; prompts in `once` fail at their first try, those in `always` at every one."""

    def complete(prompts: pd.Series) -> pd.Series:
        begun = time.time()
        tried = [open(f"{folder}/{f}").read().split("\n")[1:] for f in os.listdir(folder)]
        time.sleep(seconds)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as note:
            note.write("\n".join([f"{begun} {time.time()}", *prompts]))
        for p in prompts:
            if p in always or (p in once and not any(p in t for t in tried)):
                raise RuntimeError("the model is busy")
        return prompts.map(lambda p: f"answer to {p}")

    return complete


def calls(folder):
    return [open(f"{folder}/{f}").read().split("\n") for f in os.listdir(folder)]


def prompts_of(spark, texts):
    return spark.createDataFrame([(n, 0, t) for n, t in enumerate(texts)], "column_id int, part int, prompt string")


def test_equal_prompts_are_asked_once_and_errors_again(spark, tmp_path):
    texts = ["a", "b", "a", "c", "bad", "b"]
    got = answer(prompts_of(spark, texts), failing_model(str(tmp_path), once=("a", "c"), always=("bad",)), max_calls=2, pause=0.01)
    assert sorted(tuple(r) for r in got.collect()) == [(n, f"answer to {t}") for n, t in enumerate(texts) if t != "bad"]
    # No call holds a prompt twice, and the prompt that never works is tried three times.
    asked = [c[1:] for c in calls(tmp_path)]
    assert all(len(c) == len(set(c)) for c in asked) and sum("bad" in c for c in asked) == 3


def test_finished_answers_are_kept(spark, tmp_path):
    first, second, kept = tmp_path / "first", tmp_path / "second", str(tmp_path / "kept")
    first.mkdir(), second.mkdir()
    texts = [f"p{n}" for n in range(30)]
    got = answer(prompts_of(spark, texts), failing_model(str(first), always=("p7",)), kept, max_calls=3, attempts=1, wave=10, pause=0.01)
    there = {r.raw_text for r in got.collect()}
    assert "answer to p7" not in there and 0 < len(there) < 30
    again = answer(prompts_of(spark, [*texts, "new"]), failing_model(str(second)), kept, max_calls=3)
    assert {r.raw_text for r in again.collect()} == {f"answer to {t}" for t in [*texts, "new"]}
    # Only what had no answer was asked for.
    asked = sorted(p for c in calls(second) for p in c[1:])
    assert asked == sorted({*texts, "new"} - {t.removeprefix("answer to ") for t in there})


def test_calls_at_a_time_and_prompts_in_parts(spark, tmp_path):
    rows = [(n, part, f"{part}of{n};") for n in range(400) for part in range(3)]
    parts = spark.createDataFrame(rows, "column_id int, part long, prompt string").repartition(8)
    got = {r.column_id: r.raw_text for r in answer(parts, failing_model(str(tmp_path), seconds=0.2), max_calls=2).collect()}
    assert got == {n: f"answer to 0of{n};1of{n};2of{n};" for n in range(400)}
    spans = sorted(tuple(map(float, c[0].split())) for c in calls(tmp_path))
    assert len(spans) >= 6 and max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= 2


def test_no_prompts(spark):
    assert answer(prompts_of(spark, []), failing_model("/nowhere")).count() == 0
