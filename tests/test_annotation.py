"""Runs that are killed and go on; requests that failed and are asked again."""

import collections
import os
import signal
import subprocess
import sys
import time
from pathlib import Path

import pytest

from variorum.operators import collate
from variorum.plans import collation
from variorum.streaming import annotation

KILLED = """
import os, signal, sys, time
from variorum.session import session
from variorum.streaming import annotation
folder, log = sys.argv[1:]
def call(prompt):
    with open(log, "a") as f:
        f.write(prompt + "\\n")
    return prompt.upper()
spark = session("killed", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__showConsoleProgress="false")
batches = []
def check(answers):
    batches.append(answers.count())
    if len(batches) == 3:
        os.kill(os.getpid(), signal.SIGKILL)
    return answers
requests = spark.range(40).selectExpr("id k", "concat('p', id) prompt").repartition(2)
annotation.run(requests, ["k"], call, folder, check=check, batch=5, parallel=2)
"""


def logged(path):
    return collections.Counter(Path(path).read_text().split())


def test_a_killed_run_goes_on(spark, tmp_path):
    folder, log = str(tmp_path / "run"), str(tmp_path / "log")
    killed = subprocess.run([sys.executable, "-c", KILLED, folder, log], env=os.environ | {"PYTHONPATH": str(Path(annotation.__file__).parents[2])}, capture_output=True, timeout=300)
    assert killed.returncode == -signal.SIGKILL
    before = logged(log)
    assert 0 < len(before) < 40 and set(before.values()) == {1}
    committed = {r.k for p in sorted((tmp_path / "run" / "answers-1").glob("batch=*"))[:2] for r in spark.read.parquet(str(p)).collect()}

    def call(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        return prompt.upper()

    requests = spark.createDataFrame([(1, "others are not asked")], "k long, prompt string")  # a run keeps its own
    found = annotation.run(requests, ["k"], call, folder, batch=5, parallel=2)
    assert sorted((r.k, r.content, r.error, r.attempt) for r in found.collect()) == [(k, f"P{k}", None, 1) for k in range(40)]
    asked = logged(log)
    assert len(asked) == 40 and all(asked[f"p{k}"] == 1 for k in committed)
    assert sum(asked.values()) <= 45  # the batch that was not committed
    assert annotation.run(requests, ["k"], call, folder, batch=5).count() == 40 and logged(log) == asked


def test_failures_are_asked_again(spark, tmp_path):
    log = str(tmp_path / "log")

    def call(prompt):
        with open(log, "a") as f:
            f.write(prompt.replace(" ", "_") + "\n")
        if prompt.startswith("bad"):
            raise ValueError("no")
        return prompt

    check = lambda answers: answers.selectExpr("k", "content", "case when content = 'odd' then 'refused' else error end error")
    again = lambda prompt, error: annotation.F.concat_ws(" ", prompt, error)
    requests = spark.createDataFrame([(1, "good"), (2, "odd"), (3, "bad"), (4, None), (None, "odd")], "k int, prompt string")
    found = annotation.run(requests, ["k"], call, str(tmp_path / "run"), 3, check, again)
    rows = {(r.k, r.content, r.error, r.attempt) for r in found.collect()}
    assert rows == {(1, "good", None, 1), (4, None, None, 1), (2, "odd refused", None, 2), (None, "odd refused", None, 2), (3, None, "ValueError: no", 3)}
    assert logged(log) == {"good": 1, "odd": 2, "odd_refused": 2, "bad": 1, "bad_ValueError:_no": 1, "bad_ValueError:_no_ValueError:_no": 1}
    assert annotation.run(requests.limit(0), ["k"], call, str(tmp_path / "none"), 2).collect() == []


def test_the_rate_holds_over_all_tasks(spark, tmp_path):
    requests = spark.range(12).selectExpr("id k", "'x' prompt").repartition(6)
    began = time.monotonic()
    assert annotation.run(requests, ["k"], str.upper, str(tmp_path / "run"), per_second=6, parallel=3, batch=4).count() == 12
    assert time.monotonic() - began >= 12 / 6


@pytest.mark.parametrize("wrong", ["{", '{"edit_distance": 1, "operations": []}'])
def test_realignments_of_a_service(spark, tmp_path, wrong):
    rows = [(1, "a", 1, 1, 1, "上德"), (2, "b", 1, 1, 2, "下德"), (1, "a", 1, 2, 3, "x"), (2, "b", 1, 2, 4, "xyz")]
    witness = spark.createDataFrame(rows, "version_idx int, version string, chapter_number int, sentence_number int, row_idx long, text string")
    pairs = collate.collate(witness).cache()

    def call(prompt):
        if "xyz" in prompt or "refused" not in prompt:
            return wrong
        return '{"edit_distance": 1, "operations": [{"type": "replace", "position": 0, "original_char": "上", "target_char": "下"}]}'

    good, failed = collation.realigned_by(pairs, call, str(tmp_path / "run"))
    assert [r.sentence_number for r in good.collect()] == [1]
    letters = failed.collect()
    assert [r["item"].sentence_number for r in letters] == [2] and letters[0].error
