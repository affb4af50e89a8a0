"""Runs of requests to a service outside that go on where they were stopped.

Requests are written once, a file a batch, and read as a stream of what is
available.  Each batch's answers are a folder of their own, written before the
batch is committed, and written over if it comes again.  So a run that is killed
asks at most the batch again that it was at, and nothing that was committed.
Requests that failed are those of the next attempt, a stream of its own.

Batches follow one another, so pauses of the tasks of one batch bound the calls
a second of the whole run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.sources.annotator import answered
from variorum.storage import exists

Check = Callable[[DataFrame], DataFrame]


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def run(
    requests: DataFrame,
    keys: list[str],
    call: Callable[[str], str],
    folder: str,
    attempts: int = 1,
    check: Check | None = None,
    again: Callable[[Column, Column], Column] | None = None,
    per_second: float | None = None,
    parallel: int = 8,
    batch: int = 1000,
) -> DataFrame:
    """keys, content, error and attempt of each request, whose text is in prompt; from the last attempt where it failed.

    folder, which all executors share, holds the run: with the same folder, a run that was stopped goes on, and one
    that is done only gives its answers back; requests are those of the first call.  keys must tell requests apart.
    check gets a batch's answers and returns them with an error where a content is refused; again makes the next
    attempt's prompt of the last one and its error.  per_second bounds the calls, batch the requests that are asked
    anew when a run is killed.  A null prompt has no content and no error; no requests, no rows.
    """
    spark = requests.sparkSession
    pause = parallel / per_second if per_second else 0.0
    requests = requests.select(*keys, "prompt")
    for attempt in range(1, attempts + 1):
        asked = f"{folder}/requests-{attempt}"
        if not exists(spark, f"{asked}/_SUCCESS"):
            # where a run ends before this is complete, it is made again from the same tables
            requests.write.mode("overwrite").option("maxRecordsPerFile", batch).parquet(asked)
        _stream(spark, requests, asked, f"{folder}/answers-{attempt}", f"{folder}/checkpoint-{attempt}", keys, call, check, pause, parallel)
        found = _answers(spark, folder, attempt, requests, keys)
        failed = found.where("error is not null")
        if attempt == attempts or failed.isEmpty():
            break
        given = spark.read.schema(requests.schema).parquet(asked)
        prompt = again(given["prompt"], failed["error"]) if again else given["prompt"]
        requests = given.join(failed, _same(given, failed, keys)).select(*[given[k] for k in keys], prompt.alias("prompt"))
    return answers(spark, folder, requests, keys)


def _stream(spark, requests, asked, answers, checkpoint, keys, call, check, pause, parallel) -> None:
    def answer(df: DataFrame, number: int) -> None:
        found = answered(df, keys, call, pause, parallel=parallel)
        if check is not None:
            path = f"{answers}-unchecked/batch={number}"
            found.write.mode("overwrite").parquet(path)  # asked once, however often the check reads it
            found = check(spark.read.schema(found.schema).parquet(path))
        found.select(*keys, "content", "error").write.mode("overwrite").parquet(f"{answers}/batch={number}")

    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(asked)
    stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _answers(spark: SparkSession, folder: str, attempt: int, requests: DataFrame, keys: list[str]) -> DataFrame:
    schema = requests.select(*keys, F.col("prompt").alias("content"), F.col("prompt").alias("error")).schema
    path = f"{folder}/answers-{attempt}"
    found = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return found.withColumn("attempt", F.lit(attempt))


def answers(spark: SparkSession, folder: str, requests: DataFrame, keys: list[str]) -> DataFrame:
    """What a run has so far; a request that will be asked again is not there."""
    last = 1
    while exists(spark, f"{folder}/answers-{last + 1}"):
        last += 1
    good = [_answers(spark, folder, k, requests, keys).where("error is null") for k in range(1, last)]
    return reduce(DataFrame.union, [*good, _answers(spark, folder, last, requests, keys)])
