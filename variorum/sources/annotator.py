"""Answers to requests from a callable, as a service outside would give them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def answered(requests: DataFrame, keys: list[str], call: Callable[[str], str], pause: float = 0.0, attempts: int = 1, parallel: int | None = None) -> DataFrame:
    """keys, content and error of each request, whose text is in prompt.

    call gets a prompt and returns the content; what it raises, a time-out among it, is the error of its row after
    so many attempts.  Each task pauses after every call, also a failed one; parallel is the number of tasks, by default
    as many as the requests have, so parallel / pause bounds the calls a second.  A null prompt has no content and no
    error.  A repeated task calls again: write the answers before they are read more than once.
    """

    def one(prompt: str | None) -> tuple[str | None, str | None]:
        error = None
        for _ in range(attempts if prompt is not None else 0):
            try:
                return str(call(prompt)), None
            except Exception as e:  # noqa: BLE001  reported in its row
                error = f"{type(e).__name__}: {e}"
            finally:
                time.sleep(pause)
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(p) for p in batch["prompt"].to_pylist()]
            made = [pa.array([x[i] for x in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["row"], *made], names=["row", "content", "error"])

    own = requests.repartition(parallel) if parallel else requests
    packed = own.select(F.struct(*keys).alias("row"), F.col("prompt"))
    schema = StructType([packed.schema["row"]]).add("content", StringType()).add("error", StringType())
    return packed.mapInArrow(run, schema).select("row.*", "content", "error")
