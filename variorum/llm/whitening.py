"""Whitening of embeddings by the singular values of their centred rows.

Entries become whole numbers, so sums are exact.  The model is fitted on each
distinct vector once: blocks of centred rows are reduced to triangular factors
(QR), factors are reduced together in a tree until one is left, and one-sided
Jacobi rotations make its columns orthogonal.  The rotations' product holds the
components, the columns' lengths the standard deviations: the covariance matrix
is never formed, so small deviations keep their digits.

The driver holds one factor of ``MOST`` by ``MOST`` numbers at most; a task
holds a block of rows and two factors.

Defined results: rows whose vector is null, empty or holds null or non-finite
entries take no part; rows with a null id stay, and repeated rows are whitened
one by one but learnt from once; entries from 2**61 / scale on count as that
bound; vectors of each length are a population of their own, of as many lengths
as ``LENGTHS``; components whose deviation is nothing beside the first's have
no row, so equal vectors alone give none; of components that tie in deviation any
orthogonal choice may come, of the two signs that with the largest coordinate
positive; deviations beyond 64 bits are null; an empty table gives an empty one.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm._shared import discard, materialize, tidy, tidy_group

#: Entries of a vector, at most, and lengths of vectors in one table.
MOST, LENGTHS = 2048, 64
#: Numbers of a block of rows, and of the factors that are reduced together, about.
BLOCK, TOGETHER = 1 << 20, 1 << 22
#: Partial sums of each length that come to the driver, at most.
SLOTS = 16
_EDGE = 1 << 61


def whole(rows: DataFrame, scale: int = 256, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, size, x) of the rows that take part: x holds floor(scale * entry) as little-endian 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array(batch["v"].value_lengths().fill_null(0), np.int64)
            flat = batch["v"].flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            ends = np.cumsum(size)
            good = (size > 0) & (bad[ends] == bad[ends - size])
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(flat[np.repeat(good, size)] * scale), -_EDGE, _EDGE).astype("<i8")
            cut = np.concatenate([[0], np.cumsum(size[good])]) * 8
            packed = pa.Array.from_buffers(pa.large_binary(), int(good.sum()), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(x)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch["vec_id"].filter(pa.array(good)), pa.array(size[good], pa.int32()), packed], names=["vec_id", "size", "x"])

    own = rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("v"))
    return own.mapInArrow(tidy(run), f"vec_id {own.schema['vec_id'].dataType.simpleString()}, size int, x binary")


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, size)


def _total(x: np.ndarray) -> list[int]:
    """Exact sums of columns."""
    high, low = x >> 20, x & 0xFFFFF  # neither can overflow over a batch
    return [int(a) * (1 << 20) + int(b) for a, b in zip(high.sum(0), low.sum(0), strict=True)]


def _sums(size: int):
    """(task, n, total): rows and sums of columns, as decimal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            n += batch.num_rows
            if batch.num_rows:
                total = [a + b for a, b in zip(total, _total(_matrix(batch["x"], size)), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([list(map(str, total))], pa.list_(pa.string()))], names=["task", "n", "total"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = [0] * len(table["total"][0])
    for one in table["total"]:
        total = [a + int(b) for a, b in zip(total, one.as_py(), strict=True)]
    return pa.table({"task": table["task"][:1], "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "total": pa.array([list(map(str, total))], pa.list_(pa.string()))})


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - total / n: differences of whole numbers first, so that a large mean costs no digits."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0) < 1 << 62:
        return (n * x - np.array(total, np.int64)) / n
    base = np.array([t // n for t in total], np.int64)
    return (x - base) - np.array([(t % n) / n for t in total])


def deviation(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The sum over columns of (n * x - total)^2 of each row, exact; None beyond 64 bits."""
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0)
    if bound**2 * max(1, len(total)) < 1 << 63:
        return np.square(n * x - np.array(total, np.int64)).sum(1).tolist()
    found = [sum((n * a - t) ** 2 for a, t in zip(row, total, strict=True)) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in found]


def _factor(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _blocks(size: int, n: int, total: list[int]):
    """(task, r): the triangular factor of a task's centred rows, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, step = np.zeros((0, size)), max(size, BLOCK // size)
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                held = _factor(np.concatenate([held, centred(_matrix(batch["x"].slice(i, step), size), n, total)]))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["task", "r"])

    return run


def _reduced(size: int):
    def run(table: pa.Table) -> pa.Table:
        held = np.zeros((0, size))
        order = np.argsort(table["task"].to_numpy(), kind="stable")
        for r in table["r"].take(pa.array(order)):
            held = _factor(np.concatenate([held, np.frombuffer(r.as_py()).reshape(-1, size)]))
        return pa.table({"task": pa.array([int(table["task"].to_numpy().min())], pa.int64()), "r": pa.array([held.tobytes()], pa.binary())})

    return run


def triangle(distinct: DataFrame, size: int, n: int, total: list[int]) -> np.ndarray:
    """The triangular factor of all centred rows: R with R'R = X'X."""
    fan = max(2, min(64, TOGETHER // (size * size)))
    found = materialize(distinct.mapInArrow(tidy(_blocks(size, n, total)), "task long, r binary"))
    while (left := found.count()) > 1:
        before, dealt = found, found.withColumn("place", F.pmod(F.xxhash64("task"), F.lit(-(-left // fan))))
        found = materialize(dealt.groupBy("place").applyInArrow(tidy_group(lambda t: _reduced(size)(t.select(["task", "r"]))), "task long, r binary"))
        discard(before)
    r = np.frombuffer(found.first()["r"]).reshape(-1, size)
    discard(found)
    return r


def jacobi(r: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and its right singular vectors as columns.

    Each round rotates the columns of disjoint pairs in their planes, so that every pair meets once a sweep, until no
    two columns are further from orthogonal than the tolerance.
    """
    d = r.shape[1]
    even = d + d % 2
    work, turned = np.zeros((max(len(r), 1), even)), np.eye(even)
    work[: len(r), :d] = r
    ring = np.arange(even)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(even - 1):
            p, q = ring[: even // 2], ring[even // 2 :][::-1]
            a, b = work[:, p], work[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            scale = np.sqrt(aa * bb)
            off = np.divide(np.abs(ab), scale, out=np.zeros_like(ab), where=scale > 0)
            worst = max(worst, float(off.max(initial=0)))
            turn = off > tolerance
            zeta = np.divide(bb - aa, 2 * ab, out=np.zeros_like(ab), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0.0)
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (work, turned):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
            ring[1:] = np.roll(ring[1:], 1)
        if worst <= tolerance * 8:
            break
    sigma = np.sqrt((work * work).sum(0))
    order = np.argsort(-sigma[:d], kind="stable")  # a column that makes the number even is nothing and stays last
    v = turned[:d, order]
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(d)])
    return sigma[order], v * np.where(sign == 0, 1, sign)


@dataclass
class Model:
    """Of vectors of one length: rows fitted on, sums, components as rows, their deviations, and shares of the variance."""

    n: int
    total: list[int]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.total) @ self.components.T / self.deviations


def fit(distinct: DataFrame, size: int, components: int | None = None) -> Model:
    """The model of vectors of one length, given each once; all components unless fewer are asked for."""
    if size > MOST:
        raise ValueError(f"vectors of {size} entries; {MOST} at most")
    parts = distinct.mapInArrow(tidy(_sums(size)), "task long, n long, total array<string>")
    few = parts.withColumn("slot", F.pmod("task", F.lit(SLOTS))).groupBy("slot").applyInArrow(tidy_group(lambda t: _added(t.select(["task", "n", "total"]))), "task long, n long, total array<string>").collect()
    n, total = sum(r.n for r in few), [sum(map(int, c)) for c in zip(*[r.total for r in few], strict=True)]
    sigma, v = jacobi(triangle(distinct, size, n, total))
    kept = np.flatnonzero(sigma > sigma.max(initial=0) * size * 1e-14)[:components]
    return Model(n, total, v[:, kept].T.copy(), sigma[kept] / np.sqrt(n), np.square(sigma[kept]) / max(np.square(sigma).sum(), 1e-300))


def _whitened(model, keep: int):
    """Rows (vec_id, x) as (vec_id, deviation, w); w holds the first components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        size = len(m.total)
        for batch in batches:
            x = _matrix(batch["x"], size)
            w = m.whitened(x)[:, :keep]
            cut = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(deviation(x, m.n, m.total), pa.int64()), pa.ListArray.from_arrays(pa.array(cut), pa.array(w.ravel()))], names=["vec_id", "deviation", "w"])

    return run


def whiten(rows: DataFrame, model: Model, keep: int | None = None) -> DataFrame:
    """vec_id, deviation and w, the first whitened coordinates, of rows of whole() that have the model's length."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # MOST * MOST numbers at most
    own = rows.where(F.col("size") == len(model.total)).select("vec_id", "x")
    kind = own.schema["vec_id"].dataType.simpleString()
    return own.mapInArrow(tidy(_whitened(sent, keep or len(model.deviations))), f"vec_id {kind}, deviation long, w array<double>")


def _identity_error(distinct: DataFrame, model: Model, keep: int) -> float:
    """How far the covariance of the whitened coordinates is from the identity, at most."""
    w = whiten(distinct.select(F.lit(0).alias("vec_id"), "size", "x"), model, keep)
    found = w.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i in range(keep) for j in range(i + 1)]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in range(keep) for j in range(i + 1))


def digest(embeddings: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each row and component."""
    own = whole(embeddings, scale)
    distinct = materialize(own.select("size", "x").distinct())
    sizes = [r["size"] for r in distinct.select("size").distinct().limit(LENGTHS + 1).collect()]
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    kind = own.schema["vec_id"].dataType.simpleString()
    out = embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for size in sorted(sizes):
        same = distinct.where(F.col("size") == size)
        model = fit(same, size, components)
        keep = len(model.deviations)
        if not keep:
            continue
        error = _identity_error(same, model, keep)
        rows = whiten(own, model).select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
        shares = F.array(*[F.lit(float(e)) for e in model.explained])
        out = out.union(rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error")))
    return out
