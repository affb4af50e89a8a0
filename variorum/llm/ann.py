"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors go through pseudo-rotations (three rounds of random signs and a
fast Hadamard transform) and fall to the nearest signed axis.  As vectors grow
in number, a bucket of a table takes further hashes, each of a rotation of its
own and of so many of its axes that a bucket holds about ``BUCKET`` vectors.  A
query probes in each table the buckets that it misses by the least margin, more
of them where there are more buckets.  Vectors and probes meet by (table,
bucket); there all candidates are compared by their exact distance, and the
best of each bucket go on to the final rank.

Probes go in waves: the first table's nearest bucket, then its other buckets,
up to sixteen times as many a wave, then the other tables.  The farthest of the
best that the waves before have found bounds a query's next wave, which
compares all candidates of its probes and sends on only those within the bound;
so the rows a query sends on do not grow with its probes.

Equal vectors are one class with its smallest ids, as many as a result can
need, so copies cost no more than one vector.  Buckets of many classes are cut
into parts.  Queries that their probes leave short of results are searched
among all vectors, in blocks.

Defined results: rows with a null id, a null, empty or zero vector, or null or
non-finite components take no part; vectors of other dimensions are no
candidates; copies of a row count once; of several vectors under one id the
nearest counts; ties go to the smaller id; vectors of very many components are
hashed whole; an empty table gives an empty one.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variorum.llm._shared import discard, materialize, tidy, tidy_both

#: Tables, and buckets that a query probes in each while a bucket is one axis.
TABLES, PROBES = 8, 12
#: Vectors that a bucket holds, about, and the power of a bucket's parts by which probes grow.
BUCKET, GROWTH = 128, 0.75
#: Probes of the first table after a wave for one before it.
WAVE = 16
#: Classes of a part of a bucket, and queries of a block of the exact search.
PART, BLOCK = 4096, 1024


def rotate(unit: np.ndarray, table: int) -> np.ndarray:
    """The table's pseudo-rotation of rows, padded to a power of two."""
    n, d = unit.shape
    size = 1 << max(d - 1, 1).bit_length() if d > 1 else 2
    x = np.zeros((n, size))
    x[:, :d] = unit
    rng = np.random.default_rng([table, size])
    for _ in range(3):
        x *= rng.choice([-1.0, 1.0], size)
        step = 1
        while step < size:
            pairs = x.reshape(n, -1, 2, step)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, size)
            step *= 2
        x /= np.sqrt(size)
    return x


def _margins(unit: np.ndarray, rotation: int, axes: int) -> np.ndarray:
    """By how much each row misses each of the first signed axes, squared; 0 at its nearest."""
    y = rotate(unit, rotation)[:, : axes // 2]
    both = np.concatenate([y, -y], 1)
    return np.square(both.max(1, keepdims=True) - both)


def buckets(vectors: np.ndarray, table: int, probes: int, parts: int = 1) -> np.ndarray:
    """Keys of the buckets that rows miss least, nearest first: dimension, table and number of the bucket in one.

    A bucket is a signed axis, cut into parts by further hashes: a power of two.
    """
    unit = vectors / np.abs(vectors).max(1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    size = 1 << max(vectors.shape[1] - 1, 1).bit_length() if vectors.shape[1] > 1 else 2
    axes = [2 * size]
    while parts > 1:
        axes.append(min(parts, 2 * size))
        parts //= axes[-1]
    number, missed = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
    for level, n in enumerate(axes):
        own = _margins(unit, table + 256 * level, n)
        every = (missed[:, :, None] + own[:, None, :]).reshape(len(unit), -1)
        kept = min(probes, every.shape[1])
        at = np.argpartition(every, kept - 1, 1)[:, :kept]
        missed = np.take_along_axis(every, at, 1)
        order = np.argsort(missed, 1, kind="stable")
        at, missed = np.take_along_axis(at, order, 1), np.take_along_axis(missed, order, 1)
        number = np.take_along_axis(number, at // n, 1) * n + at % n
    return (vectors.shape[1] << 40 | table << 32) + number


def _valid(keep: int, every: int | None):
    """(vec, ids): distinct vectors of a batch with their smallest ids; with every, of the ids that it divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for i, v in zip(batch["vec_id"].to_pylist(), batch["embedding"], strict=True):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count or every and i % every:
                    continue
                x = v.values.to_numpy().astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    found.setdefault(x.tobytes(), []).append(i)
            ids = [sorted(set(x))[:keep] if keep else sorted(set(x)) for x in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(ids, pa.list_(pa.int64()))], names=["vec", "ids"])

    return run


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of each dimension."""
    raw = column.to_pylist()
    sizes = np.array([len(x) for x in raw])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join([raw[i] for i in at]), np.float64).reshape(len(at), -1)


def _hashed(tables: range, probes: range, parts: int, names: list[str]):
    step = max(1, (1 << 14) // probes.stop)  # rows whose sums of margins are held at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, vectors in _matrices(batch["vec"]):
                rows = pa.array(at)
                for t in tables:
                    keys = np.concatenate([buckets(vectors[i : i + step], t, probes.stop, parts) for i in range(0, len(vectors), step)])
                    for j in range(probes.start, keys.shape[1]):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[:, j]), *(batch[n].take(rows) for n in names)], names=["key", *names])

    return run


def nearest(queries: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and Euclidean distances of its k nearest vectors and of those that tie."""
    squares = np.einsum("ij,ij->i", vectors, vectors)
    for i in range(0, len(queries), 256):
        part = queries[i : i + 256]
        own = np.einsum("ij,ij->i", part, part)
        rough = squares[None] + own[:, None] - 2 * part @ vectors.T
        kth = np.partition(rough, min(k, len(vectors)) - 1, 1)[:, min(k, len(vectors)) - 1]
        for q, row, limit, size in zip(part, rough, kth, own, strict=True):
            at = np.flatnonzero(row <= limit + 1e-9 * (size + squares.max()))
            yield at, np.sqrt(np.square(vectors[at] - q).sum(1))


def _found(queries: list, wanted: np.ndarray, limits: np.ndarray | None, ids: list[list[int]], vectors: np.ndarray, k: int) -> pa.Table:
    """The k nearest of each query, of those no farther than its limit."""
    out = []
    for n, (q, (at, distance)) in enumerate(zip(queries, nearest(wanted, vectors, k), strict=True)):
        if limits is not None:
            within = distance <= limits[n]
            at, distance = at[within], distance[within]
        best = sorted((d, i) for a, d in zip(at.tolist(), distance.tolist(), strict=True) for i in ids[a])
        out += [(q, i, d) for d, i in best[:k]]
    cols = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table({"q": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})


_FOUND = "q long, vec_id long, score double"


def _search(k: int):
    def run(classes: pa.Table, probes: pa.Table) -> pa.Table:
        if not classes.num_rows or not probes.num_rows:
            return _found([], np.zeros((0, 1)), None, [], np.zeros((1, 1)), k)
        read = lambda t: np.frombuffer(b"".join(t["vec"].to_pylist()), np.float64).reshape(t.num_rows, -1)  # noqa: E731  a key has one dimension
        return _found(probes["q"].to_pylist(), read(probes), probes["far"].to_numpy(), classes["ids"].to_pylist(), read(classes), k)

    return run


def _exact(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"].to_pylist()
            for at, vectors in _matrices(batch["vec"]):
                own = [(q, v) for q, v in block.value if len(v) == vectors.shape[1] * 8]
                if own:
                    wanted = np.frombuffer(b"".join([v for _, v in own]), np.float64).reshape(len(own), -1)
                    yield from _found([q for q, _ in own], wanted, None, [ids[i] for i in at], vectors, k).to_batches()

    return run


def _waves(tables: int, probes: int) -> Iterator[tuple[range, range]]:
    """Tables and probes that follow one another."""
    done, upto = 0, 1
    while done < probes:
        yield range(1), range(done, min(upto, probes))
        done, upto = upto, upto * WAVE
    if tables > 1:
        yield range(1, tables), range(probes)


def search(embeddings: DataFrame, every: int = 100, k: int = 10, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each vector whose id ``every`` divides."""
    spark = embeddings.sparkSession
    given = embeddings.select(F.col("vec_id").cast("long"), "embedding")
    order = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))  # limited before it is shuffled
    ids = given.mapInArrow(tidy(_valid(k + 1, None)), "vec binary, ids array<long>").select("vec", F.explode("ids").alias("id"))
    few = ids.withColumn("r", order).where(F.col("r") <= k + 1)
    classes = materialize(few.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")))  # k + 1 at most
    asked = materialize(given.where(F.col("vec_id") % every == 0).mapInArrow(tidy(_valid(0, every)), "vec binary, ids array<long>").select("vec", F.explode("ids").alias("query_id")).distinct())
    heads = asked.groupBy("vec").agg(F.min("query_id").alias("q"))
    members = materialize(asked.join(heads, "vec").select("query_id", "q", "vec"))
    heads = members.where("query_id = q").select("q", "vec")

    widest = classes.agg(F.max(F.length("vec"))).first()[0] or 16
    axes = 2 << max(widest // 8 - 1, 1).bit_length()
    cut = 1 << max(0, math.ceil(math.log2(max(1, classes.count()) / (axes * BUCKET))))  # parts of an axis
    probes = math.ceil(probes * cut**GROWTH)
    keys = classes.select("vec").mapInArrow(tidy(_hashed(range(tables), range(1), cut, [])), "key long").groupBy("key").count()
    parts = materialize(keys.select("key", F.ceil(F.col("count") / PART).cast("int").alias("parts")))
    found = None
    for wave in _waves(tables, probes):
        index = classes.mapInArrow(tidy(_hashed(wave[0], range(1), cut, ["vec", "ids"])), "key long, vec binary, ids array<long>").join(parts, "key")
        index = index.withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts").cast("long")).cast("int"))
        far = F.lit(math.inf) if found is None else F.when(F.col("n") > k, F.col("far")).otherwise(math.inf)
        limited = heads if found is None else heads.join(found.groupBy("q").agg(F.count("*").alias("n"), F.max("score").alias("far")), "q", "left")
        limited = limited.select("q", "vec", far.alias("far"))
        probed = limited.mapInArrow(tidy(_hashed(*wave, cut, ["vec", "q", "far"])), "key long, vec binary, q long, far double").join(parts, "key")
        probed = probed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = index.select("key", "part", "vec", "ids").groupBy("key", "part").cogroup(probed.select("key", "part", "vec", "q", "far").groupBy("key", "part")).applyInArrow(tidy_both(_search(k + 1)), _FOUND)
        before, found = found, materialize(_best(met if found is None else found.union(met), k))
        if before is not None:
            discard(before)
    discard(parts)

    ids = classes.select(F.col("vec").alias("v"), F.size("ids").alias("n")).groupBy(F.length("v").alias("size")).agg(F.sum("n").alias("most"))
    short = members.select("q", F.length("vec").alias("size"), "vec").dropDuplicates(["q"]).join(found.groupBy("q").count(), "q", "left").join(ids, "size")
    short = materialize(short.where(F.coalesce("count", F.lit(0)) < F.least("most", F.lit(k + 1))).select("q", "vec"))
    n = -(-short.count() // BLOCK)
    for b in range(n):
        block = spark.sparkContext.broadcast([(r.q, bytes(r.vec)) for r in short.where(F.pmod(F.xxhash64("q"), F.lit(n)) == b).collect()])  # about BLOCK rows
        found = materialize(found.union(_best(classes.mapInArrow(tidy(_exact(block, k + 1)), _FOUND), k)))
    named = _best(found, k).join(members.select("query_id", "q"), "q").where("query_id <> vec_id")
    every_vector = named.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return every_vector.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    return found.groupBy("q", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k + 1).drop("rank")
