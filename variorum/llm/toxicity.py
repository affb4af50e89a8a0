"""Toxicity by a linear classifier over character n-grams with naive Bayes log-count ratios.

Features are the distinct hashed character n-grams of a text (A-Z lowered).
Each is scaled by the log ratio of its smoothed document counts in toxic and
clean training texts; a logistic regression over the scaled features, with
classes weighted alike, gives the score.

The model is fitted on a bounded sample of labelled texts, the first of each
class by a hash of their ids: at most ``per_class``, and as many as have
``FEATURES`` distinct n-grams between them, whatever the number of rows.  All
their n-grams are learnt from; ratios shrink for those that few texts have or
that both classes have alike, and none is left out.
Every text is scored whole, in one narrow pass; nothing but the labels and the
sample is shuffled.

Defined results: null and empty texts have no n-grams and get the score of the
intercept; very long texts are scored whole; rows without a label are not learnt
from; an id with both labels is learnt from with either, equal labels and rows of
one id once, by the text that sorts first; ids that tie in their hash are taken by
their order; a score of just 0.5 counts as toxic; without labels of both classes every
score is the share of toxic ones among those there are, or 0; a null doc_id is
not held out; an empty table gives an empty one.  Other columns are ignored by
``digest`` and pass through elsewhere, whatever their names; ``score`` replaces
a column toxicity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from variorum.llm._grams import chunks, column_bytes
from variorum.llm._shared import discard, materialize, tidy

BITS = 20
SIZES = (4, 5)
#: Texts that the model is fitted on of each class, and their features, at most; the first text of a class is always taken.
PER_CLASS, FEATURES = 1500, 1 << 23
#: Texts, and squares of a log-count ratio, at which an n-gram has half its weight: rare and even ones say less.
_FEW, _EVEN = 10, 0.5
#: Features that a step of the fit works on together, about.
_BLOCK = 1 << 19


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the rows that offsets delimit, A-Z lowered, and each row's first."""
    text = data[offsets[0] : offsets[-1]]
    heads = np.zeros(len(text) + 1, np.int64)
    np.cumsum((text & 0xC0) != 0x80, out=heads[1:])
    points = np.frombuffer(text.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    points[(points >= 65) & (points <= 90)] += np.uint32(32)
    return points, heads[offsets - offsets[0]]


def ngrams(points: np.ndarray, size: int) -> np.ndarray:
    """Buckets of the n-gram at each position."""
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    factors = np.random.default_rng(size).integers(1, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    h = points[:n] * factors[0]
    for j in range(1, size):
        h ^= h >> np.uint32(15)
        h += points[j : j + n] * factors[j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - BITS)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch["text"])
        out = []
        for lo, hi in chunks(offsets):
            points, first = code_points(data, offsets[lo : hi + 1])
            by_size = [ngrams(points, s) for s in SIZES]
            for d in range(hi - lo):
                own = [g[first[d] : max(first[d], first[d + 1] - s + 1)] for s, g in zip(SIZES, by_size, strict=True)]
                out.append(np.unique(np.concatenate(own)).tobytes())
        yield pa.RecordBatch.from_arrays([batch["toxic"], batch["labelled"], pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], names=["toxic", "labelled", "size", "features"])


@dataclass
class Model:
    """Buckets with a weight, their weights, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    @staticmethod
    def fit(rows: list[np.ndarray], toxic: np.ndarray, steps: int = 100, decay: float = 1e-4) -> Model:
        empty = np.zeros(0, np.int64), np.zeros(0, np.float32)
        if not toxic.any() or toxic.all():
            share = float(np.clip(toxic.mean() if len(toxic) else 0.0, 1e-6, 1 - 1e-6))
            return Model(*empty, float(np.log(share / (1 - share))))
        counts = np.zeros((2, 1 << BITS), np.int32)
        for r, y in zip(rows, toxic.tolist(), strict=True):
            counts[int(y), r] += 1  # a row names a bucket once
        q, p = counts
        used = np.flatnonzero(p + q)
        if not len(used):
            return Model(*empty, 0.0)
        ratio = (np.log((p[used] + 1) / (toxic.sum() + 2)) - np.log((q[used] + 1) / ((~toxic).sum() + 2))).astype(np.float32)
        seen = (p + q)[used].astype(np.float32)
        ratio *= seen / (seen + _FEW) * ratio**2 / (ratio**2 + _EVEN)
        column = np.zeros(1 << BITS, np.int32)
        column[used] = np.arange(len(used))
        sizes = np.array([len(r) for r in rows])
        ends = np.cumsum(sizes)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + _BLOCK, _BLOCK)))
        blocks, squares = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            col, owner = column[np.concatenate(rows[lo:hi])], np.repeat(np.arange(hi - lo, dtype=np.int32), sizes[lo:hi])
            blocks.append((slice(lo, hi), col, owner))
            squares.append(np.bincount(owner, ratio[col] ** 2, hi - lo))
        rest = slice(cuts[-1], len(rows))  # texts without features
        scale = np.sqrt(np.maximum(1, np.concatenate([*squares, np.zeros(len(rows) - cuts[-1])]))).mean()
        ratio = ratio / np.float32(scale)
        sign = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
        w, b = np.zeros(len(used)), 0.0
        gw2, gb2 = np.zeros(len(used)), 0.0
        wrong = lambda z, at: (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[at]) * sign[at]
        for _ in range(steps):
            # a feature's value is its ratio in every text that has it
            weight, gw, gb = (w * ratio).astype(np.float32), np.zeros(len(used)), wrong(np.full(rest.stop - rest.start, b), rest).sum()
            for at, col, owner in blocks:
                residual = wrong(np.bincount(owner, weight[col], at.stop - at.start) + b, at)
                gw += np.bincount(col, residual[owner], len(used))
                gb += residual.sum()
            gw = gw * ratio + decay * w
            gw2 += gw * gw
            gb2 += gb * gb
            w -= gw / np.sqrt(gw2 + 1e-12)
            b -= gb / np.sqrt(gb2 + 1e-12)
        return Model(used, (w * ratio).astype(np.float32), float(b))

    def scores(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Probability of each row; table holds the weights of all buckets."""
        out = []
        for lo, hi in chunks(offsets):
            points, first = code_points(data, offsets[lo : hi + 1])
            total = np.full(hi - lo, self.intercept)
            keys = []
            for size in SIZES:
                g = ngrams(points, size)
                at = np.flatnonzero(table[g] != 0)
                row = np.searchsorted(first, at, side="right") - 1
                inside = at + size <= first[row + 1]
                keys.append((row[inside].astype(np.int64) << BITS) | g[at[inside]])
            seen = np.unique(np.concatenate(keys))
            total += np.bincount(seen >> BITS, table[seen & ((1 << BITS) - 1)], hi - lo)
            out.append(1 / (1 + np.exp(-np.clip(total, -700, 700))))
        return np.concatenate(out) if out else np.zeros(0)


def remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = 5) -> Model:
    """A model of labels.toxic, without the rows whose crc32 of the id leaves 0."""
    rows = labels.where((remainder("doc_id", folds) != 0) & F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("labelled"), F.lit(1 << 40))

    def one(y: int) -> DataFrame:
        # about twice as many as are taken come to the sort; fewer than are taken, for no size that could happen
        share = min(1.0, (2 * per_class + 200) / max(1, sizes.get(y, 0)))
        own = rows.where((F.col("toxic") == y) & (place < int(share * (1 << 40))))
        return own.orderBy(place, "labelled").limit(per_class)

    sample = F.broadcast(one(0).union(one(1)))  # 2 * per_class ids at most
    docs = docs.select("doc_id", "text")
    texts = docs.join(sample, docs["doc_id"] == sample["labelled"]).groupBy("toxic", "labelled").agg(F.min("text").alias("text"))
    id_ = sample.schema["labelled"].dataType.simpleString()
    found = materialize(texts.mapInArrow(tidy(_features), f"toxic int, labelled {id_}, size long, features binary"))
    kept = []
    for y in (0, 1):  # 2 * per_class rows in all
        total = 0
        for r in found.where(F.col("toxic") == y).select("labelled", "size", place.alias("place")).orderBy("place", "labelled").collect():
            total += r["size"]
            if total > FEATURES // 2 and total > r["size"]:
                break
            kept.append((y, r["labelled"]))
    chosen = set(kept)
    fetched = [(r["toxic"], np.frombuffer(r["features"], np.uint32)) for r in _chosen(found, chosen).toLocalIterator()]
    discard(found)
    order = sorted(fetched, key=lambda x: (x[0], hashlib.blake2b(x[1]).digest()))  # as rows come in any order
    return Model.fit([x for _, x in order], np.array([y == 1 for y, _ in order], bool))


def _chosen(found: DataFrame, keys: set) -> DataFrame:
    if not keys:
        return found.limit(0)
    few = found.sparkSession.createDataFrame(sorted(keys), found.select("toxic", "labelled").schema)
    return found.join(F.broadcast(few), ["toxic", "labelled"], "left_semi")  # 2 * PER_CLASS keys at most


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """(row, text, score), with all columns of docs in row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.buckets, model.weights, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, weights, intercept = sent.value
        own = Model(buckets, weights, intercept)
        table = np.zeros(1 << BITS, np.float32)
        table[buckets] = weights
        for batch in batches:
            found = own.scores(*column_bytes(batch["text"]), table)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(found, pa.float64())], names=["row", "score"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return packed.mapInArrow(tidy(run), StructType([packed.schema["row"], StructField("score", DoubleType())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a last column toxicity, a probability; a column of that name is replaced."""
    return _scored(docs.drop("toxicity"), model).select("row.*", F.col("score").alias("toxicity"))


def digest(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, **options))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs with a score below 0.5."""
    return _scored(docs, train(docs, labels, **options)).where("score < 0.5").select("row.*")
