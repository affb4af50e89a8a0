"""Scores of whole documents by a gated recurrent language model and by a unigram base.

1. Words of all training documents are counted, in buckets of their hash.
2. The most frequent words are the model's symbols, beside one for the end and
   one for all other words; symbols are split over classes by falling counts.
   All documents are written as symbols, from which the next steps work.
3. All training documents train the network, each once: learners in parallel,
   each on its part of the round's documents, dealt to rounds and learners by a
   hash of doc_id and text, whose parameters are averaged after every round.
4. Every document is scored whole, with the state carried across windows.

A word that is no symbol has the probability of the other-words symbol times
(c + 1) / (n + v + 1), with c its count among the n training tokens of such
words, of which v are distinct.  Counts of the ``COMMON`` most frequent words
are broadcast; the others' meet their documents in a packed exchange by hash,
so every count is exact and none is gathered.

Defined results: null and empty texts are the end token alone; very long texts
are scored whole, with the state carried over all windows; a null doc_id is
learnt from (its remainder is unknown); rows with equal doc_id and text are
learnt from, by one learner, and scored one by one; words that tie in frequency
rank by their hash; without training documents all counts are 0; an empty table
gives an empty one.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructType

from variorum.llm import _exchange as ex
from variorum.llm import _gru as gru
from variorum.llm._grams import SPACED_LOWER, chunks, column_bytes, slices, words
from variorum.llm._shared import materialize, tidy, tidy_both, tidy_group
from variorum.llm.toxicity import remainder

#: Words whose counts are broadcast, and symbols of the network: fixed bounds.
COMMON, SYMBOLS = 1 << 17, 4096
#: Leading bits of a hash by which common words are found.
SLOT_BITS = 19
#: Rounds of the one pass over the training documents.
ROUNDS = 8
#: Training tokens of a learner in all rounds, about.
LEARNER_TOKENS = 1 << 21
#: Bytes of text that a task works on at once, about; and bytes of symbols that it scores, or of rare words that it packs.
PIECE_BYTES, ENCODED_BYTES = 8 << 20, 8 << 20
_PARTIAL = "bucket long, hashes binary, counts binary"


@dataclass
class Vocabulary:
    """Sorted hashes and counts of the common words, the symbol of each (or ``other``), and corpus totals."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    symbol_counts: np.ndarray
    other: int
    end: int
    tokens: int
    distinct: int
    tail: int  # tokens of words that are no symbol, plus their distinct words

    @staticmethod
    def of(hashes: np.ndarray, counts: np.ndarray, ends: int, tokens: int, distinct: int) -> Vocabulary:
        """hashes by falling counts; tokens and distinct include the ends."""
        n = min(len(hashes), SYMBOLS - 2)
        rest = tokens - ends - int(counts[:n].sum())
        every = np.concatenate([counts[:n], [rest, ends], np.zeros(SYMBOLS - 2 - n, np.int64)])
        place = np.empty(SYMBOLS, np.int64)
        place[np.argsort(-every, kind="stable")] = np.arange(SYMBOLS)
        symbols = np.full(len(hashes), place[n])
        symbols[:n] = place[:n]
        order = np.argsort(hashes)
        kinds = distinct - (ends > 0) - n
        return Vocabulary(hashes[order], counts[order], symbols[order].astype(np.int32), np.sort(every)[::-1], int(place[n]), int(place[n + 1]), tokens, distinct, rest + kinds)

    @cached_property
    def network(self) -> gru.Params:
        return gru.start(self.symbol_counts)

    @cached_property
    def first(self) -> np.ndarray:
        """The place of the first hash whose leading SLOT_BITS are at least this slot's, or the last place."""
        at = np.searchsorted(self.hashes >> np.uint64(64 - SLOT_BITS), np.arange(1 << SLOT_BITS, dtype=np.uint64))
        return np.minimum(at, len(self.hashes) - 1).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's symbol and count; the count of words that are not common is -1."""
        if not len(self.hashes):
            return np.full(len(hashes), self.other, np.int32), np.full(len(hashes), -1)
        at = self.first[hashes >> np.uint64(64 - SLOT_BITS)]
        later = np.flatnonzero(self.hashes[at] < hashes)  # not the first of its slot
        at[later] = np.minimum(np.searchsorted(self.hashes, hashes[later]), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        return np.where(known, self.symbols[at], self.other).astype(np.int32), np.where(known, self.counts[at], -1)


def _cut(buckets: int, h: np.ndarray) -> np.ndarray:
    bits = buckets.bit_length() - 1
    return np.searchsorted((h >> np.uint64(64 - bits)).astype(np.int64), np.arange(buckets + 1))


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text", 2 * PIECE_BYTES)):
            data, offsets = column_bytes(batch["text"])
            every = [words(data, offsets[lo : hi + 1], SPACED_LOWER).hashes for lo, hi in chunks(offsets)]
            h, n = np.unique(np.concatenate(every), return_counts=True)
            cut = _cut(buckets, h)
            own = np.flatnonzero(np.diff(cut)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *(pa.array([ex.planes(x[cut[b] : cut[b + 1]]) for b in own], pa.binary()) for x in (h, n.astype(np.uint32)))], names=["bucket", "hashes", "counts"])

    return run


def _sum_counts(table: pa.Table) -> pa.Table:
    h, at = np.unique(np.concatenate([ex.unplanes(x, np.uint64) for x in table["hashes"].to_pylist()]), return_inverse=True)
    n = np.zeros(len(h), np.int64)
    np.add.at(n, at, np.concatenate([ex.unplanes(x, np.uint32) for x in table["counts"].to_pylist()]).astype(np.int64))
    levels = [{"level": int(x), "n": int(k)} for x, k in zip(*np.unique(_levels(n), return_counts=True), strict=True)]
    return pa.table({"bucket": table["bucket"].slice(0, 1), "hashes": pa.array([ex.planes(h)], pa.binary()), "counts": pa.array([ex.planes(n)], pa.binary()), "tokens": pa.array([int(n.sum())]), "kinds": pa.array([len(h)]), "levels": pa.array([levels], pa.list_(pa.struct([("level", pa.int64()), ("n", pa.int64())])))})


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts up to 63 as they are, others in eighths of octaves."""
    return np.where(counts < 64, counts, 64 + np.floor(8 * np.log2(np.maximum(counts, 64) / 64))).astype(np.int64)


def _pick(choose):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch["hashes"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                h, n = ex.unplanes(a, np.uint64), ex.unplanes(b, np.int64)
                top = choose(h, n)
                yield pa.RecordBatch.from_arrays([pa.array(h[top].view(np.int64)), pa.array(n[top])], names=["hash", "n"])

    return run


def _tally(counts: DataFrame, values) -> list[tuple[int, int]]:
    """Each value of values(hashes, counts) and how often it occurs, summed over the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch["hashes"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                found, times = np.unique(values(ex.unplanes(a, np.uint64), ex.unplanes(b, np.int64)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(times.astype(np.int64))], names=["value", "n"])

    sizes = counts.select("hashes", "counts").mapInArrow(tidy(run), "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    return [(r["value"], r["n"]) for r in sizes.collect()]


def _fit(sizes: list[tuple[int, int]], room: int) -> tuple[int, int, int | None]:
    """From the largest value: the least that is taken whole, the places left, and the value that does not fit."""
    least = 1 << 62
    for value, n in sorted(sizes, reverse=True):
        if n > room:
            return least, room, value
        least, room = value, room - n
    return least, room, None


def _part(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(4095)).astype(np.int64)


def common_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, by falling counts: COMMON, or less by a 4096th of the words with the least count taken.

    Whole levels of counts first; of the level that does not fit, whole counts; of the count that does not fit, parts by hash.
    """
    sizes = counts.select(F.explode("levels").alias("x")).groupBy("x.level").agg(F.sum("x.n").alias("n")).collect()  # some hundred rows
    level, room, over = _fit([(r["level"], r["n"]) for r in sizes], COMMON)
    least = part = 1 << 62
    edge = None
    if over is not None:
        least, room, edge = _fit(_tally(counts, lambda h, n: n[_levels(n) == over]), room)
    if edge is not None:
        part = _fit(_tally(counts, lambda h, n: _part(h[n == edge])), room)[0]
    high, last = (-1 if x is None else x for x in (over, edge))

    def choose(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        own = _levels(n)
        return (own >= level) | ((own == high) & (n >= least)) | ((n == last) & (_part(h) >= part))

    found = counts.select("hashes", "counts").mapInArrow(tidy(_pick(choose)), "hash long, n long").toArrow()  # COMMON rows at most
    h, n = found["hash"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.lexsort((h, -n))
    return h[order], n[order]


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary for each of sizes: that many of the values in a row."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of binaries, and how many each has."""
    column = column.cast(pa.binary())
    sizes = pc.binary_length(column).to_numpy().astype(np.int64)
    _, at, data = column.buffers()
    first = int(np.frombuffer(at, np.int32)[column.offset]) if len(column) else 0
    own = np.frombuffer(data, np.uint8)[first : first + sizes.sum()] if data is not None and data.size else np.zeros(0, np.uint8)
    return own.view(kind), sizes // np.dtype(kind).itemsize


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches in parts with about ENCODED_BYTES of a column."""
    for batch in batches:
        for lo, hi in chunks(np.concatenate([[0], np.cumsum(pc.binary_length(batch[column]).to_numpy(), dtype=np.int64)]), ENCODED_BYTES):
            yield batch.slice(lo, hi - lo)


def _encode(vocabulary):
    """Of each document: symbols, sums over its words, and the hashes of words that are not common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        for batch in (part for b in batches for part in slices(b, "text", PIECE_BYTES)):
            data, offsets = column_bytes(batch["text"])
            for lo, hi in chunks(offsets):
                w = words(data, offsets[lo : hi + 1], SPACED_LOWER)
                symbols, counts = v.find(w.hashes)
                docs, row = hi - lo, w.row()
                count = lambda at: np.bincount(row[at], minlength=docs)  # noqa: E731, B023
                logs, tail, rare = np.log10(np.maximum(counts, 0) + 1.0), symbols == v.other, counts < 0
                total = lambda at: np.bincount(row[at], logs[at], docs).astype(np.float64)  # noqa: E731, B023 - integers if there are none
                sums = [np.diff(w.first) + 1, count(counts > 0), total(slice(None)), total(tail), count(tail)]
                own = [_packed(symbols.astype(np.uint16), np.diff(w.first)), _packed(w.hashes[rare], count(rare)), *(pa.array(x, pa.from_numpy_dtype(x.dtype)) for x in sums)]
                part = batch.slice(lo, docs)
                yield pa.RecordBatch.from_arrays([*(part[k] for k in _KEYS), *own], names=[*_KEYS, *_ENCODED.names])

    return run


_KEYS = ["row", "key1", "key2", "deal"]
_SUMMED = ["n_tokens", "n_known", "base", "rest", "n_other"]
_ENCODED = StructType().add("symbols", BinaryType()).add("rare", BinaryType()).add("n_tokens", LongType()).add("n_known", LongType()).add("base", DoubleType()).add("rest", DoubleType()).add("n_other", LongType())


def encode(docs: DataFrame, vocabulary) -> DataFrame:
    """A written table of all documents as symbols: learning, scoring and rare words take theirs from it, and texts are read once."""
    keyed = docs.select(F.struct("doc_id").alias("row"), F.xxhash64("doc_id").alias("key1"), F.xxhash64("text", "doc_id").alias("key2"), F.xxhash64("doc_id", "text").alias("deal"), "text")
    return materialize(keyed.mapInArrow(tidy(_encode(vocabulary)), StructType([*(keyed.schema[k] for k in _KEYS), *_ENCODED.fields])))


def _rare(buckets: int):
    """Occurrences of words that are not common: a row for each bucket of each chunk, and the chunk's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        for batch in _parts(batches, "rare"):
            keys = np.stack([batch["key1"].to_numpy(), batch["key2"].to_numpy()], 1)
            h, sizes = _unpacked(batch["rare"], np.uint64)
            o = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((o, h))
            h, o = h[order], o[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(h))).astype(np.uint32)
            h, o = h[first], o[first].astype(np.uint32)
            cut = _cut(buckets, h)
            chunk = (task << 32) | seq
            seq += 1
            rows = [(-1 - chunk % buckets, chunk, ex.planes(keys.ravel()), b"", b"")]
            rows += [(b, chunk, *(ex.planes(x[cut[b] : cut[b + 1]]) for x in (h, o, times))) for b in np.flatnonzero(np.diff(cut)).tolist()]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(x, pa.binary()) for x in cols[2:])], names=["bucket", "chunk", "hashes", "owners", "times"])

    return run


_SUMS = "chunk long, bucket long, owners binary, logs binary, known binary"


def _look_up(occurrences: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums of log10(c + 1), and tokens with a count, by chunk and document."""
    out = []
    h = ex.unplanes(counts["hashes"][0].as_py(), np.uint64) if counts.num_rows else np.zeros(0, np.uint64)
    n = ex.unplanes(counts["counts"][0].as_py(), np.int64) if counts.num_rows else np.zeros(0, np.int64)
    for row in occurrences.to_pylist():
        if row["bucket"] < 0:
            out.append((row["chunk"], row["bucket"], row["hashes"], None, None))
            continue
        own, o, times = ex.unplanes(row["hashes"], np.uint64), ex.unplanes(row["owners"], np.uint32), ex.unplanes(row["times"], np.uint32)
        c = np.zeros(len(own), np.int64)
        if len(h):
            at = np.minimum(np.searchsorted(h, own), len(h) - 1)
            c = np.where(h[at] == own, n[at], 0)
        docs, at = np.unique(o, return_inverse=True)
        out.append((row["chunk"], row["bucket"], ex.planes(docs), np.bincount(at, times * np.log10(c + 1), len(docs)).tobytes(), np.bincount(at, times * (c > 0), len(docs)).tobytes()))
    cols = list(zip(*out, strict=True)) or [()] * 5
    return pa.table({"chunk": pa.array(cols[0], pa.int64()), "bucket": pa.array(cols[1], pa.int64()), "owners": pa.array(cols[2], pa.binary()), "logs": pa.array(cols[3], pa.binary()), "known": pa.array(cols[4], pa.binary())})


def _home(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
    keys = ex.unplanes(rows[0]["owners"], np.int64).reshape(-1, 2)
    logs, known = np.zeros(len(keys)), np.zeros(len(keys))
    for r in rows[1:]:
        at = ex.unplanes(r["owners"], np.uint32)
        logs[at] += np.frombuffer(r["logs"])
        known[at] += np.frombuffer(r["known"])
    some = (logs > 0) | (known > 0)
    return pa.table({"key1": keys[some, 0], "key2": keys[some, 1], "rare_log": logs[some], "rare_known": known[some].astype(np.int64)})


def _learn(vocabulary, params, seed: int):
    def run(table: pa.Table) -> pa.Table:
        v: Vocabulary = vocabulary.value
        gru.one_thread()
        p = gru.unpack(params.value, v.network)
        found = [np.frombuffer(x, np.uint16) for x in sorted(table["symbols"].to_pylist())]
        order = np.random.default_rng(seed).permutation(len(found))
        p = gru.train(p, [found[j] for j in order], v.end)
        tokens = sum(map(len, found)) + len(found)
        return pa.table({"learner": table["learner"].slice(0, 1), "tokens": pa.array([tokens], pa.int64()), "params": pa.array([gru.pack(p)], pa.binary())})

    return run


def _average(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["learner"])
    total = sum(r["tokens"] for r in rows)
    mean = sum(np.frombuffer(r["params"], np.float32).astype(np.float64) * (r["tokens"] / total) for r in rows)
    return pa.table({"learner": pa.array([rows[0]["learner"]], pa.int64()), "tokens": pa.array([total], pa.int64()), "params": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def fit(train: DataFrame, vocabulary, params: gru.Params) -> bytes:
    return learnt(encode(train, vocabulary), vocabulary, params)


def learnt(symbols: DataFrame, vocabulary, params: gru.Params) -> bytes:
    """Parameters after ROUNDS rounds of parallel learners, which share all training documents; each is in one round."""
    spark = symbols.sparkSession
    tokens = symbols.agg(F.sum(F.length("symbols") / 2)).first()[0] or 0
    learners = int(tokens // LEARNER_TOKENS) + 1
    slot = F.pmod("deal", F.lit(learners * ROUNDS))
    dealt = symbols.select("symbols", (slot % ROUNDS).alias("round"), F.floor(slot / ROUNDS).alias("learner"))
    packed = gru.pack(params)
    for r in range(ROUNDS):
        own = dealt.where(F.col("round") == r).drop("round").repartition(2 * learners, "learner")  # their bytes are few, their work is not
        rows = own.groupBy("learner").applyInArrow(tidy_group(_learn(vocabulary, spark.sparkContext.broadcast(packed), r)), "learner long, tokens long, params binary")
        rows, n = materialize(rows), learners
        while n > 1:  # averages of 16 at a time, so no task holds more
            rows = rows.groupBy((F.col("learner") / 16).cast("long").alias("learner_group")).applyInArrow(tidy_group(_average), "learner long, tokens long, params binary")
            rows, n = materialize(rows.withColumn("learner", (F.col("learner") / 16).cast("long"))), -(-n // 16)
        found = rows.first()
        packed = bytes(found["params"]) if found else packed
    return packed


def _score(vocabulary, params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        gru.one_thread()
        p = gru.unpack(params.value, v.network)
        for batch in _parts(batches, "symbols"):
            symbols, sizes = _unpacked(batch["symbols"], np.uint16)
            model = gru.log_likelihoods(p, np.split(symbols, np.cumsum(sizes)[:-1]), v.end) / np.log(10)
            out = [*(batch[k] for k in ("row", "key1", "key2", "n_tokens", "n_known", "base")), pa.array(model + batch["rest"].to_numpy()), batch["n_other"]]
            yield pa.RecordBatch.from_arrays(out, names=["row", "key1", "key2", *_SCORED.names])

    return run


_SCORED = StructType().add("n_tokens", LongType()).add("n_known", LongType()).add("base", DoubleType()).add("model", DoubleType()).add("n_other", LongType())


def score(docs: DataFrame, folds: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document.

    Documents whose crc32 of the id as text leaves held_out modulo folds are not learnt from.
    """
    spark = docs.sparkSession
    out_of = F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False))
    docs = docs.select("doc_id", "text")
    train = docs.where(~out_of)
    buckets = ex.buckets_for(docs)
    counts = materialize(train.select("text").mapInArrow(tidy(_count(buckets)), _PARTIAL).groupBy("bucket").applyInArrow(tidy_group(_sum_counts), _PARTIAL + ", tokens long, kinds long, levels array<struct<level:long,n:long>>"))
    totals = counts.agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    ends = train.count()
    found = Vocabulary.of(*common_words(counts), ends, (totals.tokens or 0) + ends, (totals.kinds or 0) + (ends > 0))
    vocabulary = spark.sparkContext.broadcast(found)
    encoded = encode(docs, vocabulary)
    symbols = encoded.select("row.doc_id", "deal", "symbols").where(~out_of)
    params = spark.sparkContext.broadcast(learnt(symbols, vocabulary, found.network))

    rare = encoded.select("key1", "key2", "rare").mapInArrow(tidy(_rare(buckets)), "bucket long, chunk long, hashes binary, owners binary, times binary")
    met = rare.groupBy("bucket").cogroup(counts.select("bucket", "hashes", "counts").groupBy("bucket")).applyInArrow(tidy_both(_look_up), _SUMS)
    sums = met.groupBy("chunk").applyInArrow(tidy_group(_home), "key1 long, key2 long, rare_log double, rare_known long").dropDuplicates(["key1", "key2"])
    keys = ["row", "key1", "key2"]
    own = encoded.select(*keys, "symbols", *_SUMMED).mapInArrow(tidy(_score(vocabulary, params)), StructType([*(encoded.schema[k] for k in keys), *_SCORED.fields]))
    both = own.join(sums, ["key1", "key2"], "left").select("row.doc_id", *_SCORED.names, F.coalesce("rare_log", F.lit(0.0)).alias("rare_log"), F.coalesce("rare_known", F.lit(0)).alias("rare_known"))
    end_log, seen = float(np.log10(ends + 1)), int(ends > 0)
    unit, tail = float(np.log10(found.tokens + found.distinct + 1)), float(np.log10(found.tail + 1))
    return both.select(
        "doc_id",
        out_of.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.col("rare_known") + seen).alias("n_known"),
        F.lit(found.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_log") + end_log - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("model") + F.col("rare_log") - F.col("n_other") * tail).alias("score"),
    )
