"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its word shingles.  Documents with equal sets form a
class; only classes are compared.  The sketch of a class holds its k smallest
shingle hashes.  The inverted lists of retained values, taken as runs of
consecutive values, generate overlaps: sets as similar as asked for share such
a run (surely, while the sketch is the whole set; else but for the odds that
``run_lengths`` names).  Classes with overlaps form candidate clusters.

Before any pair is made, a cluster loses the classes that can have no link:
the shingles that a set shares with any other one of its cluster bound what it
shares with one of them, and so the sizes that a linked set may have.  In the
rest the bottom-k sketch of each pair's union estimates the similarity; pairs
that it cannot rule out are compared by their full sets, exactly.

A cluster of many classes is cut into blocks.  First each block is compared
within and with the next one, so a set goes to two tasks; what these links join
has one label.  Then only the classes outside the cluster's most frequent label
are compared with all of the cluster, block by block, and a task emits links
between different labels alone.  So links are linear in the classes, and so are
copies of sets but for classes that, as near as they are, stay apart.

Defined results: null and empty texts have no shingles and are linked with
nothing; texts with fewer words than a shingle are one shingle; very long texts
are hashed whole, in pieces of memory; equal rows are one class, and doc_id
names the document, so different texts under one doc_id may be linked through
it; ties, as a similarity just at the threshold, are links; a null doc_id takes
the smallest doc_id of its class, or null, and is kept where it is null; an
empty table gives an empty one.  Columns beside the named ones are ignored,
whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm import _exchange as ex
from variorum.llm._components import components
from variorum.llm._grams import SPACED_LOWER, Words, chunks, column_bytes, grams, mix, words
from variorum.llm._shared import materialize, tidy, tidy_group

#: Classes and shingles that a block of a cluster holds, about.
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 1 << 20
#: Shingles whose sharing is settled together, about.
CHUNK_SHINGLES = 1 << 18
#: Odds that the estimate rules out a pair just at the threshold.
_ODDS = 1e-9


def run_lengths(threshold: Fraction) -> tuple[int, int, int]:
    """(small, large, bound): sets of up to bound shingles that reach the threshold share a run of small values, others of large.

    With s of u values shared, u - s breaks leave a run of s / (u - s + 1) at least.  Where sketches hold a part of their
    sets, the odds that 80 values have no run of large are about 2e-7 at a similarity of 0.85 and 3e-8 at one of 0.8.
    """
    bound = math.ceil(4 / (1 - threshold)) if threshold < 1 else 1

    def least(sizes: range) -> int:
        runs = [-(-s // (u - s + 1)) for u in sizes if (s := math.ceil(threshold * u)) < u]
        return min(runs, default=1)

    return least(range(2, bound + 1)), least(range(bound + 1, 8 * bound)), bound


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    out: list[np.ndarray] = []
    for lo, hi in chunks(offsets):
        w = words(data, offsets[lo : hi + 1], SPACED_LOWER)
        by_size = {size: grams(w, size)[0]}
        for d in range(hi - lo):
            a, n = int(w.first[d]), int(w.first[d + 1] - w.first[d])
            if n >= size:
                out.append(np.unique(by_size[size][a : a + n - size + 1]))
            elif n == 0:
                out.append(np.zeros(0, np.uint64))
            else:
                if n not in by_size:
                    by_size[n] = grams(w, n)[0]
                out.append(by_size[n][a : a + 1])
    return out


def _sketch(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(*column_bytes(batch["text"]), size)
            digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) if len(s) else (None, None) for s in sets]
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([s[:k].tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *cols], names=["doc_id", "n_shingles", "key1", "key2", "sketch"])

    return run


def _lists(threshold: Fraction, buckets: int):
    """Inverted lists in packed form: (bucket, keys, owners); bucket below 0: links found within the batch."""
    small, large, bound = run_lengths(threshold)
    bits = buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, n = batch["rep"].to_numpy(), batch["n"].to_numpy()
            sketches = [np.frombuffer(x, np.uint64) for x in batch["sketch"].to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(s) for s in sketches])])
            w = Words(first, first, np.concatenate([np.zeros(0, np.uint64), *sketches]), first)
            row = w.row()
            keys, owners = [], []
            for q, wanted in ((small, n <= bound), (large, n >= math.floor(threshold * bound))):
                h, inside = grams(w, q)
                at = np.flatnonzero(inside & wanted[row[: len(h)]])
                keys.append(h[at] ^ np.uint64(q))
                owners.append(rep[row[at]])
            h, o = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((o, h))
            h, o = h[order], o[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            head = o[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else o
            links = np.unique(np.stack([head, o], 1)[head != o], axis=0)
            out = [(-1, links[:, 0].tobytes(), links[:, 1].tobytes())] if len(links) else []
            h, o = h[new], o[new]
            cut = np.searchsorted((h >> np.uint64(64 - bits)).astype(np.int64), np.arange(buckets + 1))
            out += [(b, ex.planes(h[cut[b] : cut[b + 1]]), ex.planes(o[cut[b] : cut[b + 1]])) for b in np.flatnonzero(np.diff(cut)).tolist()]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["bucket", "keys", "owners"])

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _overlaps(table: pa.Table) -> pa.Table:
    """Links of each list's classes with its smallest one."""
    h = np.concatenate([ex.unplanes(x, np.uint64) for x in table["keys"].to_pylist()])
    o = np.concatenate([ex.unplanes(x, np.int64) for x in table["owners"].to_pylist()])
    order = np.lexsort((o, h))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    head = o[np.flatnonzero(new)][np.cumsum(new) - 1]
    links = np.unique(np.stack([head, o], 1)[head != o], axis=0)
    return _pairs(links[:, 0], links[:, 1])


def _local_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch["keys"].to_pylist(), batch["owners"].to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], names=["a", "b"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(*column_bytes(batch["text"]), size)
            step = 256
            for i in range(0, len(sets), step):
                part, own = batch.slice(i, step), sets[i : i + step]
                yield pa.RecordBatch.from_arrays([part["cluster"], part["rep"], pa.array([len(s) for s in own], pa.int64()), pa.array([ex.planes(s) for s in own], pa.binary())], names=["cluster", "rep", "n", "shingles"])

    return run


def _places(batch: pa.RecordBatch) -> Iterator[ex.Chunk]:
    """The shingles of each set, told apart by cluster, as places of the set."""
    cluster, key, sizes = (batch[c].to_numpy() for c in ("cluster", "key", "n"))
    for lo, hi in chunks(np.concatenate([[0], np.cumsum(sizes)]), CHUNK_SHINGLES):
        h = np.concatenate([ex.unplanes(x.as_py(), np.uint64) for x in batch["shingles"][lo:hi]])
        apart = mix(cluster[lo:hi].astype(np.uint64))
        yield ex.Chunk(mix(h ^ np.repeat(apart, sizes[lo:hi])), np.arange(len(h)), None, sizes[lo:hi], cluster[lo:hi], key[lo:hi])


def _supports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in batch["marks"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["key1"], batch["key2"], pa.array(held, pa.int64())], names=["cluster", "key", "support"])


def promising(sets: DataFrame, threshold: Fraction, buckets: int) -> DataFrame:
    """(cluster, rep, n) of the sets (cluster, rep, key, n, shingles) that may have a link within their cluster.

    A linked set y of x shares t / (1 + t) * (|x| + |y|) shingles with it at least, and no more than x shares with any
    others, its support.  So |y| is support * (1 + t) / t - |x| at most; and where x is the larger one, y's own support
    must allow a set as large as y.  Sizes are compared by levels of about 4 %, never too strictly.
    """
    p, q = threshold.numerator, threshold.denominator
    level = lambda n: F.floor(F.log2(F.greatest(n, F.lit(1))) * 16).cast("int")
    marks = ex.repeated(sets.select("cluster", "key", "n", "shingles").mapInArrow(tidy(ex.pack(_places, buckets, False)), ex.PACKED), False, False)
    support = marks.mapInArrow(tidy(_supports), "cluster long, key long, support long").dropDuplicates(["cluster", "key"])
    known = sets.select("cluster", "rep", "key", "n").join(support, ["cluster", "key"]).where(F.col("support") * q >= F.col("n") * p)
    most = F.floor(F.col("support") * (p + q) / p) - F.col("n")  # the size of a linked set
    known = materialize(known.select("cluster", "rep", "n", most.alias("most")))
    even = known.where("most >= n").groupBy("cluster").agg(F.collect_set(level(F.col("n"))).alias("levels"))  # some hundred levels at most
    fits = F.exists("levels", lambda x: (x >= level(F.col("n") * (p / q)) - 1) & (x <= level(F.col("most")) + 1))
    kept = known.join(even, "cluster").where((F.col("most") >= F.col("n")) | fits)
    return materialize(kept.groupBy("cluster", "rep").agg(F.max("n").alias("n")))


def estimates(sets: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of sets: values shared and held by the bottom-k sketch of their union."""
    sketches = [s[:k] for s in sets]
    values, at, times = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sketches])
    column = np.cumsum(times > 1) - 1
    held = np.zeros((len(sets), int(column[-1]) + 1), np.float32)
    often = times[at] > 1
    held[owner[often], column[at[often]]] = 1
    shared = np.rint(held @ held.T).astype(np.int64)
    top = np.array([s[k - 1] if len(s) > k else np.uint64(2**64 - 1) for s in sets], np.uint64)
    below = np.stack([np.searchsorted(s, top, side="right") for s in sketches])
    return shared, below + below.T - shared


@functools.cache
def least_shared(threshold: Fraction, most: int) -> np.ndarray:
    """For unions of 0 to most values: the least shared ones that a pair at the threshold falls below with odds of _ODDS at most.

    A value of the union's sketch is shared with the odds of the similarity, so the tail is binomial.
    """
    t, out = float(threshold), np.zeros(most + 1, np.int64)
    for u in range(most + 1):
        below = 0.0
        while out[u] < u and (below := below + math.comb(u, int(out[u])) * t ** int(out[u]) * (1 - t) ** (u - int(out[u]))) <= _ODDS:
            out[u] += 1
    return out


def linked(sets: list[np.ndarray], threshold: Fraction, k: int, label: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that reach the threshold, as many as join what they can join: a spanning forest over the labels, by default one each.

    With side, only pairs of which one at least is marked.
    """
    p, q = threshold.numerator, threshold.denominator
    n = np.array([len(s) for s in sets])
    label = np.arange(len(sets)) if label is None else label
    shared, union = estimates(sets, k)
    whole = (n <= k)[:, None] & (n <= k)[None, :]
    likely = np.where(whole, shared * q >= p * union, shared >= least_shared(threshold, 2 * k)[union])
    likely &= np.minimum.outer(n, n) * q >= p * np.maximum.outer(n, n)
    likely &= np.triu(label[:, None] != label[None, :], 1)
    if side is not None:
        likely &= side[:, None] | side[None, :]
    a, b = np.nonzero(likely)
    order = np.argsort(-shared[a, b] / union[a, b], kind="stable")
    own, up = np.unique(label, return_inverse=True)[1].tolist(), list(range(len(sets)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        x, y = find(own[i]), find(own[j])
        if x != y:
            both = len(sets[i]) + len(sets[j]) - len(np.union1d(sets[i], sets[j])) if not whole[i, j] else shared[i, j]
            if both * q >= p * (n[i] + n[j] - both):
                up[x] = y
                out.append((i, j))
    return out


def _stars(pairs: np.ndarray) -> np.ndarray:
    """Rows (smallest number, other number) of each component that pairs make."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in pairs.tolist():
        low, high = sorted((find(x), find(y)))
        up[high] = low
    return np.array([(find(x), x) for x in sorted(up) if find(x) != x], np.int64).reshape(-1, 2)


def _compare(threshold: Fraction, k: int):
    """Links of a table of sets, as stars of what they join: of reps, or of labels where sets have one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending")])  # rows come in any order; what is found must not depend on it
        far = "label" in table.column_names
        label, side = (table["label"].to_numpy(), table["apart"].to_numpy()) if far else (None, None)
        name = label if far else table["rep"].to_numpy()
        pairs = linked([ex.unplanes(x, np.uint64) for x in table["shingles"].to_pylist()], threshold, k, label, side) if len(name) > 1 else []
        ends = _stars(name[np.array(pairs, np.int64).reshape(-1, 2)])
        return pa.table({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1]), "wide": pa.array(np.full(len(ends), not far and table["blocks"][0].as_py() > 2))})

    return run


def _blocks(cut: DataFrame, name: str) -> DataFrame:
    """cut (cluster, rep, n) with name, the number of blocks that the classes of a cluster make."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    return cut.join(cut.groupBy("cluster").agg(blocks.alias(name)), "cluster")


def links_within(sets: DataFrame, kept: DataFrame, threshold: Fraction, k: int) -> DataFrame:
    """(node, component) of the sets that have links; kept (cluster, rep, n) are those that are compared."""
    number = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks).cast("long")).cast("int")
    cut = materialize(_blocks(kept, "blocks").select("cluster", "rep", "n", "blocks", number("blocks").alias("own")))
    # each block meets the next; two blocks meet in one place, which settles their cluster
    places = F.when(F.col("blocks") <= 2, F.array(F.lit(0))).otherwise(F.array("own", F.pmod(F.col("own") + 1, F.col("blocks"))))
    near = sets.select("rep", "shingles").join(cut.select("cluster", "rep", "blocks", F.explode(places).alias("place")).hint("merge"), "rep")
    compare, found = tidy_group(_compare(threshold, k)), "a long, b long, wide boolean"
    first = materialize(near.groupBy("cluster", "place").applyInArrow(compare, found))
    settled = first.where("not wide").select(F.col("b").alias("node"), F.col("a").alias("component"))
    wide = cut.where("blocks > 2")
    if wide.isEmpty():
        return settled

    named = components(first.where("wide")).withColumnsRenamed({"node": "rep", "component": "label"})
    labels = materialize(wide.join(named, "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    most = labels.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("common"))
    apart = materialize(_blocks(labels.join(most, "cluster").where("label <> common").select("cluster", "rep", "n", "label", "blocks", "own"), "parts"))
    every = labels.join(apart.select("cluster", "parts").distinct(), "cluster")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    some = apart.select("cluster", "rep", "label", number("parts").alias("part"), each("blocks").alias("own"), F.lit(True).alias("apart"))
    dealt = every.select("cluster", "rep", "label", each("parts").alias("part"), "own", F.lit(False).alias("apart")).union(some)
    dealt = dealt.groupBy("cluster", "part", "own", "rep", "label").agg(F.max("apart").alias("apart"))  # a class that is on both sides once
    far = sets.select("rep", "shingles").join(dealt.hint("merge"), "rep")
    second = components(far.groupBy("cluster", "part", "own").applyInArrow(compare, found)).withColumnRenamed("node", "label")
    joined = labels.join(second, "label", "left").select(F.col("rep").alias("node"), F.coalesce("component", "label").alias("component"))
    return settled.union(joined)


def near_duplicates(docs: DataFrame, threshold: Fraction = Fraction(4, 5), shingle: int = 5, k: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document.

    Documents whose sets have an intersection of at least threshold times their union are linked; a component is named
    after its smallest doc_id, and that document is kept.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketches = materialize(docs.mapInArrow(tidy(_sketch(shingle, k)), "doc_id long, n_shingles long, key1 long, key2 long, sketch binary"))
    classes = sketches.where("n_shingles > 0").groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    known = classes.where("rep is not null").select("rep", "n", "sketch")
    buckets = ex.buckets_for(docs)
    lists = materialize(known.mapInArrow(tidy(_lists(threshold, buckets)), "bucket long, keys binary, owners binary"))
    over = lists.where("bucket >= 0").groupBy("bucket").applyInArrow(tidy_group(_overlaps), "a long, b long")
    links = over.union(lists.where("bucket < 0").mapInArrow(tidy(_local_links), "a long, b long")).distinct()
    clusters = components(links).select(F.col("component").alias("cluster"), F.col("node").alias("rep"))
    texts = docs.join(clusters.hint("merge"), docs["doc_id"] == clusters["rep"]).select("cluster", "rep", "text")
    sets = texts.mapInArrow(tidy(_sets(shingle)), "cluster long, rep long, n long, shingles binary")
    sets = materialize(sets.withColumn("key", F.xxhash64("rep", "shingles")))
    near = links_within(sets, promising(sets, threshold, buckets), threshold, k)
    named = classes.select("key1", "key2", "rep").join(near.withColumnRenamed("node", "rep"), "rep", "left").select("key1", "key2", F.coalesce("component", "rep").alias("component"))
    # rows meet their class in parts, so the copies of one text do not meet in one task
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sketches.select("doc_id", "n_shingles", "key1", "key2", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"))
    named = rows.select("key1", "key2", "part").distinct().join(named, ["key1", "key2"])
    found = rows.join(named, ["key1", "key2", "part"], "left")
    whole = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", whole.alias("component_id"), F.col("doc_id").eqNullSafe(whole).alias("kept"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each component: the rows whose doc_id names it, with all their columns."""
    gone = near_duplicates(docs, **options).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
