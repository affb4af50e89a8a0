"""Benchmark decontamination by winnowing.

Every document keeps the smallest k-gram hash of each sliding window of k-grams;
k and the window are chosen so that any shared run of ``span`` words shares a
kept fingerprint.  Fingerprints that also occur in the benchmark are hits; each
hit is extended to the full windows of ``span`` words around it and those are
compared word by word with the items.

A benchmark of up to ``block_bytes`` travels to the executors whole, and the
documents are read once.  Of a larger one all fingerprints are joined with the
documents' first, by a bit map of fixed size: documents without a hit are done,
and only the others meet the benchmark, block by block.  No text is shuffled,
so hot documents, sources or passages cannot gather in one task.  Equal windows
of the benchmark are one entry with the set of their items, so a window that
many items share costs one comparison a place.

Defined results: null or empty texts have no words and are never hit; very long
texts are worked on whole; an item without words has no window; items of fewer
than ``span`` words are one window of their own length; rows of one ``item_id``
count as one item; rows whose ``item_id`` is null mark words but are not
listed; repeated document rows are judged one by one; without documents the
result is empty, without a benchmark nothing is hit.  Columns beside the named
ones are ignored, whatever their names; ``without_contaminated`` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from variorum.llm._grams import ALNUM_LOWER, Words, chunks, column_bytes, grams, mix, words
from variorum.llm._shared import discard, materialize, tidy, tidy_group

#: Bytes of benchmark text that one block, hence one broadcast, may hold.
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 20
#: Bits of the map of a larger benchmark's fingerprints: 16 MB, whatever its size.
_MAP_BITS = 27
_STATE = StructType().add("n_words", "long").add("n_hit", "long").add("hits", "binary").add("items", ArrayType(StringType()))


def _runs(h: np.ndarray) -> np.ndarray:
    """Whether each of sorted values is the first of its kind."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return new


def _item_windows(w: Words, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Window size, hashes and positions of the windows of items: those of span words, or a shorter item as a whole."""
    sizes = np.diff(w.first)
    for size in sorted({int(min(n, span)) for n in sizes if n}):
        h, inside = grams(w, size)
        at = np.flatnonzero(inside & (np.minimum(sizes[w.row()[: len(h)]], span) == size))
        yield size, h[at], at


class Index:
    """Fingerprints and distinct windows of one block of items, and the sets of items that windows stand in."""

    def __init__(self, items: list[tuple[str | None, str | None]], span: int, k: int):
        self.span, self.k = span, k
        names = sorted({label for label, _ in items if label is not None})
        number = {label: i for i, label in enumerate(names)} | {None: -1}
        labels = np.array([number[label] for label, _ in items], np.int64)
        self.sets: list[list[str]] = [[n] for n in names] + [[]]
        known: dict[bytes, int] = {}
        data, offsets = column_bytes(pa.array([text for _, text in items], pa.string()))
        w = words(data, offsets, ALNUM_LOWER)
        self.words = w.hashes
        row = w.row()
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.prints = np.zeros(0, np.uint64)
        for size, h, at in _item_windows(w, span):
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            new = _runs(h)
            first = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
            for j in range(size):  # equal hashes of other words make windows of their own
                new |= self.words[at + j] != self.words[first + j]
            number_of = np.cumsum(new) - 1
            owned = np.unique(np.stack([number_of, labels[row[at]]], 1), axis=0)
            owned = owned[owned[:, 1] >= 0]
            cut = np.searchsorted(owned[:, 0], np.arange(number_of[-1] + 2))
            held = np.full(number_of[-1] + 1, len(names))
            one = np.flatnonzero(np.diff(cut) == 1)
            held[one] = owned[cut[one], 1]
            for i in np.flatnonzero(np.diff(cut) > 1).tolist():
                own = owned[cut[i] : cut[i + 1], 1]
                held[i] = known.setdefault(own.tobytes(), len(self.sets))
                if held[i] == len(self.sets):
                    self.sets.append([names[x] for x in own.tolist()])
            self.windows[size] = (h[new], at[new], held)
            if size == span:
                self.prints = np.unique(grams(w, k)[0][winnowed(w, span, k)])
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.prints >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, w: Words) -> Iterator[tuple[int, np.ndarray]]:
        """Window size and positions where a window may start."""
        for size in self.windows:
            if size < self.span:
                yield size, np.flatnonzero(grams(w, size)[1])
                continue
            h = grams(w, self.k)[0]
            at = np.flatnonzero(self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            at = at[winnowed(w, self.span, self.k, at)]
            at = at[np.isin(h[at], self.prints)]
            reach = self.span - self.k
            near = np.unique((at[:, None] - np.arange(reach + 1)).ravel())
            inside = grams(w, size)[1]
            near = near[(near >= 0) & (near < len(inside))]
            yield size, near[inside[near]]

    def hits(self, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Window size, positions of occurrences and the set of items of the window there."""
        for size, at in self.candidates(w):
            keys, places, held = self.windows[size]
            h = grams(w, size)[0][at] if len(at) else np.zeros(0, np.uint64)
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            n = hi - lo  # 1 at most, but where hashes of different windows are equal
            which = np.repeat(np.arange(len(at)), n)
            entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            same = np.ones(len(which), bool)
            for j in range(size):
                same &= w.hashes[at[which] + j] == self.words[places[entry] + j]
            yield size, at[which[same]], held[entry[same]]


def winnowed(w: Words, span: int, k: int, only: np.ndarray | None = None) -> np.ndarray:
    """Whether each k-gram is smallest in some window of span words of its row (at ``only``, if given)."""
    h = grams(w, k)[0]
    inside = grams(w, span)[1]
    kept = np.zeros(len(h), bool)
    if len(inside):
        n, reach = len(inside), span - k + 1
        low = h[:n].copy()
        for j in range(1, reach):
            np.minimum(low, h[j : j + n], out=low)
        low[~inside] = 0  # no window starts here; a hash of zero would only add a candidate
        for j in range(reach):
            kept[j : j + n] |= h[j : j + n] == low
    return kept if only is None else kept[only]


def _mark(index: Broadcast, state: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for batch in batches:
            data, offsets = column_bytes(batch["text"])
            before = batch["hits"].to_pylist() if state else None
            found = [set(x) for x in batch["items"].to_pylist()] if state else [set() for _ in range(batch.num_rows)]
            counts, hits, spans = [], [], []
            for lo, hi in chunks(offsets):
                w = words(data, offsets[lo : hi + 1], ALNUM_LOWER)
                edge = np.zeros(len(w) + 1, np.int32)
                row = w.row()
                for size, at, held in ix.hits(w):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + size, -1)
                    for d, i in np.unique(np.stack([row[at], held], 1), axis=0).tolist():
                        found[lo + d].update(ix.sets[i])
                hit = np.cumsum(edge[:-1]) > 0
                for d in range(hi - lo):
                    own = hit[w.first[d] : w.first[d + 1]]
                    if state and before[lo + d]:
                        own = own | np.unpackbits(np.frombuffer(before[lo + d], np.uint8), count=len(own)).astype(bool)
                    n = int(np.count_nonzero(own))
                    counts.append(len(own))
                    hits.append(n)
                    spans.append(np.packbits(own).tobytes() if n else b"")
            made = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(spans, pa.binary()), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["doc_id", "text", *_STATE.names])

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    """Distinct items (label, text)."""
    return benchmark.select(F.col("item_id").cast("string").alias("label"), "text").where(F.col("text").isNotNull()).distinct()


def _bits(h: np.ndarray, size: int) -> np.ndarray:
    """Places of the bit map for fingerprints of windows of a size."""
    return (mix(h ^ np.uint64(size)) >> np.uint64(64 - _MAP_BITS)).astype(np.int64)


def _map_parts(span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch["text"])
            for lo, hi in chunks(offsets):
                w = words(data, offsets[lo : hi + 1], ALNUM_LOWER)
                parts = [(size, grams(w, k)[0][winnowed(w, span, k)] if size == span else h) for size, h, _ in _item_windows(w, span)]
                bits = np.unique(np.concatenate([np.zeros(0, np.int64), *(_bits(h, size) for size, h in parts)]))
                part, place = bits >> 16, (bits & 0xFFFF).astype(np.uint16)
                cut = np.flatnonzero(np.append(_runs(part), True)) if len(part) else []
                sizes = sorted(size for size, _ in parts)
                own = [(int(part[a]), place[a:b].tobytes(), sizes) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                cols = list(zip(*own, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["part", "bits", "sizes"])

    return run


def _map_part(table: pa.Table) -> pa.Table:
    held = np.zeros(1 << 16, bool)
    for x in table["bits"].to_pylist():
        held[np.frombuffer(x, np.uint16)] = True
    sizes = sorted({s for x in table["sizes"].to_pylist() for s in x})
    return pa.table({"part": table["part"].slice(0, 1), "bits": pa.array([np.packbits(held).tobytes()], pa.binary()), "sizes": pa.array([sizes], pa.list_(pa.int64()))})


def _screen(bit_map: Broadcast, span: int, k: int, hit: bool):
    """Documents with a fingerprint in the map, or, with empty results, those without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = bit_map.value
        held = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
        for batch in batches:
            data, offsets = column_bytes(batch["text"])
            counts, some = [], []
            for lo, hi in chunks(offsets):
                w = words(data, offsets[lo : hi + 1], ALNUM_LOWER)
                row, found = w.row(), np.zeros(hi - lo, bool)
                for size in sizes:
                    h, inside = grams(w, k if size == span else size)
                    at = np.flatnonzero(winnowed(w, span, k) if size == span else inside)
                    found[row[at[held[_bits(h[at], size)]]]] = True
                counts += np.diff(w.first).tolist()
                some += found.tolist()
            keep = pa.array(np.array(some, bool) == hit)
            none = [pa.array([0] * len(some), pa.int64()), pa.array([b""] * len(some), pa.binary()), pa.array([[]] * len(some), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (*batch.columns[:2], pa.array(counts, pa.int64()), *none)], names=["doc_id", "text", *_STATE.names])

    return run


def mark(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents (doc_id, text) with n_words, n_hit, hits (packed bits, one for each word; empty if none) and items.

    ``block_bytes`` bounds what is sent to every executor at once.
    """
    if not 0 < k <= span:
        raise ValueError("k must lie between 1 and span")
    context = docs.sparkSession.sparkContext
    out = docs.select("doc_id", "text")
    schema = StructType([*out.schema.fields, *_STATE.fields])
    items = _items(benchmark)
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // block_bytes) or 1

    def index(block: DataFrame) -> Broadcast:
        rows = block.sort("label", "text").collect()  # about block_bytes
        return context.broadcast(Index([(r.label, r.text) for r in rows], span, k))

    if n == 1:
        return out.mapInArrow(tidy(_mark(index(items), False)), schema)
    items = materialize(items)
    parts = items.select("text").mapInArrow(tidy(_map_parts(span, k)), "part long, bits binary, sizes array<long>")
    parts = parts.groupBy("part").applyInArrow(tidy_group(_map_part), "part long, bits binary, sizes array<long>").collect()  # 2 ** _MAP_BITS bits at most
    whole = bytearray(1 << (_MAP_BITS - 3))
    for r in parts:
        whole[r.part << 13 : (r.part + 1) << 13] = r.bits
    bit_map = context.broadcast((bytes(whole), sorted({s for r in parts for s in r.sizes})))
    clean = out.mapInArrow(tidy(_screen(bit_map, span, k, False)), schema)
    left = materialize(out.mapInArrow(tidy(_screen(bit_map, span, k, True)), schema))
    for b in range(n):  # one block at a time is on the executors
        block = index(items.where(F.pmod(F.xxhash64("label", "text"), F.lit(n)) == b))
        before, left = left, materialize(left.mapInArrow(tidy(_mark(block, True)), schema))
        discard(before)
        block.destroy()
    return clean.union(left)


def digest(marked: DataFrame) -> DataFrame:
    """Counts and digests of what ``mark`` found."""
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that share no window with the benchmark, with all their columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), F.col("text"))
    return mark(whole, benchmark, **options).where("n_hit = 0").select("doc_id.*")
