"""Packed exchange of hashes: which hashes occur in more than one place.

A chunk is some documents of one task.  Its hashes are sorted, combined (a hash
that a chunk holds twice is settled there and sent once) and cut into buckets
by their leading bits; a row of the shuffle is one bucket of one chunk, as
packed byte planes.  So the shuffle holds a few bytes a hash, a bucket gets at
most one entry a hash and chunk however frequent a passage is, and a task holds
one bucket at a time.  Findings go back to the chunk and from there to its
documents by (key1, key2).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm._shared import tidy_group

#: Bytes of text whose hashes one bucket takes, about.
BUCKET_BYTES = 8 << 20
PACKED = "bucket long, chunk long, hashes binary, places binary, anchors binary"
MARKS = "key1 long, key2 long, marks binary"


def planes(values: np.ndarray) -> bytes:
    """Little-endian values, byte by byte: equal bytes stand together, for compression."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def buckets_for(docs: DataFrame, text: str = "text") -> int:
    """A power of two that grows with the text; at least twice the shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(total // BUCKET_BYTES, least - 1, 1).bit_length()


@dataclass
class Chunk:
    """Hashes of some documents: hash h stands at place p; size[d] places belong to document d."""

    hashes: np.ndarray
    places: np.ndarray
    anchors: np.ndarray | None
    sizes: np.ndarray
    key1: np.ndarray
    key2: np.ndarray


def pack(make: Callable[[pa.RecordBatch], Iterator[Chunk]], buckets: int, wide: bool):
    """For mapInArrow: rows of PACKED.  wide sends whole hashes, else the 32 bits after the bucket's.

    A bucket below 0 is the directory of a chunk: its documents, and the places settled within it.
    """
    bits = buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for c in make(batch):
                chunk = (task << 32) | seq
                seq += 1
                order = np.argsort(c.hashes, kind="stable")
                h, p = c.hashes[order], c.places[order]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                twice = np.zeros(len(h), bool)
                twice[1:] = ~new[1:]
                twice[:-1] |= ~new[1:]
                own = np.zeros(int(c.sizes.sum()), bool)
                own[p[twice]] = True
                directory = planes(np.stack([c.key1, c.key2, c.sizes.astype(np.int64)], 1).ravel())
                rows = [(-1 - chunk % buckets, chunk, directory, np.packbits(own).tobytes(), b"")]
                h, p = h[new], p[new].astype(np.uint32)
                cut = np.searchsorted((h >> np.uint64(64 - bits)).astype(np.int64), np.arange(buckets + 1))
                a = acut = None
                if c.anchors is not None:
                    a = np.unique(c.anchors)
                    acut = np.searchsorted((a >> np.uint64(64 - bits)).astype(np.int64), np.arange(buckets + 1))
                short = lambda x: x if wide else ((x << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    s = slice(cut[b], cut[b + 1])
                    rows.append((b, chunk, planes(short(h[s])), planes(p[s]), planes(short(a[acut[b] : acut[b + 1]])) if a is not None else b""))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(x, pa.binary()) for x in cols[2:])], names=["bucket", "chunk", "hashes", "places", "anchors"])

    return run


def _meet(wide: bool, anchored: bool):
    """A bucket's hashes of all chunks: the places of those that occur in several (and are anchors of one)."""
    kind = np.uint64 if wide else np.uint32

    def run(table: pa.Table) -> pa.Table:
        chunk = table["chunk"].to_numpy()
        if table["bucket"][0].as_py() < 0:
            return pa.table({"chunk": table["chunk"], "directory": table["hashes"], "places": table["places"]})
        parts = [unplanes(x, kind) for x in table["hashes"].to_pylist()]
        sizes = [len(x) for x in parts]
        h = np.concatenate(parts)
        p = np.concatenate([unplanes(x, np.uint32) for x in table["places"].to_pylist()])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(h, kind="stable")
        s = h[order]
        many = np.zeros(len(s), bool)
        many[1:] = s[1:] == s[:-1]
        many[:-1] |= many[1:]
        at = order[many]
        if anchored and len(at):
            a = np.unique(np.concatenate([unplanes(x, kind) for x in table["anchors"].to_pylist()]))
            at = at[np.isin(h[at], a)]
        at = np.sort(at)
        cut = np.searchsorted(owner[at], np.arange(len(sizes) + 1))
        some = [i for i in range(len(sizes)) if cut[i] < cut[i + 1]]
        return pa.table({"chunk": pa.array(chunk[some], pa.int64()), "directory": pa.nulls(len(some), pa.binary()), "places": pa.array([planes(p[at[cut[i] : cut[i + 1]]]) for i in some], pa.binary())})

    return run


def _home(table: pa.Table) -> pa.Table:
    """A chunk's findings, dealt to its documents: packed bits, a bit a place."""
    keys = marks = None
    found = []
    for directory, places in zip(table["directory"].to_pylist(), table["places"].to_pylist(), strict=True):
        if directory is None:
            found.append(unplanes(places, np.uint32))
        else:
            keys = unplanes(directory, np.int64).reshape(-1, 3)
            marks = np.unpackbits(np.frombuffer(places, np.uint8), count=int(keys[:, 2].sum())).astype(bool)
    for x in found:
        marks[x] = True
    out, at = [], 0
    for key1, key2, size in keys.tolist():
        own = marks[at : at + size]
        at += size
        if own.any():
            out.append((key1, key2, np.packbits(own).tobytes()))
    cols = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table({"key1": pa.array(cols[0], pa.int64()), "key2": pa.array(cols[1], pa.int64()), "marks": pa.array(cols[2], pa.binary())})


def repeated(packed: DataFrame, wide: bool, anchored: bool) -> DataFrame:
    """(key1, key2, marks) of each document with a place whose hash occurs in another place too."""
    met = packed.groupBy("bucket").applyInArrow(tidy_group(_meet(wide, anchored)), "chunk long, directory binary, places binary")
    return met.groupBy("chunk").applyInArrow(tidy_group(_home), MARKS)
