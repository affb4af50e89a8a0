"""Substring deduplication with fixed-block anchors.

A window is ``span`` consecutive words of one document.  The words of every
document are cut into reference blocks of ``(span + 1) // 2`` words that do not
overlap; any window holds a whole block of its own document.  The blocks are
the index; every rolling window of a block's length, at every word of every
document, is a probe.  A probe whose block occurs in several places is a hit.
Hits are extended: the windows of ``span`` words around them are compared by
hash, and windows that start in several places overlap to the maximal exact
repeats, whose words go.

Both steps use the packed exchange of ``_exchange``, so the index is never
gathered and a passage that every document shares costs one entry a chunk.

Windows are compared by 64-bit hashes: of n windows near hits, some n * n / 2**65
pairs would be taken for equal without being so, none below about 10**9.

Defined results: windows are judged on the input, in all places at once, so
every copy of a repeat goes; null and empty texts have no words; texts shorter
than ``span`` words are left whole; very long texts are worked on whole, as one
chunk; repeated rows, with equal doc_id and text, share their marks, and each
counts as a place of its own; no order decides anything, so there are no ties;
an empty table gives an empty one.  Other columns pass through, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from variorum.llm import _exchange as ex
from variorum.llm._grams import SPACED, chunks, column_bytes, grams, join_words, words
from variorum.llm._shared import materialize, tidy

#: Probes are located to so many words; a hit is extended from all of them.
_GRAIN = 8
_KEYS = ["key1", "key2"]


def _probes(block: int):
    def make(batch: pa.RecordBatch) -> Iterator[ex.Chunk]:
        data, offsets = column_bytes(batch["text"])
        key1, key2 = batch["key1"].to_numpy(), batch["key2"].to_numpy()
        for lo, hi in chunks(offsets):
            w = words(data, offsets[lo : hi + 1], SPACED)
            h, inside = grams(w, block)
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            row = w.row()[at]
            local = at - w.first[row]
            sizes = -(-np.diff(w.first) // _GRAIN)
            base = np.cumsum(sizes) - sizes
            yield ex.Chunk(h[at], base[row] + local // _GRAIN, h[at[local % block == 0]], sizes, key1[lo:hi], key2[lo:hi])

    return make


def _windows(span: int, block: int):
    def make(batch: pa.RecordBatch) -> Iterator[ex.Chunk]:
        data, offsets = column_bytes(batch["text"])
        key1, key2 = batch["key1"].to_numpy(), batch["key2"].to_numpy()
        marks = batch["marks"].to_pylist()
        for lo, hi in chunks(offsets):
            w = words(data, offsets[lo : hi + 1], SPACED)
            h, inside = grams(w, span)
            near = np.zeros(len(w) + 1, np.int32)
            for d in range(hi - lo):
                bits = np.flatnonzero(np.unpackbits(np.frombuffer(marks[lo + d], np.uint8)))
                first, last = w.first[d], w.first[d + 1]
                opens = np.maximum(first, first + bits * _GRAIN - (span - block))
                closes = np.minimum(last, first + (bits + 1) * _GRAIN)
                np.add.at(near, opens, 1)
                np.add.at(near, np.maximum(opens, closes), -1)
            at = np.flatnonzero(inside & (np.cumsum(near)[: len(inside)] > 0)) if len(inside) else np.zeros(0, np.int64)
            if len(at):
                yield ex.Chunk(h[at], at, None, np.diff(w.first), key1[lo:hi], key2[lo:hi])

    return make


def _cut(span: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch["text"])
            marks = batch["marks"].to_pylist()
            counts, gone, out = [], [], []
            for lo, hi in chunks(offsets):
                w = words(data, offsets[lo : hi + 1], SPACED)
                edge = np.zeros(len(w) + 1, np.int32)
                for d in range(hi - lo):
                    if marks[lo + d]:
                        at = w.first[d] + np.flatnonzero(np.unpackbits(np.frombuffer(marks[lo + d], np.uint8)))
                        edge[at] += 1
                        edge[at + span] -= 1
                kept = np.cumsum(edge[:-1]) == 0
                text = data[offsets[lo] : offsets[hi]].tobytes()
                for d in range(hi - lo):
                    own = slice(w.first[d], w.first[d + 1])
                    n = own.stop - own.start
                    stay = kept[own]
                    left = int(np.count_nonzero(stay))
                    counts.append(n)
                    gone.append(n - left)
                    if texts and left == n:
                        out.append(None)
                        continue
                    joined = join_words(text, w.starts[own][stay], w.ends[own][stay])
                    out.append(joined.decode() if texts else hashlib.sha256(joined).hexdigest())
            made = [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([batch["row"], *([batch["text"]] if texts else []), *made], names=["row", *(["text"] if texts else []), "n_words", "n_removed", "made"])

    return run


def _repeats(docs: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Documents as (row, text, key1, key2), and (key1, key2, marks) with a bit for each start of a repeated window."""
    if span < 2:
        raise ValueError("span must be at least 2")
    block = (span + 1) // 2
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*columns).alias("row"), "text", F.xxhash64("doc_id").alias("key1"), F.xxhash64("text", "doc_id").alias("key2"))
    n = ex.buckets_for(docs)
    hits = materialize(ex.repeated(keyed.drop("row").mapInArrow(tidy(ex.pack(_probes(block), n, False)), ex.PACKED), False, True).dropDuplicates(_KEYS))
    # with row, so that _applied can use the same shuffle of the texts; sorted, so that a repeated task makes the same chunks
    near = keyed.join(hits, _KEYS).sortWithinPartitions(*_KEYS)
    return keyed, ex.repeated(near.mapInArrow(tidy(ex.pack(_windows(span, block), n, True)), ex.PACKED), True, False).dropDuplicates(_KEYS)


def _applied(docs: DataFrame, span: int, texts: bool) -> DataFrame:
    keyed, marks = _repeats(docs, span)
    both = keyed.join(marks, _KEYS, "left").select("row", "text", "marks")
    schema = StructType([keyed.schema["row"], *([keyed.schema["text"]] if texts else [])])
    schema = schema.add("n_words", "long").add("n_removed", "long").add("made", "string")
    return both.mapInArrow(tidy(_cut(span, texts)), schema)


def digest(docs: DataFrame, span: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    return _applied(docs.select("doc_id", "text"), span, False).select("row.doc_id", "n_words", "n_removed", F.col("made").alias("kept_sha256"))


def without_repeats(docs: DataFrame, span: int = 35) -> DataFrame:
    """docs without the words of repeated windows; a text that loses nothing stays byte for byte.

    A document that loses words has the others joined by one space, and n_chars follows the text where there is one.
    """
    cut = _applied(docs, span, True)
    text = F.coalesce("made", "text")
    own = {"text": text} | ({"n_chars": F.when(F.col("made").isNull(), F.col("row.n_chars")).otherwise(F.char_length("made")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return cut.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
