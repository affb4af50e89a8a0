"""Phrase collocations: frequent phrases whose parts occur little without each other.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and
pieces into words at spaces and tabs.  Everything is counted by a key, the language.

Counts of all phrases of one to ``most`` words come in two passes.  The first
builds count-min sketches: each task adds up hashed phrases in the cells of two
rows, and sends the cells that it used, packed by ranges of cells; ranges are
merged by adding, each in a group of its own.  A cell is never below the count
of a phrase in it, so only phrases whose cells both reach the least count can be
frequent, and of these only those whose parts can be, too.  The second pass
counts just these, by their words, and exactly.

The rows have a cell for every eight bytes of the corpus, whatever its size.  What
goes to the tasks of the second pass is a bit a cell, or a bit for several
neighbouring cells where ``BITS`` would not do: then more phrases survive to the
exact counts, none is lost.

Defined results: null and empty texts have no words; a null key counts as
``und``; very long texts are counted whole, cut between pieces; repeated rows
count again; phrases that tie are ranked as ``ranked`` states; an empty table
gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variorum.llm._exchange import buckets_for, planes, unplanes
from variorum.llm._grams import U64, Alphabet, Words, chunks, column_bytes, grams, mix, words
from variorum.llm._shared import materialize, tidy, tidy_group

ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
ALPHABET = Alphabet.of(ENDS + SPACES, lower=True)
#: Rows of a sketch, bits of each row that go to the tasks, and bytes of text that are worked on together.
ROWS, BITS, TEXT_BYTES = 2, 1 << 28, 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = np.isin(np.arange(256), list(ENDS))


@dataclass
class Chunk:
    """Words of some texts, each with the number of its piece and of its key."""

    text: np.ndarray
    w: Words
    piece: np.ndarray
    key: np.ndarray
    keys: pa.Array

    def inside(self, size: int) -> np.ndarray:
        """Whether the size words from each position are of one piece."""
        n = len(self.w) - size + 1
        return self.piece[size - 1 :] == self.piece[:n] if n > 0 else np.zeros(0, bool)

    def hashes(self, size: int) -> np.ndarray:
        salts = np.array([int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "little") for k in self.keys.to_pylist()], U64)
        h = self.w.hashes if size == 1 else grams(self.w, size)[0]
        return mix(h + salts[self.key[: len(h)]] + U64(size))

    def spelt(self) -> pa.Array:
        """The words, lower-cased."""
        n = self.w.ends - self.w.starts
        cut = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        kept = _LOWER[self.text[ALPHABET.member[self.text]]]
        return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(cut), pa.py_buffer(kept)])


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """offsets with long rows cut after the end of a piece, and the row that each part is of."""
    at, row = [offsets[:1]], []
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        own = []
        while b - a > 2 * TEXT_BYTES:
            ends = np.flatnonzero(_END[data[a + TEXT_BYTES : b]][: 16 * TEXT_BYTES])
            if not len(ends):
                break
            a += TEXT_BYTES + int(ends[0]) + 1
            own.append(a)
        at.append(np.array([*own, b], np.int64))
        row += [i] * (len(own) + 1)
    return np.concatenate(at), np.array(row, np.int64)


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        data, offsets = column_bytes(batch["text"])
        if np.diff(offsets).max(initial=0) > 2 * TEXT_BYTES:
            offsets, row = _cut(data, offsets)
        else:
            row = np.arange(batch.num_rows)
        key = batch["key"].dictionary_encode()
        number = np.array(key.indices, np.int64)[row]
        for lo, hi in chunks(offsets, TEXT_BYTES):
            at = offsets[lo : hi + 1]
            w = words(data, at, ALPHABET)
            if len(w):
                text = data[at[0] : at[-1]]
                owner = w.row()
                piece = np.cumsum(_END[text])[w.starts] + owner  # both only rise, so neither can hide the other
                yield Chunk(text, w, piece, number[lo:hi][owner], key.dictionary)


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cells of hashes in a row of 2**bits."""
    return (mix(h ^ U64(0x9E3779B97F4A7C15 * row & (1 << 64) - 1)) if row else h) >> U64(64 - bits)


def _sketched(most: int, bits: int, buckets: int):
    """Rows (slot, cells, counts): the used cells of a chunk by ranges, the first rows' before the second's."""
    low = bits - (buckets.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _prepared(batches):
            found = np.concatenate([c.hashes(n)[c.inside(n)] for n in range(1, most + 1)])
            for row in range(ROWS):
                cells = np.sort(_cells(found, row, bits))
                first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                counts = np.minimum(np.diff(np.append(first, len(cells))), 255).astype(np.uint8)
                cells = cells[first]
                cut = np.searchsorted((cells >> U64(low)).astype(np.int64), np.arange(buckets + 1))
                own = (cells & U64((1 << low) - 1)).astype(np.int64)
                out = []
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    part = slice(cut[b], cut[b + 1])
                    out.append((row * buckets + b, planes(np.diff(own[part], prepend=0).astype(np.uint32)), counts[part].tobytes()))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["slot", "cells", "counts"])

    return run


def _merged(low: int, least: int, fold: int):
    """(slot, marks): a bit for every 2**fold cells of a range, set where one of them reaches the least count."""

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << low, np.uint32)
        for cells, counts in zip(table["cells"], table["counts"], strict=True):
            # a count of 255 stands for more, and reaches the least alone
            at = np.cumsum(unplanes(cells.as_py(), np.uint32), dtype=np.int64)
            total[at] = np.minimum(total[at] + np.frombuffer(counts.as_py(), np.uint8), 1 << 30)
        reached = (total >= min(least, 255)).reshape(-1, 1 << fold).any(1)
        return pa.table({"slot": table["slot"][:1], "marks": pa.array([np.packbits(reached, bitorder="little").tobytes()], pa.binary())})

    return run


@dataclass
class Sketch:
    """The merged sketch, as far as the second pass needs it: which cells reach the least count."""

    bits: int
    fold: int
    marks: list[np.ndarray]

    def may(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for row, marks in enumerate(self.marks):
            at = _cells(h, row, self.bits) >> U64(self.fold)
            found &= (marks[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
        return found


def sketch(docs: DataFrame, most: int, least: int) -> Sketch:
    """Of docs (key, text): merged count-min sketches of the phrases of one to most words."""
    buckets = buckets_for(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(total.bit_length() - 3, buckets.bit_length() - 1 + 12)
    low = bits - (buckets.bit_length() - 1)
    fold = min(low - 3, max(0, bits - (BITS.bit_length() - 1)))
    sent = docs.mapInArrow(tidy(_sketched(most, bits, buckets)), "slot long, cells binary, counts binary")
    merged = sent.groupBy("slot").applyInArrow(tidy_group(_merged(low, least, fold)), "slot long, marks binary")
    size = 1 << (low - fold - 3)
    marks = [np.zeros(size * buckets, np.uint8) for _ in range(ROWS)]
    found = merged.toArrow()  # ROWS * BITS bits in all
    for slot, part in zip(found["slot"].to_pylist(), found["marks"], strict=True):
        row, b = divmod(slot, buckets)
        marks[row][b * size : (b + 1) * size] = np.frombuffer(part.as_buffer(), np.uint8)
    return Sketch(bits, fold, marks)


def _counted(most: int, sent):
    """Rows (key, phrase, size, a): exact counts of a chunk's phrases that may be frequent; size 0 counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch: Sketch = sent.value

        def rows(keys, phrases, size, counts):
            return pa.RecordBatch.from_arrays([keys, phrases.cast(pa.string()), pa.array(np.full(len(counts), size), pa.int32()), pa.array(counts, pa.int64())], names=["key", "phrase", "size", "a"])

        for c in _prepared(batches):
            every = np.bincount(c.key, minlength=len(c.keys))
            used = np.flatnonzero(every)
            yield rows(c.keys.take(pa.array(used)), pa.array([""] * len(used), pa.string()), 0, every[used])
            spelt = c.spelt()
            coded = spelt.dictionary_encode()
            name = c.key * len(coded.dictionary) + np.array(coded.indices, np.int64)
            may, one = None, None
            for size in range(1, most + 1):
                n = len(c.w) - size + 1
                if n <= 0:
                    break
                here = c.inside(size) if may is None else c.inside(size) & may[:n] & may[1 : n + 1]
                at = np.flatnonzero(here)
                at = at[sketch.may(c.hashes(size)[at])]
                # phrases are told apart by their words: a number for all but the last word, and one for that
                pair = name[at] if size == 1 else name[at] * (one.max(initial=0) + 1) + one[at + size - 1]
                _, first, number, counts = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                may = np.zeros(len(c.w), bool)
                may[at] = True
                name = np.zeros(len(c.w), np.int64)
                name[at] = number
                one = name if one is None else one
                heads = at[first]
                yield rows(c.keys.take(pa.array(c.key[heads])), pa.compute.binary_join_element_wise(*[spelt.take(pa.array(heads + j)) for j in range(size)], pa.scalar(" ", pa.large_string())), size, counts)

    return run


def frequent(docs: DataFrame, most: int = 4, least: int = 30, key: str = "lang", text: str = "text") -> DataFrame:
    """(key, phrase, size, a) of every phrase of one to most words that occurs least times; size 0 has all words of a key.

    A written table; words of a phrase are joined by one space.
    """
    own = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("und")).alias("key"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(sketch(own, most, least))  # ROWS * BITS bits at most
    found = own.mapInArrow(tidy(_counted(most, sent)), "key string, phrase string, size int, a long")
    return materialize(found.groupBy("key", "phrase", "size").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (F.col("size") == 0)))


def _exact(column: str) -> str:
    return f"cast({column} as decimal(20, 0))"


def subsumed(counts: DataFrame, share: int = 80) -> DataFrame:
    """counts of phrases of two words and more without those that a longer one explains.

    That is a phrase that holds its words next to one another and occurs share per cent as often, or more.
    """
    w = F.split("phrase", " ")
    sub = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))
    inner = counts.where("size > 2").select("key", F.explode(sub).alias("phrase"), F.col("a").alias("over"))
    longer = inner.groupBy("key", "phrase").agg(F.max("over").alias("over"))
    kept = counts.where("size > 1").join(longer, ["key", "phrase"], "left")
    return kept.where(f"over is null or {_exact('over')} * 100 < {_exact('a')} * {share}").drop("over")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """phrases with l, r and score of the cut that scores lowest, the first of those that tie.

    A cut's score is 2000000 * a / (l + r), floored: l and r count the parts before and after it.
    """
    w = F.split("phrase", " ")
    cuts = phrases.select("key", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    part = lambda i, n: F.array_join(F.slice(w, i, n), " ")
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    known = counts.where("size > 0")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("key", F.col("phrase").alias(side), F.col("a").alias(name)), ["key", side])
    score = F.expr(f"{_exact('a')} * 2000000 div ({_exact('l')} + {_exact('r')})")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("key", "phrase").agg(F.first("a").alias("a"), lowest).select("key", "phrase", "a", "best.l", "best.r", "best.score")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first of each key by score, then a, both falling, then phrase by its bytes; with rank from 1."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    # in parts first, so that no task sees more of a key than the parts' first
    part = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = part.withColumn("rank", number("key", "part")).where(F.col("rank") <= top).drop("part", "rank")
    return few.withColumn("rank", number("key")).where(F.col("rank") <= top)


def digest(docs: DataFrame, top: int = 2000, most: int = 4, least: int = 30, share: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases; n counts its words."""
    counts = frequent(docs, most, least)
    best = ranked(scored(subsumed(counts, share), counts), top)
    n = counts.where("size = 0").select("key", F.col("a").alias("n"))
    return best.join(n, "key").select(F.col("key").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
