"""Byte-level BPE: encoding and decoding by the ranks of a public vocabulary.

Texts are cut into words by the vocabulary's pattern.  A fold over the byte
pieces of each distinct word merges the leftmost pair of lowest rank until no
pair has one; a word that is a piece of the vocabulary has that one id.
Documents then take the ids of their words; decoding concatenates the pieces
of the ids.

The fold runs over all distinct words of ``GROUP_BYTES`` of text at once, as
arrays.  ``encode_words`` is the same fold in Spark's higher-order functions
with a literal rank map; it needs about 45 microseconds a word, twice what the
CPU budget of whole corpora leaves, so documents take the arrays.

Everything is one narrow stage: no shuffle, no table of words that would grow
with the corpus.

Defined results: null counts as empty and has no ids, but null ids decode to
null; special tokens have no meaning; very long texts are encoded whole, and
their longest words by a heap; of pairs that tie in rank the leftmost merges;
equal rows are encoded one by one; an empty table gives an empty one; other
columns pass through, whatever their names, but ``encode`` replaces a column ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from variorum.llm._shared import tidy

#: Bytes of text whose distinct words are encoded together, about.
GROUP_BYTES = 4 << 20
#: Bytes that a vocabulary file may have: it is sent to every executor.
VOCABULARY_BYTES = 32 << 20
_SLOTS, _FACTOR = 65537, 7919
_NONE = 2**31 - 1
#: Bytes from which a word is folded by itself.
_LONG = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a vocabulary file, a base64 piece and its rank a line."""
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in data.splitlines() if line.strip())}


class RankMap:
    """The literal map: pairs of adjacent pieces, by their ranks, to the rank of what they merge to.

    It is an array of slots, each with the few pairs whose hash falls there.
    """

    def __init__(self, ranks: dict[bytes, int]):
        slots: list[dict[str, list[int]]] = [{"k": [], "v": []} for _ in range(_SLOTS)]
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
                if a is not None and b is not None:
                    slot = slots[(a * _FACTOR + b) % _SLOTS]
                    slot["k"].append(a << 32 | b)
                    slot["v"].append(rank)
        self.slots = F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<struct<k:array<bigint>,v:array<bigint>>>")
        self.bytes = F.array(*[F.lit(ranks[bytes([b])]).cast("bigint") for b in range(256)])

    def rank(self, a: Column, b: Column) -> Column:
        """The rank of the merged pair; null if it has none or there is no b."""
        slot = F.get(self.slots, ((a * _FACTOR + b) % _SLOTS).cast("int"))
        return F.get(slot["v"], (F.array_position(slot["k"], a * 2**32 + b) - 1).cast("int"))

    def encode(self, word: Column) -> Column:
        """Ids of a word, given as an array of its bytes."""
        let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))

        def merge(pieces: Column, _: Column) -> Column:
            ranks = F.zip_with(pieces, F.slice(pieces, F.lit(2), F.size(pieces)), self.rank)
            at = lambda r: F.array_position(r, F.array_min(r)).cast("int")
            merged = lambda r, i: F.concat(F.slice(pieces, F.lit(1), i - 1), F.array(F.get(r, i - 1)), F.slice(pieces, i + 2, F.size(pieces)))
            return let(ranks, lambda r: let(at(r), lambda i: F.when(i > 0, merged(r, i)).otherwise(pieces)))

        return F.aggregate(F.slice(word, F.lit(2), F.size(word)), F.transform(word, lambda b: F.get(self.bytes, b)), merge)


def encode_words(words: DataFrame, column: str, path: str) -> DataFrame:
    """words with a last column ids, by higher-order functions; column holds single words of a pattern."""
    ranks = read_ranks(path)
    n = F.octet_length(column)
    codes = F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.hex(F.substring(F.col(column).cast("binary"), i, F.lit(1))), 16, 10).cast("int"))
    return words.withColumn("ids", F.when(n > 0, RankMap(ranks).encode(codes)).otherwise(F.array().cast("array<bigint>")))


class Merges:
    """Ranks of adjacent pieces in an open hash table, and the fold over words by it."""

    BITS = 20

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.table = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.table[rank] = piece
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a, b, r) for piece, r in ranks.items() for i in range(1, len(piece)) if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None]
        a, b, r = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        self.keys, self.values = np.full(1 << self.BITS, -1), np.full(1 << self.BITS, _NONE, np.int32)
        left, at = np.arange(len(a)), self._at(a, b)
        while len(left):  # each round, the first that wants a free slot takes it
            free = self.keys[at[left]] < 0
            slot, who = np.unique(at[left[free]], return_index=True)
            taken = left[free][who]
            self.keys[slot], self.values[slot] = a[taken] << 32 | b[taken], r[taken]
            left = left[~np.isin(left, taken)]
            at[left] = (at[left] + 1) & ((1 << self.BITS) - 1)

    def _at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 ^ b * 0x85EBCA77) * 0x2545F491 >> 13) & ((1 << self.BITS) - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merged pairs, or _NONE."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        key, at = a << 32 | b, self._at(a, b)
        found = np.full(a.shape, _NONE, np.int32)
        left = np.flatnonzero(np.ones(a.size, bool))
        key, at, flat = key.ravel(), at.ravel(), found.ravel()
        while len(left):
            here = self.keys[at[left]]
            hit = here == key[left]
            flat[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (here >= 0)]
            at[left] = (at[left] + 1) & ((1 << self.BITS) - 1)
        return flat.reshape(a.shape)

    def fold(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        lengths = np.array([len(w) for w in words], np.int64)
        sizes = np.zeros(len(words), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            if n > _LONG:
                for i in at.tolist():
                    ids = self._fold_long(words[i])
                    sizes[i] = len(ids)
                    done.append((np.array([i]), ids[None]))
                continue
            for i in range(0, len(at), 1 << 15):
                part = at[i : i + (1 << 15)]
                for rows, ids in self._fold_equal(self.bytes[np.frombuffer(b"".join([words[j] for j in part.tolist()]), np.uint8).reshape(-1, n)]):
                    sizes[part[rows]] = ids.shape[1]
                    done.append((part[rows], ids))
        first = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.uint32)
        for rows, ids in done:
            flat[first[rows][:, None] + np.arange(ids.shape[1])] = ids
        return flat, sizes

    def _fold_equal(self, pieces: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and ids of words with equally many pieces, as they come to an end."""
        rows = np.arange(len(pieces))
        ranks = np.full(pieces.shape, _NONE, np.int32)
        ranks[:, :-1] = self.rank(pieces[:, :-1], pieces[:, 1:])
        while len(rows):
            best = ranks.argmin(1)
            low = ranks[np.arange(len(rows)), best]
            over = low == _NONE
            if over.any():
                yield rows[over], pieces[over]
                rows, pieces, ranks, best, low = rows[~over], pieces[~over], ranks[~over], best[~over], low[~over]
                if not len(rows):
                    return
            every = np.arange(len(rows))
            keep = np.arange(pieces.shape[1] - 1)
            keep = keep + (keep > best[:, None])
            pieces, ranks = np.take_along_axis(pieces, keep, 1), np.take_along_axis(ranks, keep, 1)
            pieces[every, best] = low
            n = pieces.shape[1]
            ranks[every, best] = np.where(best + 1 < n, self.rank(low, pieces[every, np.minimum(best + 1, n - 1)]), _NONE)
            inner = np.flatnonzero(best > 0)
            ranks[inner, best[inner] - 1] = self.rank(pieces[inner, best[inner] - 1], low[inner])

    def _fold_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: a heap of pairs over a linked list."""
        ids = self.bytes[np.frombuffer(word, np.uint8)]
        n = len(ids)
        heap = [(r, i) for i, r in enumerate(self.rank(ids[:-1], ids[1:]).tolist()) if r != _NONE]
        heapq.heapify(heap)
        ids, after, before = ids.tolist(), [*range(1, n), -1], [-1, *range(n - 1)]
        rank = lambda i: self.ranks.get(self.table[ids[i]] + self.table[ids[after[i]]], _NONE) if i >= 0 and after[i] >= 0 else _NONE
        now = {i: r for r, i in heap}
        while heap:
            r, i = heapq.heappop(heap)
            if now.get(i) != r:
                continue
            gone = after[i]
            ids[i], after[i] = r, after[gone]
            if after[gone] >= 0:
                before[after[gone]] = i
            now.pop(gone, None)
            for j in (i, before[i]):
                now.pop(j, None)
                if (new := rank(j)) != _NONE:
                    now[j] = new
                    heapq.heappush(heap, (new, j))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return np.array(out, np.uint32)


def _code(pattern: str, vocabulary, whole: bool):
    """Documents with their ids: as a list, or as counts and digests of the ids and of what they decode to."""

    def coded(rows: list, tokens: list[np.ndarray], words: dict[str, int], m: Merges) -> pa.RecordBatch:
        spelt = [w.encode() for w in words]
        known = np.array([m.ranks.get(w, -1) for w in spelt], np.int64)
        folded, n = m.fold([w for w, k in zip(spelt, known.tolist(), strict=True) if k < 0])
        sizes = np.ones(len(known), np.int64)
        sizes[known < 0] = n
        first = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.uint32)
        flat[np.repeat(known < 0, sizes)] = folded
        flat[first[known >= 0]] = known[known >= 0]
        listed = flat.tolist()
        text = [] if whole else [b"".join([m.table[i] for i in listed[a : a + k]]) for a, k in zip(first.tolist(), sizes.tolist(), strict=True)]
        out = []
        for t in tokens:
            k = sizes[t]
            own = flat[np.repeat(first[t] - np.cumsum(k) + k, k) + np.arange(k.sum())]
            if whole:
                out.append(own.astype(np.int32))
            else:
                out.append((len(own), hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(b"".join([text[i] for i in t.tolist()])).hexdigest()))
        if whole:
            cut = np.cumsum([0, *map(len, out)]).astype(np.int32)
            made, names = [pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(out)))], ["ids"]
        else:
            made = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(rows), *made], names=["row", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        m = Merges(vocabulary.value)
        rows, tokens, words, size = [], [], {}, 0
        for batch in batches:
            done = 0
            for i, text in enumerate(batch["text"]):
                text = text.as_py() or ""
                tokens.append(np.array([words.setdefault(w, len(words)) for w in find(text)], np.uint32))
                size += len(text.encode())
                if size >= GROUP_BYTES:
                    rows.append(batch["row"].slice(done, i + 1 - done))
                    done = i + 1
                    yield coded(rows, tokens, words, m)
                    rows, tokens, words, size = [], [], {}, 0
            if done < batch.num_rows:
                rows.append(batch["row"].slice(done))
        if tokens:
            yield coded(rows, tokens, words, m)

    return run


def _encoded(docs: DataFrame, path: str, pattern: str, whole: bool) -> DataFrame:
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    out = StructType([packed.schema["row"]])
    out = out.add("ids", ArrayType(IntegerType())) if whole else out.add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # of a checked size
    return packed.mapInArrow(tidy(_code(pattern, vocabulary, whole)), out)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with a last column ids, the ids of the text; a column of that name is replaced."""
    return _encoded(docs.drop("ids"), path, pattern, True).select("row.*", "ids")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with a last column decoded, the bytes that the ids stand for; null for null, an error for ids without a piece."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))  # of a checked size

    @F.arrow_udf("binary")
    def pieces(own: pa.Array) -> pa.Array:
        ranks = sent.value
        known = np.array(sorted(ranks.values()), np.int64)
        spelt = sorted(ranks, key=ranks.get)
        sizes = np.array([len(p) for p in spelt], np.int64)
        first, every = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(spelt), np.uint8)
        flat = np.array(own.flatten(), np.int64)
        at = np.searchsorted(known, flat)
        if len(flat) and (flat != known[np.minimum(at, len(known) - 1)]).any():
            raise ValueError("an id has no piece")
        k = sizes[at]
        data = every[np.repeat(first[at] - np.cumsum(k) + k, k) + np.arange(k.sum())]
        ends = np.concatenate([[0], np.cumsum(k)])
        rows = np.concatenate([[0], np.cumsum(np.array(own.value_lengths().fill_null(0), np.int64))])
        cut = ends[rows].astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(data.tobytes())])
        return pa.compute.if_else(own.is_null(), None, found).cast(pa.binary())

    return encoded.withColumn("decoded", pieces(ids))


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return _encoded(docs.select("doc_id", "text"), path, pattern, False).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
