"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents become token ids and an end id.  Those that are longer than a sequence
are cut into whole sequences, the rest of the division first; nothing else is
cut.  Pieces are packed by sums of squares: a piece goes to the open sequence
where the squared counts of open sequences per residual gap become smallest
(ties to the smaller gap), and opens one where none has room.  Longer pieces come
first, so a count of each gap is all the state there is.

Pieces are dealt evenly to groups of about ``GROUP``, by a hash of their places,
and packed group by group in tasks.  What a group leaves in sequences with a gap
of more than a ``SLACK``-th goes to the next round's groups, until one group
holds it all or a round leaves more than half of what it got; so groups cost a
few sequences at any size, and no task sees more than a group.

Defined results: null and empty texts are the end id alone; very long texts are
encoded in parts and cut as any other; pieces that tie in length go by their
places; repeated rows are packed one by one; an empty table gives an empty one;
strings of special tokens in a text are ordinary text; other columns are
ignored, whatever their names.  Which sequence a piece comes to may change with
the partitions of the input; its tokens and pieces do not.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from variorum.llm._shared import materialize, tidy, tidy_group

CAPACITY, END = 2048, 0
#: Pieces that are packed together, about; a sequence is well filled with a gap of a SLACK-th of it at most.
GROUP, SLACK = 16384, 64
#: Characters of a long text that are encoded at once, about, and ids that a batch of rows holds.
PART, IDS = 1 << 20, 1 << 20
#: Bytes that a tokenizer's file may have: it is sent to every executor.
FILE_BYTES = 32 << 20
# Fixed value: how byte-level tokenizers split texts.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        found = f.read(FILE_BYTES + 1)
    if len(found) > FILE_BYTES:
        raise ValueError(f"{path} is larger than {FILE_BYTES} characters")
    return found


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: itself if it can be printed, else one from 256 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranks(how: dict) -> dict[bytes, int] | None:
    """Ids by bytes, if a tokenizer is plain byte-level BPE whose merges come in the order of ids; else None."""
    split, model = how.get("pre_tokenizer") or {}, how["model"]
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not how.get("normalizer")
    if not plain or model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocabulary = model["vocab"]
    merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in merged or merged != sorted(merged):
        return None
    byte = _byte_of()
    known = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if all(c in byte for c in t)}
    made = {i for t, i in known.items() if len(t) == 1} | set(merged)
    ranks = {t: i for t, i in known.items() if i in made}
    return ranks if len(ranks) == 256 + len(merged) and max(ranks[bytes([b])] for b in range(256)) < min(merged, default=1 << 30) else None


class Encoder:
    """Ids of texts by the tokenizer that a JSON text describes; strings of special tokens are ordinary text.

    Plain byte-level BPE goes through tiktoken, which gives the ids of the tokenizers library in a quarter of the
    time, and long texts in parts: between a letter or digit and a space a token always ends.
    """

    def __init__(self, described: str):
        ranks = _ranks(json.loads(described))
        if ranks:
            import tiktoken

            plain = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.one, self.parts = plain.encode_ordinary, True
            return
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share out the cores
        own = Tokenizer.from_str(described)
        own.encode_special_tokens = True
        self.one, self.parts = lambda text: own.encode(text, add_special_tokens=False).ids, False

    def encode(self, text: str) -> np.ndarray:
        if not self.parts or len(text) <= 2 * PART:
            return np.array(self.one(text), np.uint32)
        out, a = [], 0
        while a < len(text):
            b = text.find(" ", min(a + PART, len(text)))
            while b > 0 and not (text[b - 1].isascii() and text[b - 1].isalnum()):
                b = text.find(" ", b + 1)
            b = b if b > 0 else len(text)
            out.append(np.array(self.one(text[a:b]), np.uint32))
            a = b
        return np.concatenate(out)


def cuts(n: int, capacity: int) -> list[int]:
    """Ends of the pieces of n tokens: one, or the rest of the division and whole sequences."""
    return [n] if n <= capacity else list(range(n % capacity or capacity, n + 1, capacity))


def _pieces(described, capacity: int, end: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(described.value)
        for batch in batches:
            owner, piece, start, length, out = [], [], [], [], []
            held = 0

            def made() -> pa.RecordBatch:
                ids = pa.array(out, pa.list_(pa.int32())) if whole else pa.array(out, pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids" if whole else "ids_crc32"]
                return pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), ids], names=names)

            for i, text in enumerate(batch["text"]):
                ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                a = 0
                for k, b in enumerate(cuts(len(ids), capacity)):
                    owner.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    out.append(ids[a:b].astype(np.int32) if whole else zlib.crc32(ids[a:b].tobytes()))
                    a = b
                held += len(ids)
                if whole and held >= IDS:
                    yield made()
                    owner, piece, start, length, out = [], [], [], [], []
                    held = 0
            yield made()

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, whole: bool = True) -> DataFrame:
    """doc_id, piece, start, length and ids of every piece of every document; without whole, ids_crc32 in place of ids.

    start counts the ids of the document before the piece; ids_crc32 is that of little-endian 32-bit ids.
    """
    own = docs.select("doc_id", "text")
    described = docs.sparkSession.sparkContext.broadcast(read_file(path))  # of a checked size
    kind = StructType([own.schema["doc_id"]]).add("piece", IntegerType()).add("start", LongType()).add("length", LongType())
    kind = kind.add("ids", ArrayType(IntegerType())) if whole else kind.add("ids_crc32", LongType())
    return own.mapInArrow(tidy(_pieces(described, capacity, end, whole)), kind)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths in falling order: each piece's sequence, its offset there, and the fill of each sequence."""
    open_ = np.zeros(capacity + 1, np.int64)  # sequences by gap
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    for i, n in enumerate(lengths.tolist()):
        now, then = open_[n:], open_[: capacity + 1 - n]
        change = then - now  # half of what the sum changes by, less one; a sequence that becomes full leaves the sum
        change[0] = -now[0]
        change[now == 0] = never
        k = int(change.argmin())
        if change[k] == never:
            s, gap = len(fill), capacity - n
            fill.append(0)
        else:
            s, gap = by_gap[n + k].pop(), k
            open_[n + k] -= 1
        where[i], offset[i] = s, fill[s]
        fill[s] += n
        if gap:
            by_gap[gap].append(s)
            open_[gap] += 1
    return where, offset, np.array(fill, np.int64)


def _packed(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        length, place = table["length"].to_numpy(), table["place"].to_numpy()
        order = np.lexsort((place, -length))
        where, offset, fill = sum_of_squares(length[order], capacity)
        heads = place[order[np.unique(where, return_index=True)[1]]]
        cols = {"sequence_id": heads[where], "offset": offset, "gap": capacity - fill[where]}
        return pa.table({"row": table["row"].take(pa.array(order)), **{k: pa.array(v, pa.int64()) for k, v in cols.items()}})

    return run


def pack(found: DataFrame, length: str = "length", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Rows of found with sequence_id and offset: in a sequence they follow one another without a gap from 0.

    length must be from 1 to capacity.  sequence_id is the place of one of the rows, a number of no other meaning;
    columns of these two names are replaced.
    """
    found = found.drop("sequence_id", "offset")
    row = F.struct(*[F.col(f"`{c}`") for c in found.columns])
    rows = materialize(found.select(row.alias("row"), F.col(f"`{length}`").cast("long").alias("length"), F.monotonically_increasing_id().alias("place")))
    if not rows.where(f"length is null or length < 1 or length > {capacity}").isEmpty():
        raise ValueError(f"a length is not from 1 to {capacity}")
    kind = StructType([rows.schema["row"]]).add("sequence_id", LongType()).add("offset", LongType()).add("gap", LongType())
    place = lambda df: df.select("row.*", "sequence_id", "offset")
    done = place(rows.where(f"length = {capacity}").select("row", F.col("place").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    left, salt = rows.where(f"length < {capacity}"), 0
    n = left.count()
    while n:
        groups = -(-n // group)
        dealt = left.select("*", F.pmod(F.xxhash64("place", F.lit(salt)), F.lit(groups)).alias("group"))
        round_ = materialize(dealt.groupBy("group").applyInArrow(tidy_group(_packed(capacity)), kind))
        poor = round_.where(f"gap * {SLACK} > {capacity}")
        again = poor.count() if groups > 1 else 0
        if not again or 2 * again > n:
            return done.union(place(round_))
        done = done.union(place(round_.where(f"gap * {SLACK} <= {capacity}")))
        n, salt = again, salt + 1
        place_ = F.lit(salt).cast("long") * F.lit(1 << 56) + F.monotonically_increasing_id()  # no place of an earlier round
        left = materialize(poor.select("row", F.col(f"row.`{length}`").cast("long").alias("length"), place_.alias("place")))
    return done


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, from packed pieces with their ids."""
    listed = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # of capacity ids at most
    return packed.groupBy("sequence_id").agg(listed.alias("pieces")).select("sequence_id", F.flatten(F.transform("pieces", lambda x: x["ids"])).alias("ids"))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return pack(pieces(docs, path, whole=False))
