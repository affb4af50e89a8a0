"""Packing, whitening and collocations against brute force."""

import collections
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import sentences
from variorum.llm import collocations, packing, queries, whitening

PATH = public_tokenizers.path("byte_bpe_50k.json")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Packing


def expected_pieces(texts, capacity=2048):
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    for doc_id, text in texts:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, first, *range(first + capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            yield doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())


def check_places(found, capacity):
    """Sequences are gapless from 0 and within their capacity; their number is given back."""
    by = collections.defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_are_those_of_the_tokenizer(docs, texts):
    found = packing.digest(docs, PATH).collect()
    wanted = sorted(expected_pieces(texts), key=repr)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == wanted
    n = check_places(found, 2048)
    assert n <= -(-sum(w[3] for w in wanted) // 2048) + 1


def test_odd_texts_and_other_tokenizers(spark, monkeypatch):
    odd = [" a  b　 c   d  e  ", " \n x \n\n y", "", "   ", "é è à  ñ   ü", "x\x1c y\x85 z", " <|endoftext|> it's 'll  ' re", "日本語 テキスト", "a" * 3000, "ab 12 " * 200]
    for path, fast in ((PATH, True), (public_tokenizers.path("word_bpe_49k.json"), False)):
        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        encoder = packing.Encoder(packing.read_file(path))
        assert encoder.parts == fast
        monkeypatch.setattr(packing, "PART", 40)
        assert [encoder.encode(t).tolist() for t in odd] == [own.encode(t, add_special_tokens=False).ids for t in odd]
        monkeypatch.undo()


def test_sequences_hold_the_documents(docs, texts):
    packed = packing.pack(packing.pieces(docs, PATH, capacity=64), capacity=64)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    own = Tokenizer.from_file(PATH)
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    text = dict(texts)[3]
    mine = sorted((r for r in packed.where("doc_id = 3").collect()), key=lambda r: r.piece)
    assert own.decode([i for r in mine for i in r.ids][:-1]) == text


def test_cuts():
    assert packing.cuts(5, 4) == [1, 5] and packing.cuts(8, 4) == [4, 8] and packing.cuts(4, 4) == [4] and packing.cuts(1, 4) == [1]


def brute_squares(lengths, capacity):
    gaps = []
    for n in lengths:
        fits = {g for g in gaps if g >= n}
        if not fits:
            gaps.append(capacity - n)
            continue

        def after(g):
            left = collections.Counter(gaps)
            left[g] -= 1
            left[g - n] += 1
            return sum(c * c for gap, c in left.items() if gap), g

        gaps.remove(g := min(fits, key=after))
        gaps.append(g - n)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_squares_by_brute_force(seed):
    r = random.Random(seed)
    lengths = sorted((r.randrange(1, 41) for _ in range(150)), reverse=True)
    where, offset, fill = packing.sum_of_squares(np.array(lengths), 40)
    assert sorted(40 - fill) == brute_squares(lengths, 40)
    assert np.array_equal(np.bincount(where, lengths), fill)


@pytest.mark.parametrize("group", [50, 100_000])
def test_groups_cost_little(spark, group):
    r = random.Random(1)
    lengths = [r.choice([r.randrange(1, 200), r.randrange(1, 2049), 2048]) for _ in range(3000)]
    table = spark.createDataFrame([(i % 7, n, "x") for i, n in enumerate(lengths)], "doc_id int, length int, row string").repartition(5)
    found = packing.pack(table, group=group).collect()
    assert sorted(r.length for r in found) == sorted(lengths)
    assert check_places(found, 2048) <= -(-sum(lengths) // 2048) * 1.02


def test_pieces_that_share_no_sequence_end_the_rounds(spark):
    found = packing.pack(spark.range(500).selectExpr("1100L as length"), group=50).collect()
    assert check_places(found, 2048) == 500


def test_packing_of_no_rows_and_of_bad_lengths(spark, no_docs):
    assert packing.digest(no_docs, PATH).collect() == []
    with pytest.raises(ValueError, match="length"):
        packing.pack(spark.createDataFrame([(None,), (3,)], "length int"))


# Whitening


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(2)
    base = (r.normal(size=(400, 6)) * np.array([3, 2, 1, 0.5, 0.25, 0.1]) + 100).astype(np.float32)
    out = [(i, v.tolist()) for i, v in enumerate(base)]
    out += [(1000 + i, base[5].tolist()) for i in range(150)] + [(3, base[3].tolist()), (None, base[4].tolist())]
    out += [(2000, None), (2001, []), (2002, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (2003, [float("nan")] * 6), (2004, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0])]
    return out


def by_numpy(vectors, k=4):
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if v and None not in v and np.isfinite(np.array(v, float)).all()]
    x = np.floor(256 * np.array([v for _, v in kept])).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    e, v = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    return [i for i, _ in kept], n, ((n * x - total) ** 2).sum(1), (x - total / n) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_by_numpy(spark, vectors, parts, monkeypatch):
    monkeypatch.setattr(whitening, "TOGETHER", 72)  # two factors at a time
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, x string, size int").repartition(parts)
    found = whitening.digest(table).toPandas()
    ids, n, deviation, white, explained = by_numpy(vectors)
    assert len(found) == 4 * len(ids) and set(found.n) == {n}
    assert found.identity_error.max() < 1e-9 and found.identity_error.nunique() == 1
    for k in range(4):
        mine = found[found.component == k + 1]
        assert np.allclose(mine.explained, explained[k], rtol=1e-9)
        known = {repr(float(i) if i is not None else None): (d, w) for i, d, w in zip(ids, deviation.tolist(), white[:, k])}
        sign = None
        for i, d, w in zip(mine.vec_id, mine.deviation, mine.whitened):
            wanted = known[repr(None if np.isnan(i) else float(i))]
            sign = sign or np.sign(w * wanted[1])
            assert d == wanted[0] and abs(w * sign - wanted[1]) < 1e-9


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    table = lambda data: whitening.digest(spark.createDataFrame(data, kind)).collect()
    assert table([]) == []
    assert table([(1, None), (2, [])]) == []
    assert table([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # one distinct vector
    line = table([(i, [float(i), 2.0 * i]) for i in range(5)])
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    both = table([(i, [float(i)]) for i in range(4)] + [(10 + i, [float(i * i), float(i)]) for i in range(4)])
    assert sorted((r.vec_id, r.component) for r in both) == [(i, 1) for i in range(4)] + [(10 + i, c) for i in range(4) for c in (1, 2)]
    far = table([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])])
    assert all(r.deviation is None for r in far if r.vec_id < 3) and len(far) >= 3


def test_exact_sums_beyond_doubles():
    x = np.array([[(1 << 60) + 1, 3], [-(1 << 60), 5], [7, 8]], np.int64)
    total = whitening._total(x)
    assert total == [8, 16]
    assert whitening.deviation(x, 3, total)[0] is None and whitening.deviation(x[2:], 3, [8, 16]) == [(21 - 8) ** 2 + (24 - 16) ** 2]


@pytest.mark.parametrize("size", [1, 2, 5, 33, 64])
def test_rotations_keep_small_deviations(size):
    r = np.random.default_rng(size)
    a = r.normal(size=(3 * size, size)) * np.logspace(0, -7, size)
    sigma, v = whitening.jacobi(np.linalg.qr(a, mode="r"))
    _, wanted, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(sigma, wanted, rtol=1e-12)
    assert np.allclose(np.abs((v * vt.T).sum(0)), 1) and np.allclose(v.T @ v, np.eye(size), atol=1e-13)


# Collocations


def brute_phrases(data, top=2000, least=30):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in data:
        lang = "und" if lang is None else lang
        own = counts[lang]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                own.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + s] for p, a in found.items() for s in range(2, len(p)) for i in range(len(p) - s + 1) if 100 * a >= 80 * own[p[i : i + s]]}
        best = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    r = random.Random(8)
    out = []
    for i in range(300):
        w = sentences(i, 60, 40).split()
        for _ in range(3):
            w.insert(r.randrange(len(w)), r.choice(["New York City", "new york", "red\there", "é ß. ö", "a,b", "end\nof line"]))
        out.append((r.choice(["en", "en", "en", "en", "de", None, ""]), " ".join(w)))
    out += [("en", None), (None, ""), ("fr", " . ,"), ("en", "x y " * 4000), ("en", "stop. " * 50), ("zz", "one"), ("en", "nul\x00word dash-word " * 40)]
    return out


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_phrases_by_brute_force(spark, prose, monkeypatch):
    table = spark.createDataFrame([(i, t, g, "k", "p", 1) for i, (g, t) in enumerate(prose)], "doc_id long, text string, lang string, key string, phrase string, size int").repartition(5)
    wanted = brute_phrases(prose)
    assert rows(collocations.digest(table).select(*COLUMNS)) == sorted(wanted, key=repr)
    assert rows(collocations.digest(table, top=3).select(*COLUMNS)) == sorted((w for w in wanted if w[1] <= 3), key=repr)
    # bits that stand for several cells let more phrases through, and lose none
    monkeypatch.setattr(collocations, "BITS", 1 << 6)
    assert rows(collocations.digest(table).select(*COLUMNS)) == sorted(wanted, key=repr)


def test_cells_are_never_below_a_count(spark, prose):
    prose = [("none" if g is None else g, t) for g, t in prose]
    table = spark.createDataFrame(prose, "key string, text string")
    own = collocations.sketch(table, 4, 30)
    counts = collections.Counter()
    for batch in collocations._prepared(iter([pa.RecordBatch.from_pylist([{"key": g, "text": t} for g, t in prose])])):
        for size in range(1, 5):
            counts.update(batch.hashes(size)[batch.inside(size)].tolist())
    every = np.array(list(counts), np.uint64)
    often = np.array([c >= 30 for c in counts.values()])
    assert own.may(every)[often].all()
    assert own.may(every)[~often].mean() < 0.05


def test_long_texts_are_cut_between_pieces(monkeypatch):
    text = "".join(f"w{i % 50} w{i % 7}{'.' if i % 11 == 0 else ' '}" for i in range(5000))
    batch = pa.RecordBatch.from_pylist([{"key": "a", "text": "b c"}, {"key": "b", "text": text}, {"key": "a", "text": None}])
    whole = collections.Counter(h for c in collocations._prepared(iter([batch])) for h in c.hashes(3)[c.inside(3)].tolist())
    monkeypatch.setattr(collocations, "TEXT_BYTES", 500)
    cut = list(collocations._prepared(iter([batch])))
    assert len(cut) > 10 and collections.Counter(h for c in cut for h in c.hashes(3)[c.inside(3)].tolist()) == whole


def test_scores_are_exact_beyond_64_bits(spark):
    big = (1 << 62) - 1
    counts = spark.createDataFrame([("k", "a b", 2, big - 5), ("k", "a", 1, big), ("k", "b", 1, big - 1), ("k", "a b c", 3, (big - 5) // 5 * 4), ("k", "c", 1, big), ("k", "b c", 2, big)], "key string, phrase string, size int, a long")
    found = {r.phrase: r for r in collocations.scored(counts.where("size > 1"), counts.union(spark.createDataFrame([("k", "", 0, 1)], counts.schema))).collect()}
    assert found["a b"].score == 2000000 * (big - 5) // (2 * big - 1)
    kept = {r.phrase for r in collocations.subsumed(counts).collect()}
    assert ("a b" in kept) == (100 * ((big - 5) // 5 * 4) < 80 * (big - 5)) and "a b c" in kept


def test_ties_take_the_first_cut_and_bytes_order(spark):
    counts = spark.createDataFrame([("k", "x y z", 3, 40), ("k", "x", 1, 50), ("k", "y z", 2, 60), ("k", "x y", 2, 60), ("k", "z", 1, 50)], "key string, phrase string, size int, a long")
    one = collocations.scored(counts.where("size = 3"), counts).first()
    assert (one.l, one.r) == (50, 60)
    tied = spark.createDataFrame([("k", p, 40, 1, 1, 7) for p in ("ﬀ b", "\U0001f600 b", "a b")], "key string, phrase string, a long, l long, r long, score long")
    assert [r.phrase for r in collocations.ranked(tied, 5).orderBy("rank").collect()] == ["a b", "ﬀ b", "\U0001f600 b"]


def test_phrases_of_no_documents(no_docs, docs):
    assert collocations.digest(no_docs).collect() == []
    assert collocations.digest(docs).where(F.col("rank") < 1).collect() == []


def test_phrases_by_sql(spark, sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf}/{f}')")
    wanted = c.execute(f"select {', '.join(COLUMNS)} from ({queries.ORACLE_SQL['op13_collocations']})").fetchall()
    assert rows(queries.op13_collocations(spark, sf).select(*COLUMNS)) == sorted(wanted, key=repr)
