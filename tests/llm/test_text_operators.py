"""Near duplicates, repeats, decontamination and byte-level BPE against brute force."""

import base64
import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from variorum.llm import byte_bpe, decontaminate, near_dedup, substring_dedup
from variorum.llm._grams import column_bytes

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def spaced(text):
    return (text or "").encode().split()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_components(texts, threshold):
    sets = []
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and len(x & y) >= threshold * len(x | y) or i is not None and i == j:
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)].append(i)
    out = []
    for k, (i, s) in enumerate(sets):
        c = min(least[find(k)], default=None) if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("threshold", [Fraction(85, 100), Fraction(4, 5), Fraction(1, 2)])
def test_near_duplicates(docs, texts, threshold):
    assert rows(near_dedup.near_duplicates(docs, threshold)) == brute_components(texts, threshold)


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 4)
    words = [f"a{i}" for i in range(60)]
    texts = [(k, " ".join(words[: 60 - k] + [f"b{k}"] * k)) for k in range(25)]
    found = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), Fraction(85, 100))
    assert rows(found) == brute_components(texts, Fraction(85, 100))


def near_copies(n, words=120):
    """Copies of one text, a few to many words of each replaced: some are linked, others resemble them."""
    r = random.Random(n)
    base = [f"b{i}" for i in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for j in r.sample(range(words), r.choice([1, 1, 2, 3, 6])):
            own[j] = f"x{k}_{j}" if r.random() < 0.7 else f"y{j}"
        out.append((k, " ".join(own)))
    return out


def test_a_large_cluster_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 16)
    texts = near_copies(300)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    wanted = brute_components(texts, Fraction(4, 5))
    assert 1 < len({r[2] for r in wanted}) < 300
    assert rows(near_dedup.near_duplicates(df)) == wanted


def test_links_and_copies_of_sets_are_linear_in_a_cluster(spark, monkeypatch):
    n, made, given = 2000, [], spark.sparkContext.accumulator(0)
    real_components, real_compare = near_dedup.components, near_dedup._compare

    def counted(df):
        df = near_dedup.materialize(df)
        made.append(df.count())
        return real_components(df)

    def compare(threshold, k):
        run = real_compare(threshold, k)

        def both(table):
            given.add(table.num_rows)
            return run(table)

        return both

    monkeypatch.setattr(near_dedup, "components", counted)
    monkeypatch.setattr(near_dedup, "_compare", compare)
    found = near_dedup.near_duplicates(spark.createDataFrame(near_copies(n), "doc_id long, text string").repartition(4))
    assert found.where("not kept").count() > n / 4
    # candidates: at most one a list and class; links: two forests at most; copies: two, and those of what stays apart
    assert made[0] < 20 * n and max(made[1:]) < 2 * n and given.value < 5 * n


@pytest.mark.parametrize("threshold", [Fraction(85, 100), Fraction(4, 5)])
def test_sets_with_links_are_promising(spark, threshold):
    texts = near_copies(150, 40) + [(1000 + k, " ".join(t.split()[: 30 - k % 9])) for k, t in near_copies(40, 40)]
    sets = [np.unique(s) for s in near_dedup.shingle_sets(*column_bytes(pa.array([t for _, t in texts])), 5)]
    df = spark.createDataFrame([(k % 2, i, len(s), near_dedup.ex.planes(s)) for k, ((i, _), s) in enumerate(zip(texts, sets, strict=True))], "cluster long, rep long, n long, shingles binary").withColumn("key", F.col("rep"))
    kept = {r.rep for r in near_dedup.promising(df, threshold, 8).collect()}
    wanted = {texts[k][0] for a in range(len(sets)) for b in range(a) if a % 2 == b % 2 and len(np.intersect1d(sets[a], sets[b])) >= threshold * len(np.union1d(sets[a], sets[b])) for k in (a, b)}
    assert wanted <= kept and len(kept) < len(texts)


def test_copies_of_one_text_meet_their_class_in_parts(spark):
    texts = [(k, "the same words in every row of this table") for k in range(400)] + [(1000, "others that stand alone in this table here")]
    assert rows(near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))) == brute_components(texts, Fraction(4, 5))


@pytest.mark.parametrize("threshold", [Fraction(85, 100), Fraction(4, 5)])
def test_similar_small_sets_share_a_run(threshold):
    small, large, bound = near_dedup.run_lengths(threshold)
    r = np.random.default_rng(1)
    for _ in range(3000):
        u = int(r.integers(2, 80))
        shared = -(-threshold.numerator * u // threshold.denominator)
        kept = np.zeros(u, bool)
        kept[r.permutation(u)[:shared]] = True
        extra = r.random(u) < 0.5
        a, b = kept | extra, kept | ~extra
        runs = max(map(len, "".join("x" if k else " " for k in a & b).split()))
        for size, wanted in ((small, max(a.sum(), b.sum()) <= bound), (large, min(a.sum(), b.sum()) >= int(threshold * bound))):
            assert not wanted or runs >= size or shared == u


def test_one_of_each_component_stays(docs, texts):
    kept = near_dedup.without_near_duplicates(docs)
    wanted = collections.Counter(repr(i) for i, _, c, stay in brute_components(texts, Fraction(4, 5)) if stay or i is None)
    assert collections.Counter(repr(r.doc_id) for r in kept.collect()) == wanted
    assert kept.columns == docs.columns


def brute_repeats(texts, span):
    split = [spaced(t) for _, t in texts]
    seen = collections.Counter(tuple(w[j : j + span]) for w in split for j in range(len(w) - span + 1))
    out = []
    for (i, t), w in zip(texts, split, strict=True):
        gone = {k for j in range(len(w) - span + 1) if seen[tuple(w[j : j + span])] > 1 for k in range(j, j + span)}
        out.append((i, t, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("span", [35, 6, 2])
def test_repeats(docs, texts, span):
    wanted = sorted(((i, n, g, hashlib.sha256(x).hexdigest()) for i, _, n, g, x in brute_repeats(texts, span)), key=repr)
    assert rows(substring_dedup.digest(docs, span)) == wanted


def test_texts_without_repeats(docs, texts):
    found = substring_dedup.without_repeats(docs)
    wanted = sorted(((i, x.decode() if g else t, len(x.decode()) if g else None) for i, t, _, g, x in brute_repeats(texts, 35)), key=repr)
    assert rows(found.select("doc_id", "text", "n_chars")) == wanted
    assert found.columns == docs.columns


ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(texts, items, span):
    windows = collections.defaultdict(set)
    for label, t in items:
        w = ALNUM.findall((t or "").encode().lower())
        n = min(span, len(w))
        for j in range(len(w) - n + 1) if n else ():
            windows[n, tuple(w[j : j + n])].add(label)
    out = []
    for i, t in texts:
        w, hit, found = ALNUM.findall((t or "").encode().lower()), set(), set()
        for n in {k for k, _ in windows}:
            for j in range(len(w) - n + 1):
                if (key := (n, tuple(w[j : j + n]))) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[key] - {None}
        names = sorted(map(str, found))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(spark, texts):
    t = dict(texts)
    found = [(1, " ".join(t[2].split()[20:45])), (2, t[2].upper()), (10, " ".join(t[9].split()[:10])), (11, "one"), (12, "two, WORDS!"), (13, ""), (14, None), (None, " ".join(t[6].split()[50:70])), (1, t[1][:200]), (1, t[1][:200])]
    return found


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 400])
def test_decontamination(spark, docs, texts, items, block):
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hits string")
    marked = decontaminate.mark(docs, benchmark, block_bytes=block)
    assert rows(decontaminate.digest(marked)) == brute_hits(texts, items, 10)
    clean = decontaminate.without_contaminated(docs, benchmark, block_bytes=block)
    assert clean.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(r[0]) for r in brute_hits(texts, items, 10) if not r[5])


def test_windows_that_many_items_share(spark):
    shared = " ".join(f"s{i}" for i in range(30))
    items = [(i % 50, shared if i < 60 else f"{shared} own{i}") for i in range(120)] + [(None, shared), (900, "s1 s2")]
    texts = [(1, f"a b {shared} c"), (2, shared * 40), (3, "nothing s1 s2"), (4, None)]
    df, benchmark = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 2000):
        assert rows(decontaminate.digest(decontaminate.mark(df, benchmark, block_bytes=block))) == brute_hits(texts, items, 10)
    index = decontaminate.Index([(str(i), t) for i, t in items if i is not None], 10, 5)
    assert len(index.windows[10][0]) <= 21 + 60 and sum(map(len, index.sets)) < 1000


def test_bpe(docs, texts):
    wanted = []
    for i, t in texts:
        ids = TIKTOKEN.encode_ordinary(t or "")
        wanted.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(byte_bpe.digest(docs, PATH, public_tokenizers.PATTERN)) == sorted(wanted, key=repr)


def test_bpe_round_trip(docs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "GROUP_BYTES", 1000)
    coded = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert coded.columns == [*(c for c in docs.columns if c != "ids"), "ids"]
    for r in byte_bpe.decode(coded, PATH).select("text", "ids", "decoded").collect():
        assert r.ids == TIKTOKEN.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_bpe_folds_alike(spark):
    words = ["", "a", " thntblere", "ciónasboue", "日本語", "zzzzzzzz", " " * 9, "x" * 700, "aé" * 300, " Entlohnung"]
    merges = byte_bpe.Merges(RANKS)
    some = [w for w in words if w]
    flat, sizes = merges.fold([w.encode() for w in some])
    cut = np.cumsum([0, *sizes])
    for k, w in enumerate(some):
        if w.encode() not in RANKS:
            assert flat[cut[k] : cut[k + 1]].tolist() == TIKTOKEN._encode_single_piece(w.encode())
    df = spark.createDataFrame([(w,) for w in words if len(w) < 50], "word string")
    for r in byte_bpe.encode_words(df, "word", PATH).collect():
        assert r.ids == (TIKTOKEN._encode_single_piece(r.word.encode()) if r.word else [])


def test_empty_tables(spark, docs, no_docs, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert near_dedup.near_duplicates(no_docs).count() == 0
    assert near_dedup.without_near_duplicates(no_docs).count() == 0
    assert substring_dedup.digest(no_docs).count() == 0
    assert substring_dedup.without_repeats(no_docs).count() == 0
    assert decontaminate.mark(no_docs, benchmark).count() == 0
    assert decontaminate.without_contaminated(docs, benchmark.limit(0)).count() == docs.count()
    assert byte_bpe.digest(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(no_docs, PATH, public_tokenizers.PATTERN), PATH).where(F.col("decoded").isNull()).count() == 0


def test_estimates_keep_links_far_in_the_tail():
    threshold, k = Fraction(85, 100), 80
    low, high = np.arange(1, 86, dtype=np.uint64), np.arange(1000, 1400, dtype=np.uint64)
    a, b = (np.sort(np.concatenate([low[:53], own, high])) for own in (low[53:69], low[69:]))
    assert len(np.intersect1d(a, b)) >= threshold * len(np.union1d(a, b))
    assert near_dedup.linked([a, b], threshold, k) == [(0, 1)]
    assert near_dedup.linked([a, b], threshold, k, np.zeros(2)) == [] == near_dedup.linked([a, b], threshold, k, None, np.zeros(2, bool))
    for t in (threshold, Fraction(8, 10)):
        for u, least in enumerate(near_dedup.least_shared(t, 2 * k).tolist()):
            assert sum(math.comb(u, s) * t**s * (1 - t) ** (u - s) for s in range(least)) <= 1e-9


def test_components_join_only_edges_that_are_left(spark, monkeypatch):
    """A long way and a star: edge tables shrink to nothing, and in all rounds together hold few times the edges."""
    from variorum.llm import _components

    sizes, write = [], _components.materialize

    def counted(df):
        found = write(df)
        if found.columns == ["a", "b"]:
            sizes.append(found.count())
        return found

    monkeypatch.setattr(_components, "materialize", counted)
    edges = [(i, i + 1) for i in range(100, 228)] + [(999, k) for k in range(500, 520)] + [(520, 500), (7, 7)]
    found = dict(_components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 100 for i in range(100, 229)} | {k: 500 for k in [*range(500, 521), 999]}
    assert sizes[0] == 149 and sizes[-1] == 0 and sum(sizes) < 6 * 149
