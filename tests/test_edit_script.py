import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from variorum.operators import collate, realign
from variorum.operators import edit_script as module
from variorum.operators.edit_script import edit_replay, edit_script, replay, replay_array, script_array, scripts

SHIPPED = [
    ("及其有事", "及亓有事也", ["replace@1", "insert@4"]),
    ("是以聖人自智而不自見也", "是以聖人自知不自見", ["delete@5", "replace@6", "delete@10"]),
    ("□□□德", "是以无德", ["replace@0", "replace@1", "replace@2"]),
    ("上禮□□□□□□□", "上禮爲之而莫之應", ["delete@2", *(f"replace@{i}" for i in range(3, 9))]),
    ("", "ab", ["insert@0", "insert@0"]),
    ("ab", "", ["delete@0", "delete@1"]),
    ("德", "德", []),
]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("source", "target", "wanted"), SHIPPED)
def test_known_scripts(source, target, wanted):
    (ops,) = scripts([source], [target])
    assert [f"{o['type']}@{o['position']}" for o in ops] == wanted
    assert replay(source, ops) == (target, None)


texts = st.text("abc德𠀀□\x00", max_size=12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(texts, texts), max_size=30))
def test_scripts_are_shortest_and_lead_to_the_target(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    found = script_array(a, b).field("operations")
    for (s, t), ops in zip(pairs, found.to_pylist(), strict=True):
        assert len(ops) == distance(s, t)
        assert sum(o["type"] == "insert" for o in ops) - sum(o["type"] == "delete" for o in ops) == len(t) - len(s)
        assert all(o["original_char"] != o["target_char"] and s[o["position"]] == o["original_char"] for o in ops if o["type"] == "replace")
    assert replay_array(pa.array(a, pa.string()), found).field("text").to_pylist() == b


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(texts, texts), max_size=20))
def test_bands_give_the_script_of_the_whole_table(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    found = script_array(a, b, None, [distance(s, t) for s, t in pairs]).field("operations").to_pylist()
    assert found == script_array(a, b).field("operations").to_pylist()
    for (s, t), ops in zip(pairs, found, strict=True):
        x, y = (module._points([z], len(z) + 1, 0)[0][:-1] for z in (s, t))
        kind, i, _ = module._trace_long(x, y, 4)[:, ::-1]
        assert [(module.NAMES[k], at) for k, at in zip(kind.tolist(), i.tolist(), strict=True)] == [(o["type"], o["position"]) for o in ops]


def test_tables_are_as_wide_as_the_distance(monkeypatch):
    cells, tables = [], module._tables
    monkeypatch.setattr(module, "_tables", lambda *x: cells.append((out := tables(*x)).size) or out)
    r = random.Random(4)
    s = "".join(r.choice("abcdefgh") for _ in range(9000))
    near = [s[:at] + "Z" + s[at + 1 :] for at in (0, 500, 8999)] + ["Q" + s, s[:-1], s[:4000] + s[4003:]]
    found = script_array([s] * 6, near, None, [1, 1, 1, 1, 1, 3]).field("operations").to_pylist()
    assert [len(o) for o in found] == [1, 1, 1, 1, 1, 3]
    assert sum(cells) <= 6 * 9001 * 5


kinds = st.sampled_from(["replace", "delete", "insert", "insert", "move", None])
one_op = st.fixed_dictionaries({"type": kinds, "char": st.sampled_from(["x", "yz", "", None]), "original_char": st.none(), "target_char": st.sampled_from(["X", "Y", None]), "position": st.sampled_from([None, -1, 0, 1, 2, 3, 9])})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text("ab", max_size=4)), st.one_of(st.none(), st.lists(one_op, max_size=4))), min_size=1, max_size=20))
def test_replay_of_arrays_is_that_of_rows(rows):
    kind = pa.list_(pa.struct([(k, pa.string()) for k in ("type", "char", "original_char", "target_char")] + [("position", pa.int32())]))
    found = replay_array(pa.array([s for s, _ in rows], pa.string()), pa.array([o for _, o in rows], kind)).to_pylist()
    assert [(r["text"], r["error"]) for r in found] == [replay(s, o) for s, o in rows]


def test_replay_in_any_order():
    """Long scripts whose positions are shuffled: deletions in runs, insertions into them before and after."""
    draw = random.Random(6)
    kind = pa.list_(pa.struct([(k, pa.string()) for k in ("type", "char", "original_char", "target_char")] + [("position", pa.int32())]))
    texts, given = [], []
    for size in (0, 1, 7, 40, 300):
        for _ in range(8):
            at = draw.sample(range(size), size * 3 // 4)
            ops = [{"type": "delete", "position": p} for p in at] + [{"type": "insert", "char": draw.choice(["x", "yz", ""]), "position": draw.randint(-2, size + 2)} for _ in range(size // 2 + 1)]
            ops += [{"type": "replace", "target_char": draw.choice("XYZ"), "position": p} for p in set(range(size)) - set(at)]
            draw.shuffle(ops)
            texts.append("".join(draw.choice("ab道🂡") for _ in range(size)))
            given.append(ops)
    found = replay_array(pa.array(texts), pa.array(given, kind)).to_pylist()
    assert [(r["text"], r["error"]) for r in found] == [replay(s, o) for s, o in zip(texts, given, strict=True)]
    assert replay_array(pa.array(["a"]), pa.array([[None]], kind)).to_pylist() == [{"text": None, "error": "operation None without a position"}]


def test_replay_rules():
    op = lambda kind, at, ch="x": {"type": kind, "position": at, "char": ch, "target_char": ch, "original_char": "never compared"}
    assert replay("abc", [op("insert", 1, "x"), op("insert", 1, "y")]) == ("axybc", None)
    assert replay("abc", [op("delete", 1), op("insert", 1, "y")]) == ("ayc", None)
    assert replay("abc", [op("replace", 1, "x"), op("replace", 1, "y")]) == ("ayc", None)
    assert replay("abc", [op("insert", 9, "z")]) == ("abcz", None)
    assert replay("abc", [op("delete", 1), op("replace", 1)])[1] and replay("abc", [op("delete", 3)])[1] and replay("abc", [op("move", 1)])[1]


def test_a_pair_that_is_too_long_has_an_error(spark):
    df = spark.createDataFrame([("a" * 100, "b" * 100), ("a", "b"), (None, "b")], "s string, t string")
    found = df.select(edit_script(F.col("s"), F.col("t"), 1000).alias("e")).collect()
    assert [r.e.error for r in found] == ["the texts are too long", None, None]
    assert found[0].e.operations is None and len(found[1].e.operations) == len(found[2].e.operations) == 1


def test_long_texts():
    a, b = "abcdefghij" * 300, "abcdefghi" * 330
    (ops,) = scripts([a], [b])
    assert len(ops) == distance(a, b) and replay(a, ops) == (b, None)


def test_blocks_of_rows_give_the_same_scripts(monkeypatch):
    r = random.Random(5)
    pairs = [("".join(r.choices("abcd", k=r.randrange(150))), "".join(r.choices("abcd", k=r.randrange(150)))) for _ in range(40)] + [("", "ab" * 40), ("ab" * 40, "")]
    whole = scripts(*zip(*pairs, strict=True))
    monkeypatch.setattr(module, "MOST_CELLS", 10)
    for cells, blocks in ((1, 2), (60, 3), (4000, 64)):
        monkeypatch.setattr(module, "TOGETHER", cells)
        monkeypatch.setattr(module, "BLOCKS", blocks)
        assert scripts(*zip(*pairs, strict=True)) == whole


def test_pairs_of_more_cells_than_one_table_have_scripts():
    a = "abcdefghij" * 830
    b = a[:4000] + "x" + a[4001:6000] + a[6001:] + "y"
    found = script_array([a, a], [b, a])
    assert found.field("error").to_pylist() == [None, None] and [len(x) for x in found.field("operations").to_pylist()] == [3, 0]
    assert replay_array(pa.array([a, a]), found.field("operations")).field("text").to_pylist() == [b, a]


def test_a_pair_without_a_script_is_not_accepted(spark):
    rows = [(1, f"v{v}", 1, 1, 0, text * 50) for v, text in enumerate("ab")]
    own = collate.collate(spark.createDataFrame(rows, "version_idx int, version string, chapter_number int, sentence_number int, row_idx long, text string"), most_cells=100)
    responses = own.select(*realign.KEYS, F.lit(None).cast("string").alias("content"))
    assert tuple(realign.outcome(realign.realign(own, responses)).first()) == (0, 1)


def test_columns(spark):
    df = spark.createDataFrame([(s, t) for s, t, _ in SHIPPED], "s string, t string")
    script = edit_script(F.col("s"), F.col("t"))
    found = df.select("t", script["operations"].alias("o"), "s").select("t", F.size("o").alias("n"), F.levenshtein("s", "t").alias("d"), edit_replay(F.col("s"), F.col("o")).alias("p"))
    assert all(r.n == r.d and r.p.text == r.t and r.p.error is None for r in found.collect())


WITNESS = [(2, "bb", 10, 7, 0, "及亓有事也"), (1, "hj", 10, 7, 0, "及其有事"), (3, "wb", 10, 7, 0, None), (3, "wb", 10, 7, 1, "及其有事"), (1, "hj", 11, 1, 5, "單"), (4, "", 10, 7, 9, "x"), (5, None, 10, 7, 9, "x"), (1, "hj", None, 1, 0, "x")]


@pytest.fixture(scope="module")
def witness(spark):
    return spark.createDataFrame(WITNESS, "version_idx int, version string, chapter_number int, sentence_number int, row_idx long, text string")


@pytest.mark.parametrize("distinct", [False, True])
def test_pairs(witness, distinct):
    found = collate.collate(witness, distinct)
    got = sorted((r.original_text_version, r.modified_text_version, r.original_text, r.modified_text, r.edit_distance, len(r.operations)) for r in found.collect())
    texts = {"bb": ["及亓有事也"], "hj": ["及其有事"], "wb": ["", "及其有事"]}
    wanted = sorted((a, b, x, y, distance(x, y), distance(x, y)) for a in texts for b in texts if a < b for x in texts[a] for y in texts[b])
    assert got == wanted


def test_hot_sentences_give_the_same_pairs(witness, spark):
    rows = [(v, f"v{v:03}", 10, 7, v, f"t{v % 5}") for v in range(40)]
    own = witness.union(spark.createDataFrame(rows, witness.schema))
    found = collate.pairs(own, hot=6)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, collate.pairs(own).collect()))


def test_pair_index_and_slices(witness):
    own = collate.pair_index(collate.pairs(witness), witness)
    found = [r.pair_index for r in own.orderBy("original_text_version", "modified_text_version", "modified_text").collect()]
    assert sorted(found) == list(range(len(found)))
    assert collate.index_slice(own, -5, 2).count() == 2 and collate.index_slice(own, 3).count() == len(found) - 3 and collate.index_slice(own, 4, 999).count() == len(found) - 4


def test_seven_witnesses_make_21_pairs(spark):
    rows = [(v, f"v{v}", 0, s, s, "德") for v in range(7) for s in range(4)]
    own = spark.createDataFrame(rows, "version_idx int, version string, chapter_number int, sentence_number int, row_idx long, text string")
    found = collate.pair_index(collate.pairs(own), own)
    assert found.where("sentence_number = 3").agg(F.min("pair_index")).first()[0] == 63


def test_exploded_operations(witness):
    found = collate.exploded_operations(collate.collate(witness))
    assert {"step", "type", "position"} <= set(found.columns) and found.where("step < 0").count() == 0


def test_copies_are_paired_once(spark):
    """Work goes by different rows; each pair still comes as often as there are copies of its sides."""
    rows = [(v, f"v{v}", c, 1, 100 * c + 10 * v + k, f"text {v} {k % 2}") for c in (1, 2) for v in range(3) for k in range(8)]
    own = spark.createDataFrame(rows, "version_idx int, version string, chapter_number int, sentence_number int, row_idx long, text string")
    found = collate.distinct_pairs(own)
    assert found.count() == 2 * 3 * 2 * 2 and found.agg(F.sum("n_copies")).first()[0] == 2 * 3 * 64
    assert collate.text_scripts(own).count() == 12
    names = ["chapter_number", "original_text_version", "original_text", "modified_text_version", "modified_text"]
    wanted = sorted((a[2], a[1], a[5], b[1], b[5]) for a in rows for b in rows if a[2] == b[2] and a[1] < b[1])
    for many in (collate.pairs(own), collate.pairs(own, hot=5), collate.collate(own), collate.collate(own, distinct_texts=True)):
        assert sorted(map(tuple, many.select(*names).collect())) == wanted
    assert collate.distance_summary(own).agg(F.sum("n_pairs")).first()[0] == len(wanted)


def test_expanded_beyond_one_list(spark):
    counts = [1, 4095, 4096, 4097, 10_000]
    found = collate.expanded(spark.createDataFrame([(n, n) for n in counts], "a long, n_copies long"))
    assert {r["a"]: r["count"] for r in found.groupBy("a").count().collect()} == {n: n for n in counts}


@pytest.mark.parametrize(("start", "end"), [(0, 5), (70, 140), (-3, 2), (190, None), (10, 10)])
def test_slice_of_pairs_that_are_not_made(spark, start, end):
    rows = [(v, f"v{v}", c, s, 1000 * c + 100 * s + 10 * v + k, f"text {k % 2}") for c in (2, 1) for s in (1, 2) for v in range(3) for k in range(5)]
    own = spark.createDataFrame(rows, "version_idx int, version string, chapter_number int, sentence_number int, row_idx long, text string")
    wanted = collate.index_slice(collate.pair_index(collate.pairs(own), own), start, end)
    found = collate.pair_slice(own, start, end)
    assert sorted(map(tuple, found.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize(("hot", "at_once", "most"), [(collate.HOT, 4096, 256), (2, 2, 1)])
def test_places_with_versions_are_the_pairs(witness, spark, monkeypatch, hot, at_once, most):
    """Also where sentences are hot, texts have more versions than a map takes, and records take one place."""
    monkeypatch.setattr(collate, "AT_ONCE", at_once)
    monkeypatch.setattr(collate, "MOST_PLACES", most)
    rows = [(v, f"v{v}", c, s, v, None if v == 3 else f"t{v % 2}") for v in range(7) for c in (1, 2) for s in (1, 2) for _ in range(2)]
    own = witness.union(spark.createDataFrame([*rows, (9, None, 1, 1, 9, "t0"), (9, "v9", None, 1, 9, "t0")], witness.schema))
    found = collate.version_places(own, hot)
    assert found.agg(F.max(F.size("original_versions"))).first()[0] <= at_once
    wanted = collate.distinct_pairs(own)
    again = collate.paired(collate.gathered(found, ["original_text", "modified_text"], collate.sentence_count(own)))
    assert sorted(map(tuple, again.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
