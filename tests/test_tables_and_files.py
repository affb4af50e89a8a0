import json
import re
import time
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from variorum import schema
from variorum.operators import collate, graph, reshape
from variorum.operators.graph import Graph
from variorum.plans import collation
from variorum.sinks import files as sinks
from variorum.sources import files as sources
from variorum.sources import xlsx
from variorum.sources.annotator import answered
from variorum.streaming import cells as streaming

SHEET = [(1, 2, "。道可道", "道可道也", None), (1, 1, "名可名", None, None), (1, 1, " ", "x", None), (0, 0, "上德", "上德。", None), (None, 3, "無", None, None), (2, 0, None, None, None)]
COLUMNS = "seg int, ln int, hj string, gd string, empty string"


@pytest.fixture(scope="module")
def sheet(spark):
    rows = [(*r, i) for i, r in enumerate(SHEET)]
    return spark.createDataFrame(rows, COLUMNS + ", row_idx long")


@pytest.fixture(scope="module")
def witness(sheet):
    return reshape.unpivot(sheet).cache()


def test_unpivot(witness):
    got = sorted(tuple(r) for r in witness.collect())
    assert got == [(1, "hj", 0, 0, 3, "上德"), (1, "hj", 1, 1, 1, "名可名"), (1, "hj", 1, 1, 2, ""), (1, "hj", 1, 2, 0, "。道可道"), (2, "gd", 0, 0, 3, "上德。"), (2, "gd", 1, 1, 2, "x"), (2, "gd", 1, 2, 0, "道可道也")]


def test_unpivot_options(sheet, spark):
    empty = spark.createDataFrame([(1, 1, "", 0)], "seg int, ln int, hj string, row_idx long")
    assert reshape.unpivot(empty).count() == 1 and reshape.unpivot(empty, empty_as_null=True).count() == 0
    assert [r.ln for r in reshape.quarantine(sheet).collect()] == [3]
    with pytest.raises(ValueError, match="seg, ln"):
        reshape.versions_of(spark.range(1))


def test_nest_and_flatten(witness, tmp_path, spark):
    tree = reshape.nest(witness)
    assert tree.schema.simpleString() == spark.createDataFrame([], schema.TREE).schema.simpleString()
    row = tree.collect()[0]
    assert [(v.name, v["index"]) for v in row.children] == [("hj", 1), ("gd", 2)]
    chapter = row.children[0].children[1]
    assert (chapter.name, chapter.description, chapter.sentence_count) == ("Chapter 1", "章节：第2章（编号：1）", 3)
    assert [s.sentence_number for s in chapter.children] == [2, 1, 1] and chapter.children[0].description == "章节1中的第3句"
    sinks.write_tree(tree, str(tmp_path / "tree.json"))
    back = reshape.flatten(sources.read_tree(spark, str(tmp_path / "tree.json")))
    key = ["version_idx", "version", "chapter_number", "sentence_number", "text"]
    assert sorted(map(tuple, back.select(*key).collect())) == sorted(map(tuple, witness.select(*key).collect()))
    assert reshape.nest(witness.limit(0)).collect()[0].children == []


def test_counts(witness):
    assert tuple(reshape.tree_counts(witness).first()) == (2, 4, 7)
    assert tuple(reshape.tree_counts(witness.limit(0)).first()) == (0, 0, 0)
    assert {(r.version, r.chapter_number, r.sentence_count) for r in reshape.chapter_counts(witness).collect()} == {("hj", 0, 1), ("hj", 1, 3), ("gd", 0, 1), ("gd", 1, 2)}


def test_workbooks(spark, sheet, tmp_path):
    path = str(tmp_path / "book.xlsx")
    assert sinks.write_xlsx(sheet.select("seg", "ln", "hj", "gd", "empty").orderBy("row_idx"), path) == len(SHEET)
    back = xlsx.read_xlsx(spark, path, required=("seg", "ln"))
    assert back.columns == ["seg", "ln", "hj", "gd", "empty"]
    assert [tuple(r) for r in back.collect()] == [tuple(None if c is None else str(c) for c in r) for r in SHEET]
    assert xlsx.read_xlsx(spark, path, na_values=["x", "無"]).where("gd = 'x' or hj = '無'").count() == 0
    assert list(xlsx.read_workbook(spark, path)) == ["Sheet1"]
    with pytest.raises(ValueError, match="no sheet other"):
        xlsx.read_workbook(spark, path, ["other"])
    with pytest.raises(ValueError, match="no column xx"):
        xlsx.read_xlsx(spark, path, required=("xx",))
    with pytest.raises(Exception, match="no sheet other"):
        xlsx.read_xlsx(spark, path, "other").collect()


def test_sheet_to_tree(spark, sheet, tmp_path):
    path = str(tmp_path / "book.xlsx")
    sinks.write_xlsx(sheet.drop("row_idx"), path)
    found = collation.sheet_to_witness(spark, path)
    assert {(r.version, r.chapter_number, r.sentence_number, r.text) for r in found.collect()} == {("hj", 0, 0, "上德"), ("gd", 0, 0, "上德"), ("hj", 1, 1, "名可名"), ("hj", 1, 1, ""), ("gd", 1, 1, "x"), ("hj", 1, 2, "道可道"), ("gd", 1, 2, "道可道也")}
    assert collation.sheet_to_tree(spark, path).count() == 1


def test_csv(spark, sheet, tmp_path):
    book = str(tmp_path / "a.xlsx")
    sinks.write_xlsx(sheet.drop("row_idx"), book)
    (out,) = sinks.workbook_to_csv(spark, book, index=True)
    data = open(out, "rb").read()
    assert data.startswith(b"\xef\xbb\xbf,seg,ln,hj") and data.count(b"\n") == len(SHEET) + 1
    assert spark.read.option("header", True).csv(out).count() == len(SHEET)
    assert sinks.folder_to_csv(spark, str(tmp_path)) == 1 and (tmp_path / "csv" / "a.csv").exists()
    sinks.write_csv(sheet.select("hj"), str(tmp_path / "g.csv"), encoding="gbk")
    assert open(tmp_path / "g.csv", encoding="gbk").read().startswith("hj\n")
    sinks.write_csv_parts(sheet.select("hj"), str(tmp_path / "parts"))
    assert spark.read.option("header", True).csv(str(tmp_path / "parts")).count() > 0


def test_json_arrays(spark, witness, tmp_path):
    pairs = collate.collate(witness).drop("script_error")
    path = str(tmp_path / "pairs.json")
    n = sinks.write_json_array(pairs, path)
    found = json.load(open(path, encoding="utf-8"))
    assert len(found) == n == pairs.count() > 0
    assert all("char" not in o for p in found for o in p["operations"] if o["type"] == "replace")
    back = sources.read_records(spark, path)
    assert back.count() == n and back.exceptAll(pairs.select(*back.columns)).count() == 0
    assert sinks.write_json_array(pairs.limit(0), path) == 0 and json.load(open(path)) == []


def test_matching_files_and_responses(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.json", "b.json", "c.txt", "sub/d.json"):
        (tmp_path / name).write_text('{"chapter_number": 1, "content": "x"}\n')
    assert sources.read_matching(spark, str(tmp_path), "*.json").count() == 2
    assert sources.read_responses(spark, str(tmp_path / "a.json"), "chapter_number int").collect()[0] == (1, "x")


@pytest.fixture(scope="module")
def g(witness):
    return graph.from_witness(witness).cached()


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_graph_of_a_tree(g, witness):
    assert ids(g.nodes) == sorted(["root", "version_hj", "version_gd", "chapter_hj_0", "chapter_hj_1", "chapter_gd_0", "chapter_gd_1", "sentence_hj_0_0", "sentence_hj_1_1", "sentence_hj_1_2", "sentence_gd_0_0", "sentence_gd_1_1", "sentence_gd_1_2"])
    assert g.nodes.where("id = 'sentence_hj_1_1'").first().text == ""
    assert tuple(graph.statistics(g).first()) == (13, 12, True, True, 1, 6)
    assert graph.max_depth(g).first()[0] == 3
    assert {(r.type, r.n, r.share) for r in graph.type_counts(g).collect()} == {("root", 1, 7.7), ("version", 2, 15.4), ("chapter", 4, 30.8), ("sentence", 6, 46.2)}
    assert [(r.version, r.n_chapters) for r in graph.chapters_per_version(g).collect()] == [("gd", 2), ("hj", 2)]


def test_lookups(g):
    row = graph.lookup(g, "chapter_hj_1").collect()[0]
    assert row.parents == ["version_hj"] and row.children == ["sentence_hj_1_1", "sentence_hj_1_2"] and row.node.type == "chapter"
    assert graph.lookup(g, "nothing").count() == 0
    assert ids(graph.neighbours(g, "version_gd")) == ["chapter_gd_0", "chapter_gd_1", "root"]


def test_prefix_of_a_version(spark):
    rows = [(i, v, 0, 0, 0, "t") for i, v in enumerate(["gd", "gd1", "hj"])]
    g = graph.from_witness(spark.createDataFrame(rows, schema.WITNESS))
    assert ids(graph.of_version(g, "gd")) == ["chapter_gd_0", "sentence_gd_0_0", "version_gd"]
    assert len(ids(graph.of_version(g, "gd", prefix=True))) == 6


def test_subgraphs(g):
    assert graph.subgraph(g, "nothing", 2) is None
    two = graph.subgraph(g, "root", 2)
    assert two.nodes.count() == 7 and two.edges.count() == 6
    assert ids(graph.subgraph(g, "root", 3, ("version", "sentence")).nodes) == ["root", "version_gd", "version_hj"]
    assert graph.structure_view(g).nodes.count() == 7 and graph.structure_view(g, 3).nodes.count() == 3
    assert len(ids(graph.version_view(g, "hj", 1, 1).nodes)) == 3
    assert ids(graph.version_view(g, "none").nodes) == []


def test_cycles_and_components(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("f", "f")], "source string, target string")
    found = Graph(nodes, edges)
    assert not graph.is_acyclic(found) and graph.is_acyclic(Graph(nodes, edges.where("source = 'd'"))) and graph.is_acyclic(Graph(nodes, edges.limit(0)))
    assert {r.id: r.component for r in graph.weak_components(found).collect()} == dict(zip("abcdef", "aaaddf", strict=True))


def test_generated_graphs(spark, tmp_path):
    corpus = graph.generated_corpus(spark)
    assert (corpus.nodes.count(), corpus.edges.count(), graph.dangling(corpus).count()) == (913, 924, 24)
    with pytest.raises(ValueError, match="24 ends"):
        graph.validate(corpus)
    whole = graph.from_node_link(corpus.nodes, corpus.edges)
    assert whole.nodes.count() == 937 and graph.roots(whole).count() == 13
    assert graph.weak_components(whole).select("component").distinct().count() == 13
    tree = graph.generated_tree(spark)
    assert (tree.nodes.count(), tree.edges.count(), graph.leaves(tree).count()) == (67, 66, 36)
    assert tree.nodes.where("id = 'node_0'").first().color == "#1f77b4"
    graph.validate(tree)
    assert sources.graph_or_sample(spark, lambda: sources.read_graph(spark, str(tmp_path / "none.json"))).nodes.count() == 67


def test_exports(spark, g, tmp_path):
    assert sinks.export_graph(g, str(tmp_path)) == {"graphml": None, "gml": None, "json": None}
    root = ElementTree.parse(tmp_path / "graph.graphml").getroot()
    space = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(list(root.iter(f"{space}node"))) == 13 and len(list(root.iter(f"{space}edge"))) == 12
    gml = (tmp_path / "graph.gml").read_text()
    assert gml.count("node [") == 13 and gml.count("edge [") == 12 and 'label "root"' in gml
    back = sources.read_graph(spark, str(tmp_path / "graph.json"))
    assert ids(back.nodes) == ids(g.nodes) and back.edges.count() == 12
    broken = Graph(g.nodes, g.edges.select(F.raise_error(F.lit("no")).alias("source"), "target"))
    found = sinks.export_graph(broken, str(tmp_path / "b"))
    assert all(found.values()) and len(found) == 3


def test_styles(g):
    found = {r.id: r.s for r in g.nodes.select("id", graph.style(F.col("type")).alias("s")).collect()}
    assert tuple(found["root"]) == ("#FF6B6B", 1000) and tuple(found["sentence_hj_0_0"]) == ("#F38181", 100)
    assert graph.enriched_edges(g).where("source_type = 'root' and target_type = 'version'").count() == 2


def test_plans(spark, witness, tmp_path):
    path = str(tmp_path / "tree.json")
    sinks.write_tree(reshape.nest(witness), path)
    pairs = collation.tree_to_pairs(spark, path)
    assert pairs.count() == 4 and collation.costed(pairs).where("custom_edit_distance is null").count() == 0
    none = spark.createDataFrame([], "chapter_number int, sentence_number int, original_text_version string, modified_text_version string, content string")
    ok, failed = collation.realigned(pairs, none, 0, 3)
    assert ok.count() + failed.count() == 3
    assert collation.tree_to_graph(spark, path).nodes.count() == 13


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"text": "。德", "original_text": "ab", "modified_text": "ac"}\n{"text": "12"}\n')
    stream = streaming.read_json_stream(spark, str(tmp_path / "in"), "text string, original_text string, modified_text string")
    out = streaming.script_stream(streaming.clean_stream(stream))
    q = out.writeStream.format("memory").queryName("cells").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    found = spark.table("cells").orderBy("text").collect()
    assert [(r.text, r.cleaned, r.edit_distance) for r in found] == [("12", None, None), ("。德", "德", 1)]
    assert found[1].operations[0].target_char == "c"


def test_pauses_and_errors(spark):
    def call(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    requests = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "")], "k int, prompt string").coalesce(1)
    began = time.monotonic()
    found = {r.k: (r.content, r.error) for r in answered(requests, ["k"], call, pause=0.2, attempts=2).collect()}
    assert found == {1: ("A", None), 2: (None, "ValueError: no"), 3: (None, None), 4: ("", None)}
    assert time.monotonic() - began >= 4 * 0.2


def test_order_without_one_window(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), F.lit(1).alias("range"), F.lit(2).alias("at"))
    found = reshape.by_order(df, ["a"], "row_idx")
    assert found.columns == ["a", "range", "at", "row_idx"] and found.where("a <> row_idx").count() == 0
    assert reshape.by_order(df.limit(0), ["a"], "row_idx").count() == 0
    assert reshape.numbered(df, by=["a"]).where("a <> row_idx").count() == 0


def test_cyclic_and_many_parents(spark):
    def graph_of(pairs, more=()):
        ids = sorted({x for p in pairs for x in p} | set(more))
        return graph.Graph(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "source string, target string"))

    path = [(f"n{i:03}", f"n{i + 1:03}") for i in range(6)]
    diamond = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]
    for pairs, wanted in ((path, True), (diamond, True), (path + diamond, True), ([*path, ("n006", "n002")], False), ([*diamond, ("d", "a")], False), ([("x", "x")], False), ([*path, ("x", "y"), ("y", "x")], False)):
        g = graph_of(pairs, ["alone"])
        assert graph.statistics(g).first()["is_acyclic"] is wanted is graph.is_acyclic(g)


@pytest.fixture
def tables(monkeypatch):
    """Counts the tables that graph operators write."""
    written = []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: (written.append(1), real(df))[1])
    return written


def _graph_of(spark, pairs, more=()):
    ids = sorted({x for p in pairs for x in p} | set(more))
    return Graph(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "source string, target string"))


def test_long_ways_cost_few_tables(spark, tables):
    n = 500
    ids = spark.range(n + 1).select(F.format_string("n%05d", "id").alias("id"))
    path = spark.range(n).select(F.format_string("n%05d", "id").alias("source"), F.format_string("n%05d", F.col("id") + 1).alias("target"))
    assert graph.max_depth(Graph(ids, path)).first()[0] == n and len(tables) <= 12
    found = graph.levels(Graph(ids, path), "n00100").orderBy("id").collect()
    assert [(r.id, r.level) for r in found[:2]] == [("n00100", 0), ("n00101", 1)] and len(found) == n - 99
    tables.clear()
    jump = spark.createDataFrame([("n00000", "n00250")], path.schema)
    assert graph.is_acyclic(Graph(ids, path.union(jump))) and len(tables) <= 16
    tables.clear()
    back = spark.createDataFrame([("n00480", "n00010")], path.schema)
    assert not graph.is_acyclic(Graph(ids, path.union(jump).union(back))) and len(tables) <= 50


def test_depth_with_cycles_and_foreign_ends(spark):
    pairs = [("r", "a"), ("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("r", "a")]
    g = _graph_of(spark, pairs, ["alone"])
    level = lambda *a, **k: {r.id: r.level for r in graph.levels(*a, **k).collect()}
    assert level(g, "r") == {"r": 0, "a": 1, "b": 2, "c": 3} and level(g, "alone") == {"alone": 0} and level(g, "none") == {}
    assert level(g, "y") == {"y": 0, "z": 1, "x": 2}
    only = Graph(g.nodes.where("id <> 'b'"), g.edges)
    assert level(only, "r") == {"r": 0, "a": 1} and level(only, "c") == {"c": 0} and level(only, "b") == {}
    typed = Graph(g.nodes.withColumn("type", F.when(F.col("id") == "b", "other").otherwise("own")), g.edges)
    assert level(typed, "r", types=("own",)) == {"r": 0, "a": 1} and level(typed, "b", types=("own",)) == {"b": 0, "c": 1}


def test_cycles_of_any_graph(spark):
    """Random graphs against a walk that takes away nodes without parents."""
    import random

    draw = random.Random(3)
    for size, edges, cyclic in ((8, 14, False), (8, 14, True)):
        pairs = {tuple(sorted(draw.sample(range(size), 2))) for _ in range(edges)}
        if cyclic:
            pairs |= {(b, a) for a, b in draw.sample(sorted(pairs), 1)}
        left = set(pairs)
        while any(rest := {(a, b) for a, b in left if a in {y for _, y in left}}) and rest != left:
            left = rest
        wanted = not left or not rest
        names = [(f"n{a:02}", f"n{b:02}") for a, b in sorted(pairs)]
        assert graph.is_acyclic(_graph_of(spark, names)) is wanted is not cyclic


def test_sheets_asked_for_one_at_a_time(spark, tmp_path):
    one = spark.createDataFrame([("a",)], "x string")
    path = str(tmp_path / "book.xlsx")
    sinks.write_workbook({"x": one, "y": one}, path)
    found = [sinks.workbook_to_csv(spark, path, sheets=[s])[0].rsplit("/", 1)[1] for s in ("x", "y")]
    assert found == ["book_x.csv", "book_y.csv"]


def test_parts_are_whole_documents(spark, tmp_path, monkeypatch):
    """Folders of documents of a few records each, written by tasks, read back as one file is."""
    rows = [(f"n{i:02}", "chapter", f'a "b" & <{i}>') for i in range(25)]
    nodes = spark.createDataFrame(rows, "id string, type string, name string").repartition(3)
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(24)] + [("n00", "gone")], "source string, target string")
    g = Graph(nodes, edges)
    monkeypatch.setattr(sinks._write_parts, "__defaults__", (4,))
    monkeypatch.setattr(type(nodes), "toLocalIterator", None)  # nothing streams through the driver
    sinks.write_node_link_parts(g, str(tmp_path / "link"))
    sinks.write_graphml_parts(g, str(tmp_path / "graphml"))
    sinks.write_gml_parts(g, str(tmp_path / "gml"))
    sinks.write_json_arrays(nodes, str(tmp_path / "json"))
    monkeypatch.undo()
    names = lambda kind: sorted((tmp_path / kind).glob("part-*"))
    assert all(len(names(kind)) >= 7 for kind in ("link", "graphml", "gml", "json"))
    assert sorted(x["id"] for f in names("json") for x in json.loads(f.read_text())) == [r[0] for r in rows]
    whole = [ElementTree.parse(f).getroot() for f in names("graphml")]
    assert sum(len(x.findall(".//{*}node")) for x in whole) == 25 and sum(len(x.findall(".//{*}edge")) for x in whole) == 25
    texts = [f.read_text() for f in names("gml")]
    assert all(t.count("[") == t.count("]") for t in texts) and sum(t.count("edge [") for t in texts) == 24
    number = {b: int(a) for t in texts for a, b in re.findall(r'id (\d+)\n    label "(n\d+)"', t)}
    assert number == {r[0]: i for i, r in enumerate(rows)}
    back = sources.read_graph(spark, str(tmp_path / "link"))
    assert sorted(r.id for r in back.nodes.collect()) == sorted([r[0] for r in rows] + ["gone"]) and back.edges.count() == 25
    assert back.nodes.where("id <> 'gone'").select("ordinal").distinct().count() == 25


def test_trees_in_parts(spark, tmp_path):
    rows = [(v, f"v{v}", c, s, 100 * v + 10 * c + s, f"t{s}") for v in (1, 2) for c in (3, 4) for s in range(7)]
    own = spark.createDataFrame(rows, "version_idx int, version string, chapter_number int, sentence_number int, row_idx long, text string")
    parts = reshape.nest_parts(own, most=5)
    assert parts.count() == 6
    sinks.write_trees(parts, str(tmp_path / "trees"))
    for found in (reshape.flatten(parts), reshape.flatten(sources.read_tree(spark, str(tmp_path / "trees")))):
        assert sorted(map(tuple, found.select("version", "chapter_number", "sentence_number", "text").collect())) == sorted((r[1], r[2], r[3], r[5]) for r in rows)
