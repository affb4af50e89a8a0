"""Property graphs as two tables: nodes (id, attributes) and edges (source, target)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variorum import schema
from variorum.operators import reshape, trees
from variorum.storage import discard, in_shuffle, materialize

TYPES = ("root", "version", "chapter", "sentence")
# Colours and sizes of nodes in the view of a structure and of one version.
STYLES = {
    "structure": {"root": ("#FF6B6B", 1000), "version": ("#4ECDC4", 500), "chapter": ("#95E1D3", 200), None: ("#F38181", 100)},
    "version": {"version": ("#FF6B6B", 1500), "chapter": ("#4ECDC4", 600), "sentence": ("#95E1D3", 300), None: ("#F38181", 200)},
}


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def cached(self) -> Graph:
        """The same graph as written tables, for what reads it again and again."""
        return Graph(materialize(self.nodes), materialize(self.edges))


def from_witness(witness: DataFrame, name: str = "道德经", description: str = "树状图根节点") -> Graph:
    """The graph of the tree that a witness table makes; nodes that share an id are one, with the last one's text."""
    c = F.col
    none = lambda kind: F.lit(None).cast(kind)

    def node(id_, type_, name_, description_, index=None, chapter=None, sentence=None, count=None, text=None, version=None):
        values = {"id": id_, "node_id": id_, "type": F.lit(type_), "name": name_, "description": description_, "index": index, "chapter_number": chapter, "sentence_number": sentence, "sentence_count": count, "text": text, "version": version}
        kinds = {"index": "int", "chapter_number": "int", "sentence_number": "int", "sentence_count": "long", "text": "string", "version": "string"}
        return [(v if v is not None else none(kinds[k])).alias(k) for k, v in values.items()]

    v, ch, s = c("version"), c("chapter_number"), c("sentence_number")
    version_id, chapter_id = F.concat(F.lit("version_"), v), F.concat_ws("_", F.lit("chapter"), v, ch)
    sentence_id = F.concat_ws("_", F.lit("sentence"), v, ch, s)
    chapters = witness.groupBy("version", "chapter_number").agg(F.min("version_idx").alias("version_idx"), F.count("*").alias("n"))
    versions = chapters.groupBy("version").agg(F.min("version_idx").alias("version_idx"))
    sentences = witness.groupBy("version", "chapter_number", "sentence_number").agg(F.max_by("text", "row_idx").alias("text"))
    one = witness.sparkSession.range(1)
    nodes = one.select(*node(F.lit("root"), "root", F.lit(name), F.lit(description)))
    nodes = nodes.union(versions.select(*node(version_id, "version", v, reshape.version_description(v), index=c("version_idx"))))
    nodes = nodes.union(chapters.select(*node(chapter_id, "chapter", F.concat(F.lit("Chapter "), ch), reshape.chapter_description(ch), chapter=ch, count=c("n"))))
    nodes = nodes.union(sentences.select(*node(sentence_id, "sentence", F.concat(F.lit("Sentence "), s), reshape.sentence_description(ch, s), chapter=ch, sentence=s, text=c("text"), version=v)))
    edges = versions.select(F.lit("root").alias("source"), version_id.alias("target"))
    edges = edges.union(chapters.select(version_id, chapter_id)).union(sentences.select(chapter_id, sentence_id))
    return Graph(nodes, edges)


def _typed(nodes: DataFrame) -> DataFrame:
    """(id, node_id, the attributes that operators know, ordinal, fields) of trees.merged()."""
    known = [a.split(" ") for a in schema.NODE_ATTRIBUTES.split(", ")]
    return nodes.select("id", F.col("id").alias("node_id"), *[trees.field(F.col("fields"), name, kind).alias(name) for name, kind in known], "ordinal", "fields")


def from_tree(tree: DataFrame) -> Graph:
    """The graph of a tree of any shape: all its nodes, with all their fields, and an edge from each parent.

    Nodes that share an id are one, with the last value of each field.  ordinal is the place in the tree, for nodes
    and, as that of the lower end, for edges.
    """
    made = trees.identified(tree)
    found = materialize(made)
    discard(made)
    edges = found.where("parent is not null").groupBy(F.col("parent").alias("source"), F.col("id").alias("target")).agg(F.min("ordinal").alias("ordinal"))
    return Graph(_typed(trees.merged(found)), edges)


def from_node_link(nodes: DataFrame, links: DataFrame) -> Graph:
    """A graph of node and link tables; ends of links that are no node become one, without attributes.

    With fields and ordinal, as read_node_link() gives them: nodes that share an id and links that share their ends
    are one, with the last value of each field, and nodes that only links name come after the others.
    """
    if "fields" not in nodes.columns:
        ends = links.select(F.col("source").alias("id")).union(links.select("target")).distinct()
        missing = ends.join(in_shuffle(nodes.select("id")), "id", "left_anti")
        own = nodes.dropDuplicates(["id"])
        return Graph(own.unionByName(missing, allowMissingColumns=True), links.select("source", "target").distinct())
    late = F.lit(1 << 60) + F.col("ordinal") * 2
    ends = links.select(F.col("source").alias("id"), late.alias("ordinal")).union(links.select("target", late + 1))
    missing = ends.groupBy("id").agg(F.min("ordinal").alias("ordinal")).join(in_shuffle(nodes.select("id")), "id", "left_anti")
    every = trees.merged(nodes).union(missing.select("id", "ordinal", F.create_map().cast(trees.FIELDS)))
    pair = trees.merged(links.select(F.struct("source", "target").alias("id"), "ordinal", "fields"))
    return Graph(_typed(every), pair.select("id.source", "id.target", "ordinal", "fields"))


# Lookups


def of_type(g: Graph, kind: str) -> DataFrame:
    return g.nodes.where(F.col("type") == kind)


def of_version(g: Graph, version: str, prefix: bool = False) -> DataFrame:
    """Nodes of one version; with prefix, also of versions whose names begin with it, as ids are matched by their start."""
    own = (F.col("version") == version) | ((F.col("type") == "version") & (F.col("name") == version))
    starts = [F.col("id").startswith(f"{kind}_{version}") for kind in TYPES[1:]]
    exact = [F.col("id") == f"version_{version}", F.col("id").startswith(f"chapter_{version}_"), F.col("id").startswith(f"sentence_{version}_")]
    for one in starts if prefix else exact:
        own = own | one
    return g.nodes.where(F.coalesce(own, F.lit(False)))


def parents(g: Graph, node_id: str) -> DataFrame:
    return g.nodes.join(g.edges.where(F.col("target") == node_id).select(F.col("source").alias("id")), "id", "left_semi")


def children(g: Graph, node_id: str) -> DataFrame:
    return g.nodes.join(g.edges.where(F.col("source") == node_id).select(F.col("target").alias("id")), "id", "left_semi")


def neighbours(g: Graph, node_id: str) -> DataFrame:
    """Nodes one edge away, either way."""
    near = g.edges.where(F.col("source") == node_id).select(F.col("target").alias("id")).union(g.edges.where(F.col("target") == node_id).select("source"))
    return g.nodes.join(near.distinct(), "id", "left_semi")


def lookup(g: Graph, node_id: str) -> DataFrame:
    """One row (node, parents, children) with sorted ids, or none for a node that is not there."""
    ids = lambda df: F.sort_array(F.collect_list("id"))
    node = g.nodes.where(F.col("id") == node_id).select(F.struct("*").alias("node"))
    up, down = parents(g, node_id), children(g, node_id)
    return node.join(up.agg(ids(up).alias("parents"))).join(down.agg(ids(down).alias("children")))


def enriched_edges(g: Graph) -> DataFrame:
    """Edges with the types of both ends."""
    types = g.nodes.select("id", "type")
    out = g.edges.join(types.withColumnsRenamed({"id": "source", "type": "source_type"}), "source", "left")
    return out.join(types.withColumnsRenamed({"id": "target", "type": "target_type"}), "target", "left").select("source", "target", "source_type", "target_type")


# Structure


def dangling(g: Graph) -> DataFrame:
    """(source, target, missing) for every end of a link that is no node; missing is source or target."""
    known = in_shuffle(g.nodes.select("id"))
    side = lambda which: g.edges.join(known, g.edges[which] == known["id"], "left_anti").select("source", "target", F.lit(which).alias("missing"))
    return side("source").union(side("target"))


def validation(g: Graph) -> DataFrame:
    """One row (n_missing, error): ends of links that are no nodes, and what validate() would raise, or null."""
    n = F.col("n_missing")
    return dangling(g).agg(F.count("*").alias("n_missing")).withColumn("error", F.when(n > 0, F.concat(n.cast("string"), F.lit(" ends of links are no nodes"))))


def validate(g: Graph) -> None:
    """An error with their number if ends of links are missing."""
    error = validation(g).first()["error"]
    if error:
        raise ValueError(error)


def roots(g: Graph) -> DataFrame:
    return g.nodes.join(in_shuffle(g.edges.select(F.col("target").alias("id"))), "id", "left_anti")


def leaves(g: Graph) -> DataFrame:
    return g.nodes.join(in_shuffle(g.edges.select(F.col("source").alias("id"))), "id", "left_anti")


def degrees(g: Graph) -> DataFrame:
    """(id, in_degree, out_degree) of every node."""
    ends = g.edges.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(g.edges.select("source", F.lit(0), F.lit(1)))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return g.nodes.select("id").join(in_shuffle(sums), "id", "left").select("id", zero("in_degree"), zero("out_degree"))


def _place(g: Graph) -> str:
    """The column that nodes are ordered by: their place in the file, where it is known."""
    return "ordinal" if "ordinal" in g.nodes.columns else "id"


def _heads(pointers: DataFrame) -> tuple[DataFrame, bool]:
    """(id, head, steps, done) of (id, up), where each id stands once, and whether every way ends.

    head is where the way up ends, a row without up, and steps their distance.  Each round doubles the reach of all
    pointers, so the rounds grow with the logarithm of the longest way.  A way that runs into a cycle has no end: a
    round that ends none is the last, and such rows are not done.
    """
    up = F.col("up")
    now = materialize(pointers.select("id", F.coalesce(up, "id").alias("head"), up.isNotNull().cast("long").alias("steps"), up.isNull().alias("done")))
    left = now.where("not done").count()
    while left:
        jump = now.select(F.col("id").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        far = now.where("not done").join(in_shuffle(jump), "head").select("id", F.col("next").alias("head"), F.col("steps") + F.col("more"), F.col("ends").alias("done"))
        before, now = now, materialize(now.where("done").union(far))
        discard(before)
        open_, left = left, now.where("not done").count()
        if left == open_:
            return now, False
    return now, True


def levels(g: Graph, start: str | None = None, most: int | None = None, types: tuple[str, ...] | None = None) -> DataFrame:
    """(id, level): edges from start, by default from the first root, by place in the file or else by id; walks stop at nodes of other types than given.

    Where no node has two parents and no most is given, pointers to ancestors double their reach each round; else each
    round is a level.
    """
    if start is None:
        first = roots(g).agg(F.min_by("id", _place(g))).first()[0]
        start = "root" if first is None else first
    allowed = g.nodes.select("id") if types is None else g.nodes.where(F.col("type").isin(*types)).select("id")
    if most is None:
        ids = g.nodes.select("id").distinct()
        ways = g.edges.select("source", "target").where(F.col("target") != start).distinct().join(allowed.select(F.col("id").alias("target")), "target", "left_semi")
        ways = materialize(ways.join(ids.select(F.col("id").alias("source")), "source", "left_semi"))
        if ways.groupBy("target").count().where("count > 1").isEmpty():
            found, _ = _heads(ids.join(ways.select(F.col("target").alias("id"), F.col("source").alias("up")), "id", "left"))
            discard(ways)
            return found.where(F.col("done") & (F.col("head") == start)).select("id", F.col("steps").cast("int").alias("level"))
        discard(ways)
    seen = materialize(g.nodes.where(F.col("id") == start).select("id", F.lit(0).alias("level")))
    rim, level = seen, 0
    while most is None or level < most:
        level += 1
        step = g.edges.join(rim.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        rim = materialize(step.join(allowed, "id", "left_semi").join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("level")))
        if rim.isEmpty():
            break
        seen = seen.union(rim)
    return seen


def max_depth(g: Graph) -> DataFrame:
    """(max_depth): the longest of the shortest ways from the first root."""
    return levels(g).agg(F.max("level").cast("long").alias("max_depth"))


def induced(g: Graph, ids: DataFrame) -> Graph:
    """The nodes with the given ids and the edges between them."""
    ids = ids.select("id").distinct()
    edges = g.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(g.nodes.join(ids, "id", "left_semi"), edges.select("source", "target"))


def subgraph(g: Graph, start: str, depth: int, types: tuple[str, ...] | None = None) -> Graph | None:
    """The induced graph of what start reaches in depth steps through the given types; None if start is no node."""
    found = levels(g, start, depth, types)
    return None if found.isEmpty() else induced(g, found)


def is_acyclic(g: Graph, n_components: int | None = None) -> bool:
    """Whether the edges make no cycle.

    Where the number of weak components is given, each node has at most one parent and no end is missing, counts
    decide: such a graph is a forest if it has as many edges as nodes beyond one a component.  Else a node with one
    parent is taken into it, whole chains and trees at a time by doubling pointers, which keeps every cycle; edges that
    come from nodes without parents go; and the next round does the same the other way round.  So long ways cost the
    logarithm of their length, and rounds count only levels of nodes with several parents and several children.
    """
    edges = materialize(g.edges.select("source", "target").distinct())
    n = edges.count()
    if n_components is not None and edges.groupBy("target").count().where("count > 1").isEmpty() and dangling(g).isEmpty():
        return n == g.nodes.count() - n_components
    still = 0  # rounds in a row that changed nothing
    while n:
        if not edges.where("source = target").isEmpty():
            return False
        by_target = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"), F.min("source").alias("low"))
        ids = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
        pointers = ids.join(in_shuffle(by_target), "id", "left").select("id", F.when(F.col("n") == 1, F.col("low")).alias("up"), F.col("n").isNull().alias("first"))
        pointers = materialize(pointers)
        heads, ends = _heads(pointers)
        if not ends:
            return False
        own = heads.select(F.col("id").alias("source"), "head").join(in_shuffle(pointers.where("not first").select(F.col("id").alias("head"))), "head", "left_semi")
        several = pointers.where("not first and up is null").select(F.col("id").alias("target"))
        kept = edges.join(in_shuffle(several), "target", "left_semi").join(in_shuffle(own), "source").select(F.col("target").alias("source"), F.col("head").alias("target")).distinct()
        before, edges = edges, materialize(kept)  # turned round
        for table in (before, pointers, heads):
            discard(table)
        left = edges.count()
        still = still + 1 if left == n else 0
        if still == 2:
            return False
        n = left
    return True


def weak_components(g: Graph) -> DataFrame:
    """(id, component): the smallest id that edges, either way, connect a node with."""
    ends = g.edges.where("source <> target")
    both = materialize(ends.select("source", "target").union(ends.select("target", "source")).distinct())
    first = both.groupBy(F.col("source").alias("id")).agg(F.min("target").alias("low"))
    labels = now = materialize(g.nodes.select("id").join(in_shuffle(first), "id", "left").select("id", F.least("id", "low").alias("component")))
    while True:
        near = both.join(in_shuffle(labels), F.col("target") == F.col("id")).groupBy("source").agg(F.min("component").alias("low"))
        lower = labels.join(in_shuffle(near), F.col("id") == F.col("source"), "left").select("id", F.col("component").alias("old"), F.least("component", "low").alias("c"))
        jump = labels.select(F.col("id").alias("at"), F.col("component").alias("next"))
        before, now = now, materialize(lower.join(in_shuffle(jump), F.col("c") == F.col("at")).select("id", F.least("c", "next").alias("component"), (F.least("c", "next") < F.col("old")).alias("moved")))
        discard(before)
        labels = now.select("id", "component")
        if now.where("moved").isEmpty():
            discard(both)
            return labels


def statistics(g: Graph) -> DataFrame:
    """One row (n_nodes, n_edges, is_acyclic, is_connected, n_roots, n_leaves)."""
    g = g.cached()
    n = weak_components(g).select("component").distinct().count()
    row = g.nodes.agg(F.count("*").alias("n_nodes")).join(g.edges.agg(F.count("*").alias("n_edges")))
    row = row.join(roots(g).agg(F.count("*").alias("n_roots"))).join(leaves(g).agg(F.count("*").alias("n_leaves")))
    return row.select("n_nodes", "n_edges", F.lit(is_acyclic(g, n)).alias("is_acyclic"), F.lit(n == 1).alias("is_connected"), "n_roots", "n_leaves")


def type_counts(g: Graph) -> DataFrame:
    """(type, n, share): nodes of each type, and their share in per cent to one decimal."""
    counts = g.nodes.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))
    return counts.join(counts.agg(F.sum("n").alias("total"))).select("type", "n", F.round(F.col("n") * 100 / F.col("total"), 1).alias("share")).orderBy("type")


def chapters_per_version(g: Graph) -> DataFrame:
    """(version, n_chapters), by the edges from versions to chapters."""
    own = g.edges.join(of_type(g, "version").select(F.col("id").alias("source"), F.col("name").alias("version")), "source")
    chapters = own.join(of_type(g, "chapter").select(F.col("id").alias("target")), "target", "left_semi")
    return chapters.groupBy("version").agg(F.count("*").alias("n_chapters")).orderBy("version")


def samples(g: Graph, n: int = 10, children: bool = False) -> DataFrame:
    """(kind, id, target): the first n leaves, versions, chapters and edges, and, if asked for, children of the first root.

    They come in the order of the file, where it is known, edges by their upper ends first; else by id.  target is
    null but for edges.
    """
    none = F.lit(None).cast("string").alias("target")
    first = lambda df: df.orderBy(_place(g)).limit(n).select("kind", "id", "target")
    named = [("leaf", leaves(g)), ("version", of_type(g, "version")), ("chapter", of_type(g, "chapter"))]
    if children:
        top = roots(g).orderBy(_place(g)).limit(1).select(F.col("id").alias("source"))
        below = g.edges.join(F.broadcast(top), "source", "left_semi").select(F.col("target").alias("id"))  # of one row
        named.append(("child", g.nodes.join(in_shuffle(below), "id", "left_semi")))
    edges = g.edges.select(F.lit("edge").alias("kind"), F.col("source").alias("id"), "target", *(["ordinal"] if "ordinal" in g.edges.columns else []))
    if "ordinal" in g.edges.columns:
        edges = edges.join(in_shuffle(g.nodes.select("id", F.col("ordinal").alias("upper"))), "id").orderBy("upper", "ordinal")
    else:
        edges = edges.orderBy("id", "target")
    out = edges.limit(n).select("kind", "id", "target")
    for kind, nodes in named:
        out = out.union(first(nodes.select(F.lit(kind).alias("kind"), *dict.fromkeys(("id", _place(g))), none)))
    return out


# Views


def structure_view(g: Graph, most_nodes: int = 500) -> Graph:
    """Root, versions and chapters; only one step from the root if that is more than most_nodes."""
    two = subgraph(g, "root", 2, TYPES[:3])
    if two is None or two.nodes.limit(most_nodes + 1).count() <= most_nodes:
        return two
    return subgraph(g, "root", 1, TYPES[:3])


def version_view(g: Graph, version: str, most_chapters: int = 10, most_sentences: int = 3) -> Graph:
    """A version, its first chapters and the first sentences of each."""
    head = of_type(g, "version").where(F.col("name") == version).select("id")
    below = lambda ids, kind: g.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(of_type(g, kind).select(F.col("id").alias("target"), "chapter_number", "sentence_number"), "target")
    first = lambda df, n, *by: df.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(*by))).where(F.col("r") <= n).select(F.col("target").alias("id"))
    chapters = first(below(head, "chapter"), most_chapters, "chapter_number")
    sentences = first(below(chapters, "sentence"), most_sentences, "sentence_number")
    return induced(g, head.union(chapters).union(sentences))


def first_sentences(witness: DataFrame, n: int = 3) -> DataFrame:
    """The first n sentences of each chapter of each version, in row order."""
    order = Window.partitionBy("version", "chapter_number").orderBy("row_idx", "sentence_number")
    return witness.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def style(kind: Column, view: str = "structure") -> Column:
    """struct<color, size> of a node of the given type."""
    own = STYLES[view]
    pick = lambda k: F.struct(F.lit(own[k][0]).alias("color"), F.lit(own[k][1]).alias("size"))
    out = F
    for k in own:
        if k is not None:
            out = out.when(kind == k, pick(k))
    return out.otherwise(pick(None))


# Generators


def generated_corpus(spark: SparkSession, versions: int = 12, chapters: int = 75) -> Graph:
    """A root, versions and chapters; links name chapters 0 to chapters, nodes 2 to chapters + 1, so two of each version dangle."""
    # Codes and columns of the versions, and the wording of names.
    codes = ["hj", "gd", "gd1", "gd2", "gd3", "ba", "bb", "wb", "hs", "yz", "xr", "fy"]
    lines = ["C", "D", "E", "F", "G", "h", "I", "J", "K", "L", "M", "N"]
    at = lambda values: F.get(F.array(*[F.lit(x) for x in values]), (F.col("v") - 1).cast("int"))
    s = lambda c: F.col(c).cast("string")
    vs = spark.range(1, versions + 1).withColumnRenamed("id", "v")
    cs = vs.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chapters))))
    version_id = F.concat(F.lit("version"), s("v"))
    title = F.concat(F.lit("版本"), s("v"), F.lit("第"), s("c"), F.lit("章"))
    nodes = spark.range(1).select(F.lit("root").alias("id"), F.lit("道德经").alias("name"), F.lit("作者：老子").alias("description"), F.lit(None).cast("string").alias("line"))
    nodes = nodes.union(vs.select(version_id, F.concat(F.lit("版本"), s("v")), at(codes), at(lines)))
    nodes = nodes.union(cs.where("c > 0").select(F.concat(F.lit("chapter"), s("v"), F.lit("_"), (F.col("c") + 1).cast("string")), title, title, F.lit("A")))
    edges = vs.select(F.lit("root").alias("source"), version_id.alias("target")).union(cs.select(version_id, F.concat(F.lit("chapter"), s("v"), F.lit("_"), s("c"))))
    return Graph(nodes, edges)


def generated_tree(spark: SparkSession, branching: tuple[int, ...] = (3, 3, 2, 2)) -> Graph:
    """A tree with the given number of children on each level; ids are numbered in pre-order, colours go by level."""
    # Ten colours of a public palette, and the wording of names.
    colours = ["#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf"]
    below = [1] * (len(branching) + 1)  # nodes of a subtree with its root on each level
    for i in reversed(range(len(branching))):
        below[i] = 1 + branching[i] * below[i + 1]
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("up"), F.lit(0).alias("level"), F.lit(0).alias("i"))
    layer = nodes
    for level, width in enumerate(branching):
        child = layer.select(F.col("n").alias("up"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i"))
        layer = child.select((F.col("up") + 1 + F.col("i") * below[level + 1]).cast("long").alias("n"), "up", F.lit(level + 1).alias("level"), "i")
        nodes = nodes.union(layer)
    node_id = lambda c: F.concat(F.lit("node_"), F.col(c).cast("string"))
    level = F.col("level").cast("string")
    name = F.when(F.col("level") == 0, "根节点").otherwise(F.concat(F.lit("第"), level, F.lit("层节点"), F.char(F.col("i") + 65)))
    about = F.when(F.col("level") == 0, "树的根节点").otherwise(F.concat(F.lit("第 "), level, F.lit(" 层的第 "), (F.col("i") + 1).cast("string"), F.lit(" 个子节点")))
    colour = F.get(F.array(*[F.lit(c) for c in colours]), F.col("level") % 10)
    return Graph(nodes.select(node_id("n").alias("id"), name.alias("name"), about.alias("description"), colour.alias("color")), nodes.where("up is not null").select(node_id("up").alias("source"), node_id("n").alias("target")))
