"""Wide sheets, the canonical witness table and the nested tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variorum.functions.text import strip
from variorum.storage import materialize

KEYS = ("seg", "ln")


#: Rows that a task sorts at once, about, whatever the session's number of shuffle partitions.
ROWS_A_TASK = 500_000


def shares(spark: SparkSession, rows: int) -> int | None:
    """Partitions that leave ROWS_A_TASK rows to a task; none where the session's number of shuffle partitions does."""
    wanted = -(-rows // ROWS_A_TASK)
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(rows: DataFrame, among: int | None, *keys: str) -> DataFrame:
    """rows by hash of keys among so many partitions; as they are for none."""
    return rows if among is None else rows.repartition(among, *keys)


def by_order(rows: DataFrame, order: list[str], name: str, among: int | None = None) -> DataFrame:
    """rows with a last column name, their place from 0 in the given order; rows that tie come in any order.

    Rows are dealt by ranges of the order and sorted within; a row's place is that in its range after the rows of the
    ranges before, so no task sees all rows.  The ranges are a written table, so places hold when a task is repeated.
    among is the number of ranges, as shares() gives it; the session's for none.
    """
    dealt = rows.repartitionByRange(*([] if among is None else [among]), *order).sortWithinPartitions(*order)
    row, at = F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = materialize(dealt.select(row.alias("row"), F.spark_partition_id().alias("range"), at.alias("at")))
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    return ranges.join(before, "range").select("row.*", (F.col("before") + F.col("at")).alias(name))


def running(rows: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """rows with a last column name, the sum of weight over the rows before in the given order, by ranges as by_order."""
    dealt = rows.repartitionByRange(*order)
    ranges = materialize(dealt.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.spark_partition_id().alias("range")))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("range").agg(F.sum(f"row.{weight}").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(upto(Window.orderBy("range"))), F.lit(0)).alias("before"))  # a row a range
    inner = F.coalesce(F.sum(f"row.{weight}").over(upto(Window.partitionBy("range").orderBy(*[f"row.{c}" for c in order]))), F.lit(0))
    return ranges.select("row", "range", inner.alias("at")).join(F.broadcast(before), "range").select("row.*", (F.col("before") + F.col("at")).alias(name))


def numbered(sheet: DataFrame, by: list[str] | None = None) -> DataFrame:
    """sheet with row_idx, the position of each row: by the given columns, else as the source delivers rows."""
    if "row_idx" in sheet.columns:
        return sheet
    if by:
        return by_order(sheet, by, "row_idx")
    return sheet.withColumn("row_idx", F.monotonically_increasing_id())


def versions_of(sheet: DataFrame) -> list[str]:
    """All columns that are neither keys nor the row's position, in the sheet's order."""
    missing = [k for k in KEYS if k not in sheet.columns]
    if missing:
        raise ValueError(f"the sheet has no column {', '.join(missing)}")
    return [c for c in sheet.columns if c not in (*KEYS, "row_idx")]


def unpivot(sheet: DataFrame, empty_as_null: bool = False) -> DataFrame:
    """The witness table of a wide sheet: a row for each cell that is not null, white space stripped.

    version_idx is the column's position from 1, also past versions without cells.  With empty_as_null, cells without
    characters count as null, as they do after a round trip through a spreadsheet file.  Rows without a key are left
    to quarantine().
    """
    versions = versions_of(sheet)
    text = [F.col(f"`{v}`").cast("string").alias(v) for v in versions]
    kept = numbered(sheet).where("seg is not null and ln is not null").select("seg", "ln", "row_idx", *text)
    long = kept.unpivot(["seg", "ln", "row_idx"], versions, "version", "text")
    cell = F.nullif("text", F.lit("")) if empty_as_null else F.col("text")
    index = F.array_position(F.array(*[F.lit(v) for v in versions]), F.col("version")).cast("int")
    return long.where(cell.isNotNull()).select(index.alias("version_idx"), "version", F.col("seg").cast("int").alias("chapter_number"), F.col("ln").cast("int").alias("sentence_number"), "row_idx", strip(F.col("text")).alias("text"))


def quarantine(sheet: DataFrame) -> DataFrame:
    """Rows with a text but without a chapter or sentence number."""
    texts = [F.col(f"`{v}`") for v in versions_of(sheet)]
    return numbered(sheet).where("seg is null or ln is null").where(F.coalesce(*[t.cast("string") for t in texts]).isNotNull())


# The wording of names and descriptions in trees and graphs.


def chapter_description(n: Column) -> Column:
    return F.concat(F.lit("章节：第"), n + 1, F.lit("章（编号："), n, F.lit("）"))


def sentence_description(chapter: Column, sentence: Column) -> Column:
    return F.concat(F.lit("章节"), chapter, F.lit("中的第"), sentence + 1, F.lit("句"))


def version_description(version: Column) -> Column:
    return F.concat(F.lit("书本版本："), version)


# The root's name and description in the sheet's tree; graphs of the text itself name it 道德经.
ROOT = ("root", "树状图根节点")


def nest_parts(witness: DataFrame, most: int = 10_000, name: str = ROOT[0], description: str = ROOT[1]) -> DataFrame:
    """nest() as several trees, of most sentences each: stretches of the tree as it is read, each under its own root.

    No task sees more than one stretch.  A chapter that is cut stands in two trees, with the count of each.
    """
    placed = by_order(witness, ["version_idx", "version", "chapter_number", "row_idx", "sentence_number"], "__place")
    return _nested(placed.withColumn("__part", F.floor(F.col("__place") / most)), name, description, ["__part"])


def nest(witness: DataFrame, name: str = ROOT[0], description: str = ROOT[1]) -> DataFrame:
    """One row, the tree: versions in column order, chapters ascending, sentences in row order; always one row.

    A tree is one value by its nature, so all of the text meets in the last aggregate: for exports, not for analysis,
    which works on the witness table.  nest_parts() makes several trees.
    """
    return _nested(witness, name, description, [])


def _nested(witness: DataFrame, name: str, description: str, part: list[str]) -> DataFrame:
    c = F.col
    sentence = F.struct(
        F.concat(F.lit("Sentence "), c("sentence_number")).alias("name"),
        F.lit("sentence").alias("type"),
        sentence_description(c("chapter_number"), c("sentence_number")).alias("description"),
        "chapter_number",
        "sentence_number",
        F.coalesce("text", F.lit("")).alias("text"),
        "version",
    )
    in_order = lambda what, *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, what.alias("node")))), lambda x: x["node"])
    chapters = witness.groupBy(*part, "version_idx", "version", "chapter_number").agg(in_order(sentence, "row_idx", "sentence_number").alias("children"))
    chapter = F.struct(
        F.concat(F.lit("Chapter "), c("chapter_number")).alias("name"),
        F.lit("chapter").alias("type"),
        chapter_description(c("chapter_number")).alias("description"),
        "chapter_number",
        F.size("children").alias("sentence_count"),
        "children",
    )
    versions = chapters.groupBy(*part, "version_idx", "version").agg(in_order(chapter, "chapter_number").alias("children"))
    version = F.struct(c("version").alias("name"), F.lit("version").alias("type"), version_description(c("version")).alias("description"), c("version_idx").alias("index"), "children")
    root = versions.groupBy(*part).agg(in_order(version, "version_idx").alias("children"))
    return root.select(F.lit(name).alias("name"), F.lit("root").alias("type"), F.lit(description).alias("description"), F.coalesce("children", F.array()).alias("children"))


def flatten(tree: DataFrame) -> DataFrame:
    """The witness table of a tree: its sentences in pre-order; row_idx numbers those of a version.

    A VARIANT tree may have any shape: see trees.sentences().  A tree with typed columns, as nest() makes it, can only
    hold sentences below chapters below versions.
    """
    if "tree" in tree.columns:
        from variorum.operators.trees import sentences  # needs this module's order

        return sentences(tree)
    versions = tree.select(F.posexplode("children").alias("v", "version_node"))
    chapters = versions.select("v", "version_node.name", F.posexplode("version_node.children").alias("c", "chapter"))
    sentences = chapters.select("v", "name", "c", F.posexplode("chapter.children").alias("s", "n"))
    found = sentences.where("n.type = 'sentence' and n.chapter_number is not null and n.sentence_number is not null")
    return found.select(
        (F.col("v") + 1).alias("version_idx"),
        F.coalesce("n.version", "name").alias("version"),
        "n.chapter_number",
        "n.sentence_number",
        (F.col("c").cast("long") * F.lit(1 << 32) + F.col("s")).alias("row_idx"),
        F.coalesce("n.text", F.lit("")).alias("text"),
    )


def distinct_chapters(witness: DataFrame) -> DataFrame:
    """(version, chapter_number), sorted."""
    return witness.select("version", "chapter_number").distinct().orderBy("version", "chapter_number")


def chapter_counts(witness: DataFrame) -> DataFrame:
    """(version, chapter_number, sentence_count)."""
    return witness.groupBy("version", "chapter_number").agg(F.count("*").alias("sentence_count"))


def tree_counts(witness: DataFrame) -> DataFrame:
    """(n_versions, n_chapters, n_sentences) of the tree that the witness table makes."""
    chapters = witness.groupBy("version", "chapter_number").agg(F.count("*").alias("n"))
    return chapters.agg(F.countDistinct("version").alias("n_versions"), F.count("*").alias("n_chapters"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_sentences"))
