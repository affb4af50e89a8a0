"""The stages in a row: sheet to tree, tree to pairs, pairs to costs and realignments, tree to graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.functions.text import clean_columns
from variorum.operators import collate, cost, graph, realign, reshape
from variorum.sources.files import read_tree
from variorum.sources.xlsx import read_xlsx
from variorum.streaming import annotation


def sheet_to_witness(spark: SparkSession, path: str, sheet: str | None = None, clean: bool = True) -> DataFrame:
    """A workbook's sheet, numbered, cleaned and unpivoted; cells that cleaning empties count as missing."""
    found = read_xlsx(spark, path, sheet, required=reshape.KEYS)
    if clean:
        found = clean_columns(found)
    return reshape.unpivot(reshape.numbered(found), empty_as_null=clean)


def sheet_to_tree(spark: SparkSession, path: str, sheet: str | None = None, clean: bool = True) -> DataFrame:
    return reshape.nest(sheet_to_witness(spark, path, sheet, clean))


def tree_to_pairs(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pair records of a tree file, with their index."""
    witness = reshape.flatten(read_tree(spark, path))
    return collate.pair_index(collate.collate(witness, **options), witness)


def costed(pairs: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    return cost.cost_pairs(pairs, responses)


def realigned(pairs: DataFrame, responses: DataFrame, start: int = 0, end: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted pairs and dead letters of a slice of the pairs."""
    part = collate.index_slice(pairs, start, end) if "pair_index" in pairs.columns else pairs
    done = realign.realign(part, responses)
    return realign.accepted(done), realign.rejected(done)


def realigned_by(pairs: DataFrame, call: Callable[[str], str], folder: str, attempts: int = 2, **options) -> tuple[DataFrame, DataFrame]:
    """Accepted pairs and dead letters by what call answers; with the same folder a run that was stopped goes on.

    Replies that do not lead from one text to the other are asked again with their error.  options are those of
    streaming.annotation.run().
    """
    replies = annotation.run(realign.requests(pairs), realign.KEYS, call, folder, attempts, realign.checked(pairs), realign.again, **options)
    done = realign.realign(pairs, replies)
    failed = replies.where("error is not null").select(*realign.KEYS, F.col("error").alias("__error"))
    done = done.join(failed, realign.KEYS, "left").withColumn("error", F.coalesce("__error", "error")).drop("__error")
    return realign.accepted(done), realign.rejected(done)


def tree_to_graph(spark: SparkSession, path: str) -> graph.Graph:
    return graph.from_tree(read_tree(spark, path))
