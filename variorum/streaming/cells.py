"""Cleaning and replay on streams: the same column expressions, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.functions.text import clean_cell
from variorum.operators.edit_script import edit_script


def clean_stream(cells: DataFrame, column: str = "text") -> DataFrame:
    """A stream of cells with a last column cleaned."""
    return cells.withColumn("cleaned", clean_cell(F.col(column)))


def script_stream(pairs: DataFrame, source: str = "original_text", target: str = "modified_text") -> DataFrame:
    """A stream of pairs with edit_distance and operations."""
    done = pairs.withColumn("script", edit_script(F.col(source), F.col(target)))
    return done.withColumns({"edit_distance": F.levenshtein(source, target), "operations": F.col("script.operations")}).drop("script")


def read_json_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)
