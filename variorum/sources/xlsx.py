"""A data source for spreadsheets: ``spark.read.format("xlsx")``, on the standard library alone.

Options: ``path``, a file; ``sheet``, a name (default: the first); ``naValues``,
comma-separated texts that count as missing (default: the empty text alone).
All columns are strings, as the file has them; whole numbers have no point.
``inferred`` gives columns of numbers their type.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _open(path: str) -> zipfile.ZipFile:
    fs, where = pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)
    with fs.open_input_stream(where) as f:
        return zipfile.ZipFile(io.BytesIO(f.read()))


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = rels[s.get(f"{_REL}id")]
        out[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return out


def sheet_names(path: str) -> list[str]:
    with _open(path) as book:
        return list(_sheets(book))


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _grid(path: str, sheet: str | None) -> list[list[str | None]]:
    with _open(path) as book:
        sheets = _sheets(book)
        if sheet and sheet not in sheets:
            raise ValueError(f"{path} has no sheet {sheet}; it has {', '.join(sheets)}")
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        rows = []
        for row in ElementTree.fromstring(book.read(sheets[sheet or next(iter(sheets))])).iter(f"{_MAIN}row"):
            at = int(row.get("r") or len(rows) + 1) - 1
            rows += [[] for _ in range(at + 1 - len(rows))]
            for i, cell in enumerate(row.iter(f"{_MAIN}c")):
                column = _column(cell.get("r")) if cell.get("r") else i
                rows[at] += [None] * (column + 1 - len(rows[at]))
                rows[at][column] = _value(cell, shared)
        return rows


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    if kind == "n" and re.fullmatch(r"-?\d+\.0+", v.text):
        return v.text.partition(".")[0]
    return v.text


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        rows = _grid(self.options["path"], self.options.get("sheet"))
        out = StructType()
        for i, name in enumerate(rows[0] if rows else []):
            out = out.add(name if name else f"Unnamed: {i}", StringType())
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(dict(self.options), schema)


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.options["path"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        missing = set(self.options.get("navalues", "").split(",")) | {""}
        header, *rows = _grid(partition.value, self.options.get("sheet")) or [[]]
        at = {n if n else f"Unnamed: {i}": i for i, n in enumerate(header)}
        places = [at[f.name] for f in self.schema]
        for row in rows:
            cells = [row[p] if p < len(row) else None for p in places]
            if any(c is not None for c in cells):
                yield tuple(None if c in missing else c for c in cells)


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, na_values: list[str] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """One sheet; an error if a required column is missing."""
    spark.dataSource.register(XlsxSource)
    reader = spark.read.format("xlsx").option("path", path)
    reader = reader.option("sheet", sheet) if sheet else reader
    found = (reader.option("naValues", ",".join(na_values)) if na_values else reader).load()
    missing = [c for c in required if c not in found.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return found


def inferred(sheet: DataFrame) -> DataFrame:
    """sheet with columns of whole numbers as long and of other numbers as double, in one pass over it; a column without values stays."""
    kinds = {"long": r"-?[0-9]{1,18}", "double": r"-?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?"}
    tests = [F.min(F.col(f"`{c}`").rlike(rf"\A{pattern}\z")).alias(f"{k}.{i}") for i, c in enumerate(sheet.columns) for k, pattern in kinds.items()]
    held = sheet.agg(*tests).first() if tests else {}
    kind = lambda i: next((k for k in kinds if held[f"{k}.{i}"]), "string")
    return sheet.select(*[F.col(f"`{c}`").cast(kind(i)).alias(c) for i, c in enumerate(sheet.columns)])


def read_workbook(spark: SparkSession, path: str, sheets: list[str] | None = None) -> dict[str, DataFrame]:
    """Sheets by name: all, or the named ones, which must exist."""
    known = sheet_names(path)
    missing = [s for s in sheets or [] if s not in known]
    if missing:
        raise ValueError(f"{path} has no sheet {', '.join(missing)}")
    return {s: read_xlsx(spark, path, s) for s in sheets or known}
