import pytest
from pyspark.sql import functions as F

from variorum.functions import text

CELLS = [
    (None, None), ("，上德不德。", "上德不德"), ("，上，德。", "上，德"), ("，。", ""), (" 。德", " 。德"), ("'德'", "'德'"), ("123", None), ("１２", None),
    ("(3)", None), ("（3）", "3"), ("，123", "123"), ("100%", "100"), ("12.0", "12.0"), ("第1条", None), ("a1", None), ("1a", None),
    ("1a\nzz", None), ("a1\nzz", "a1\nzz"), ("SPC_ORD", None), ("SPC_INFO", None), ("SPC_ORDx", "SPC_ORDx"), ("", ""), ("  12 ", None), (" 德 ", " 德 "),
    ("(３)", None), ("\\~德•", "德"), (",德.", ",德."), ("12\n", None),
]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CELLS)], "i int, cell string")


def test_clean_cells(cells):
    found = {r.i: r.c for r in cells.select("i", text.clean_cell(F.col("cell")).alias("c")).collect()}
    assert found == {i: c for i, (_, c) in enumerate(CELLS)}


def test_cleaning_twice_differs(cells):
    once = text.clean_cell(F.col("cell"))
    found = {r.i: r.c for r in cells.select("i", text.clean_cell(once).alias("c")).collect()}
    assert found[10] is None and found[11] is None


def test_counts(cells):
    wanted = sum(a != b for a, b in CELLS)
    assert text.clean_counts(cells, ["cell"]).collect()[0].n_changed == wanted
    assert [r.n_changed for r in text.clean_counts(cells.limit(0), ["cell"]).collect()] == [0]


def test_default_columns(spark):
    wide = spark.createDataFrame([("1", "2", *["。德"] * 14)], [f"c{i}" for i in range(16)])
    row = text.clean_columns(wide).collect()[0]
    assert row == ("1", "2", *["德"] * 12, "。德", "。德")
    narrow = spark.createDataFrame([("1", "2", "。德")], "a string, b string, c string")
    assert text.clean_columns(narrow).collect()[0] == ("1", "2", "德")


def test_strip_follows_unicode(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    df = spark.createDataFrame([(s,) for s in spaces], "s string").select("s", text.strip(F.concat("s", F.lit("a b"), "s", "s")).alias("t"))
    assert {r.t for r in df.collect()} == {"a b"}


def test_own_patterns(cells):
    assert cells.where(text.is_special(F.col("cell"), ["德"])).count() == 1
    assert cells.where(text.is_special(F.col("cell"), [])).count() == 0


def test_column_letters(spark):
    assert [text.column_letter(i) for i in (0, 25, 26, 51, 52, 701, 702, 18277)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ZZZ"]
    found = spark.range(3000).select("id", text.column_letter_of(F.col("id")).alias("c")).collect()
    assert all(r.c == text.column_letter(r.id) for r in found)


def test_labels(spark):
    df = spark.createDataFrame([("a" * 15, "b" * 10), ("a" * 16, "b" * 11), (None, "")], "n string, t string")
    got = [tuple(r) for r in df.select(text.structure_label(F.col("n")), text.sentence_label(F.col("t")), text.label_or_id(F.col("t"), F.lit("id"))).collect()]
    assert got == [("a" * 15, "b" * 10, "b" * 10), ("a" * 12 + "...", "b" * 8 + "...", "b" * 11), (None, "", "id")]


def test_id_parts(spark):
    df = spark.createDataFrame([("chapter_gd_3",)], "id string")
    assert tuple(df.select(text.id_part(F.col("id"), 1), text.id_part(F.col("id"), -1), text.id_part(F.col("id"), 7)).collect()[0]) == ("gd", "3", None)


def test_patterns_that_are_no_regular_expressions(spark):
    cells = spark.createDataFrame([("(",), (" ( ",), ("x(",), ("a)|(b",), ("12",), ("[",), (None,)], "cell string")
    found = {r.cell: r.s for r in cells.select("cell", text.is_special(F.col("cell"), ["(", "a)|(b", r"\d+"]).alias("s")).collect()}
    assert found == {"(": True, " ( ": True, "x(": False, "a)|(b": True, "12": True, "[": False, None: None}
    assert cells.where(text.is_special(F.col("cell"), ["["])).count() == 1
