"""Cell cleaning and labels, as column expressions."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that are trimmed from either end of a cell.
PUNCTUATION = "=，。、；：！？\"（）%【】《》〈〉「」『』〔〕｛｝〖〗·…—•~\\"

# What a whole cell must match to be emptied; $ closes the last alternative only.
SPECIAL = [
    "SPC_ORD",
    r"^\d+$",
    r"\(\d+\)",
    "SPC_INFO",
    r".*\d.*[a-zA-Z一-鿿].*|.*[a-zA-Z一-鿿].*\d.*",
]

#: White space as Unicode has it, with the four separators that Java leaves out.
_SPACE = r"[\s\x1c-\x1f]+"


def trim_punct(text: Column, characters: str = PUNCTUATION) -> Column:
    """text without the characters at either end; white space is none of them and shields what it encloses."""
    return F.btrim(text, F.lit(characters))


def strip(text: Column) -> Column:
    """text without Unicode white space at either end."""
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}|{_SPACE}\z", "")


def _compiles(pattern: str) -> bool:
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def is_special(text: Column, patterns: list[str] | None = None) -> Column:
    """Whether a cell, without outer white space, matches a pattern from its start to the end of the last alternative.

    A pattern that is no regular expression is compared as it stands.
    """
    given = SPECIAL if patterns is None else patterns
    good = [p for p in given if _compiles(f"{p}$")]
    found = strip(text).rlike(rf"(?dU)\A(?:{'|'.join(f'(?:{p}$)' for p in good)})") if good else F.lit(False)
    broken = [p for p in given if p not in good]
    return found | strip(text).isin(*broken) if broken else found


def null_special(text: Column, patterns: list[str] | None = None) -> Column:
    """text, or null if it is special."""
    return F.when(~is_special(text, patterns), text)


def clean_cell(text: Column, characters: str = PUNCTUATION, patterns: list[str] | None = None) -> Column:
    """null for null and special cells, else the cell with its outer punctuation trimmed; one pass, not idempotent."""
    return F.when(~is_special(text, patterns), trim_punct(text, characters))


def changed(before: Column, after: Column) -> Column:
    """1 for a cell that cleaning has changed, else 0."""
    return (~before.eqNullSafe(after)).cast("int")


def column_letter(index: int) -> str:
    """The spreadsheet name of a column: 0 is A, 25 is Z, 26 is AA."""
    out, index = "", index + 1
    while index:
        index, digit = divmod(index - 1, 26)
        out = chr(65 + digit) + out
    return out


def column_letter_of(index: Column) -> Column:
    """column_letter() of a column of indexes below 18278."""
    n = index.cast("long")
    letter = lambda x: F.char((x % 26 + 65).cast("int"))
    two = lambda x: F.concat(letter(F.floor(x / 26) - 1), letter(x))
    return F.when(n < 26, letter(n)).when(n < 702, two(n)).otherwise(F.concat(letter(F.floor((n - 702) / 676)), letter(F.floor((n - 702) / 26)), letter(n - 702)))


def truncated(text: Column, limit: int, kept: int) -> Column:
    """text, or its first characters and three dots if it is longer than limit."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, kept), F.lit("..."))).otherwise(text)


def structure_label(name: Column) -> Column:
    return truncated(name, 15, 12)


def sentence_label(text: Column) -> Column:
    return truncated(text, 10, 8)


def label_or_id(label: Column, node_id: Column) -> Column:
    """The label, or the id where there is none or it is empty."""
    return F.coalesce(F.nullif(label, F.lit("")), node_id)


def id_part(node_id: Column, part: int) -> Column:
    """A part of an id that is split at underscores; -1 is the last, null if there is none."""
    parts = F.split(node_id, "_")
    return F.try_element_at(parts, F.lit(part if part < 0 else part + 1))


def clean_columns(sheet: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    """sheet with clean cells in the given columns, by default the third to the fourteenth there are."""
    columns = sheet.columns[2:14] if columns is None else columns
    return sheet.withColumns({c: clean_cell(F.col(f"`{c}`"), **options) for c in columns})


def clean_counts(sheet: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    """(column_name, n_changed): cells that cleaning changes."""
    columns = sheet.columns[2:14] if columns is None else columns
    sums = sheet.agg(*[F.sum(changed(F.col(f"`{c}`"), clean_cell(F.col(f"`{c}`"), **options))).alias(c) for c in columns])
    return sums.unpivot([], columns, "column_name", "n_changed").withColumn("n_changed", F.coalesce(F.col("n_changed").cast("long"), F.lit(0)))
