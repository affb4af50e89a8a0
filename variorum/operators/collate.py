"""Pairs of versions of each sentence, their distances and edit scripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variorum.operators.edit_script import edit_script
from variorum.operators.reshape import by_order, running
from variorum.schema import OPERATIONS
from variorum.storage import materialize

SENTENCE = ["chapter_number", "sentence_number"]
TEXTS = ["original_text", "modified_text"]
#: Two texts of a sentence, whatever the versions that have them.
PLACE = [*SENTENCE, *TEXTS]
#: Versions of a sentence from which its pairs are dealt to several places.
HOT = 4096
#: The column that tells how many equal records a record stands for, and how many of them a list holds at once.
COPIES, AT_ONCE = "n_copies", 4096
#: Sentences that a record of gathered() names, about, and how it names them.
MOST_PLACES = 256
PLACES = "array<struct<chapter_number:int,sentence_number:int,original_versions:map<string,long>,modified_versions:map<string,long>>>"


def pairs(witness: DataFrame, hot: int = HOT) -> DataFrame:
    """Every two versions of a sentence, the smaller name first; versions without a name are left out.

    Equal rows are paired once, and each pair comes as often as there are copies of its two sides.
    """
    return expanded(distinct_pairs(witness, hot))


def distinct_pairs(witness: DataFrame, hot: int = HOT) -> DataFrame:
    """pairs() with equal rows as one row, and n_copies, how many they are.

    What is made of pairs costs as much as there are different ones, and expanded() gives each its copies at the end.
    One shuffle by the sentence's numbers; both sides of the join share it.  Its partitions are set, since pairs are
    many times the sentences by whose bytes adaptive execution would merge partitions.  Sentences with more than hot
    versions, copies too, are cut into blocks, and each two blocks meet in a place of their own.
    """
    named = _named(witness).groupBy(*SENTENCE, "version", "text").agg(F.count("*").alias(COPIES))
    return _meet(named, F.sum(COPIES), hot, _met)


def _named(witness: DataFrame) -> DataFrame:
    named = witness.where("version is not null and version <> '' and chapter_number is not null and sentence_number is not null")
    return named.select(*SENTENCE, "version", F.coalesce("text", F.lit("")).alias("text"))


def _meet(rows: DataFrame, size: Column, hot: int, met: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> DataFrame:
    """met() of all rows of a sentence with each other; those of a sentence whose size is over hot in blocks, two at a place."""
    counts = rows.groupBy(*SENTENCE).agg(F.ceil(size / hot).cast("int").alias("blocks")).where("blocks > 1")
    spread = lambda df, *keys: df.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    if counts.isEmpty():
        return met(*[spread(rows, *SENTENCE)] * 2, SENTENCE)
    cold = spread(rows.join(counts, SENTENCE, "left_anti"), *SENTENCE)
    own = rows.join(counts, SENTENCE).withColumn("own", F.pmod(F.xxhash64(*[c for c in ("version", "text") if c in rows.columns]), F.col("blocks").cast("long")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place, more = [*SENTENCE, "i", "j"], [c for c in rows.columns if c not in SENTENCE]
    one = lambda i, j: spread(own.select(*SENTENCE, F.col(i).alias("i"), F.col(j).alias("j"), *more), *place)
    return met(cold, cold, SENTENCE).union(met(one("own", "other"), one("other", "own"), place))


def _met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    side = lambda df, who: df.select(*keys, F.col("version").alias(f"{who}_text_version"), F.col("text").alias(f"{who}_text"), F.col(COPIES).alias(f"{who}_copies"))
    both = side(a, "original").join(side(b, "modified"), keys).where("original_text_version < modified_text_version")
    return both.select(*SENTENCE, "original_text_version", "original_text", "modified_text_version", "modified_text", (F.col("original_copies") * F.col("modified_copies")).alias(COPIES))


def _met_texts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    side = lambda df, who, end: df.select(*keys, F.col("text").alias(f"{who}_text"), end)
    both = side(a, "original", "low").join(side(b, "modified", "high"), keys).where("low < high and original_text <> modified_text")
    return both.select(*SENTENCE, *TEXTS)


def expanded(records: DataFrame) -> DataFrame:
    """Each record as often as its n_copies says, without that column."""
    rest = [c for c in records.columns if c != COPIES]
    blocks = F.sequence(F.lit(0), ((F.col(COPIES) - 1) / AT_ONCE).cast("int"))
    dealt = records.select(*rest, F.explode(blocks).alias("__block"), COPIES)
    left = F.least(F.lit(AT_ONCE), F.col(COPIES) - F.col("__block") * AT_ONCE).cast("int")
    return dealt.select(*rest, F.explode(F.array_repeat(F.lit(True), left)).alias("__one")).select(*rest)


def pair_distances(witness: DataFrame, copies: bool = False) -> DataFrame:
    """pairs(), or with copies distinct_pairs(), with edit_distance, without scripts: no Python runs."""
    found = distinct_pairs(witness)
    measured = found.select(*[c for c in found.columns if c != COPIES], F.levenshtein("original_text", "modified_text").alias("edit_distance"), COPIES)
    return measured if copies else expanded(measured)


def distance_summary(witness: DataFrame) -> DataFrame:
    """(chapter_number, n_pairs, n_equal, sum_distance, max_distance)."""
    d, n = F.col("edit_distance"), F.col(COPIES)
    return pair_distances(witness, copies=True).groupBy("chapter_number").agg(F.sum(n).alias("n_pairs"), F.sum(F.when(d == 0, n).otherwise(0)).alias("n_equal"), F.sum(d * n).alias("sum_distance"), F.max(d).alias("max_distance"))


def collate(witness: DataFrame, distinct_texts: bool = False, most_cells: int | None = None, copies: bool = False) -> DataFrame:
    """Pair records: pairs() with edit_distance, operations and script_error; with copies, distinct_pairs() with these.

    Equal texts have no operations, and nulls go to Python in their place; distances and scripts are made in one pass,
    and a script's table is a band as wide as the distance.
    With distinct_texts, each pair of texts is aligned once, in a written table, and joined back: for corpora where the
    same two texts stand in many places.  A pair whose table would have more than most_cells cells has a null script
    and an error.
    """
    if distinct_texts:
        found = distinct_pairs(witness)
        scripted = _scripted(found, text_scripts(witness, most_cells))
    else:
        differ = F.col("original_text") != F.col("modified_text")
        found = pair_distances(witness, copies=True)
        scripted = found.withColumn("script", edit_script(*[F.when(differ, F.col(t)) for t in TEXTS], most_cells, F.when(differ, F.col("edit_distance"))))
    out = scripted.select(*[c for c in found.columns if c not in ("edit_distance", COPIES)], "edit_distance", F.col("script.operations").alias("operations"), F.col("script.error").alias("script_error"), COPIES)
    return out if copies else expanded(out)


def text_scripts(witness: DataFrame, most_cells: int | None = None) -> DataFrame:
    """(original_text, modified_text, edit_distance, operations, script_error) of every two different texts that are
    paired somewhere, a written table.

    A sentence's texts meet without their versions: one that is the first of a pair has a smaller version than some
    version of the other.
    """
    measured = _text_places(witness).select(*TEXTS).distinct().withColumn("edit_distance", F.levenshtein(*TEXTS))
    scripted = measured.withColumn("script", edit_script(*map(F.col, TEXTS), most_cells, F.col("edit_distance")))
    return materialize(scripted.select(*TEXTS, "edit_distance", F.col("script.operations").alias("operations"), F.col("script.error").alias("script_error")))


def _text_places(witness: DataFrame) -> DataFrame:
    own = _named(witness).groupBy(*SENTENCE, "text").agg(F.min("version").alias("low"), F.max("version").alias("high"))
    return _meet(own, F.count("*"), HOT, _met_texts)


def _scripted(found: DataFrame, scripts: DataFrame) -> DataFrame:
    """found with edit_distance and script of its texts, from text_scripts(); equal texts have no operations."""
    none = F.struct(F.array().cast(OPERATIONS).alias("operations"), F.lit(None).cast("string").alias("error"))
    script = F.when(F.col("original_text") != F.col("modified_text"), F.struct("operations", F.col("script_error").alias("error"))).otherwise(none)
    return found.join(scripts, TEXTS, "left").withColumn("script", script).withColumn("edit_distance", F.coalesce("edit_distance", F.lit(0)))


def places(witness: DataFrame, most_cells: int | None = None, copies: bool = False, scripts: DataFrame | None = None) -> DataFrame:
    """PLACE with edit_distance, operations and script_error: every two different texts that are paired in a sentence, once.

    No pair of versions is made for it, and what does not ask for versions costs as much as there are places.  With
    copies, also equal texts, and n_copies, how many pairs with their copies a place stands for.  scripts are
    text_scripts() of the same witness, where they are made already.
    """
    found = distinct_pairs(witness).groupBy(*PLACE).agg(F.sum(COPIES).alias(COPIES)) if copies else _text_places(witness)
    more = [COPIES] if copies else []
    scripts = text_scripts(witness, most_cells) if scripts is None else scripts
    return _scripted(found, scripts).select(*PLACE, "edit_distance", F.col("script.operations").alias("operations"), F.col("script.error").alias("script_error"), *more)


def with_versions(made: DataFrame, witness: DataFrame, how: str = "inner") -> DataFrame:
    """distinct_pairs() with what was made of places(), a row a PLACE, or of text_scripts(), a row for each two texts.

    The number of copies is that of the pair.  With how left, pairs of which nothing was made have null.
    """
    made = made.drop(COPIES)
    return distinct_pairs(witness).join(made, [c for c in PLACE if c in made.columns], how)


def of_places(made: DataFrame, witness: DataFrame, how: str = "inner") -> DataFrame:
    """with_versions() where made is a row a PLACE: it is joined to version_places(), and pairs are made last.

    No table of pairs of versions is dealt by texts.  What is small enough to be sent to all tasks needs no such join.
    """
    return _of_versions(version_places(witness).join(made.drop(COPIES), PLACE, how))


def _of_versions(found: DataFrame) -> DataFrame:
    """A row for each two versions of original_versions and modified_versions, the smaller name first, with n_copies."""
    rest = [c for c in found.columns if c not in ("original_versions", "modified_versions")]
    each = found.select(*rest, F.explode("original_versions").alias("original_text_version", "__n"), "modified_versions")
    both = each.select(*rest, "original_text_version", "__n", F.explode("modified_versions").alias("modified_text_version", "__m")).where("original_text_version < modified_text_version")
    return both.select(*rest, "original_text_version", "modified_text_version", (F.col("__n") * F.col("__m")).alias(COPIES))


def version_places(witness: DataFrame, hot: int = HOT) -> DataFrame:
    """PLACE with original_versions and modified_versions, the versions that have each text and how often, for every two
    texts, equal ones too, that are paired in a sentence.

    No pair of versions is made: there are as many entries as sentences' texts have versions.  A text of more than
    AT_ONCE versions stands in several rows, so that no map is longer.
    """
    each = _named(witness).groupBy(*SENTENCE, "text", "version").agg(F.count("*").alias("n"))
    # the block of a version in its text; a map's keys are the versions of a block
    block = ((F.row_number().over(Window.partitionBy(*SENTENCE, "text").orderBy("version")) - 1) / AT_ONCE).cast("int")
    entries = F.map_from_entries(F.collect_list(F.struct("version", "n")))
    own = each.withColumn("block", block).groupBy(*SENTENCE, "text", "block").agg(F.min("version").alias("low"), F.max("version").alias("high"), entries.alias("versions"))
    return _meet(own.drop("block"), F.count("*"), hot, _met_versions)


def _met_versions(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    side = lambda df, who, end: df.select(*keys, F.col("text").alias(f"{who}_text"), F.col("versions").alias(f"{who}_versions"), end)
    both = side(a, "original", "low").join(side(b, "modified", "high"), keys).where("low < high")
    return both.select(*PLACE, "original_versions", "modified_versions")


def gathered(found: DataFrame, keys: list[str], sentences: int) -> DataFrame:
    """Rows of version_places() that agree in keys as one, with places, PLACES; of MOST_PLACES sentences about of so many.

    For what is written out: texts, and what was made of them, once for so many places.  paired() gives pairs back.
    """
    dealt = found.withColumn("__part", F.pmod(F.xxhash64(*SENTENCE), F.lit(max(1, -(-sentences // MOST_PLACES)))))
    place = F.struct(*SENTENCE, "original_versions", "modified_versions")
    return dealt.groupBy(*keys, "__part").agg(F.collect_list(place).alias("places")).drop("__part")


def paired(records: DataFrame) -> DataFrame:
    """Records of gathered() as distinct_pairs(): each pair of versions of each place, with n_copies."""
    rest = [c for c in records.columns if c != "places"]
    each = records.select(*rest, F.explode("places").alias("at"))
    return _of_versions(each.select(*rest, *[F.col(f"at.{k}").alias(k) for k in (*SENTENCE, "original_versions", "modified_versions")]))


def sentence_count(witness: DataFrame) -> int:
    """Sentences that some version has."""
    return _named(witness).select(*SENTENCE).distinct().count()


def pair_index(records: DataFrame, witness: DataFrame) -> DataFrame:
    """records with pair_index: sentences by their first place in the source, then pairs by versions."""
    first, order = _places(witness)
    order = [*[f"place.{c}" for c in order], *_PAIR_ORDER]
    return by_order(records.join(first, SENTENCE), order, "pair_index").select(*records.columns, "pair_index")


_PAIR_ORDER = ["original_text_version", "modified_text_version", "original_text", "modified_text"]


def _places(witness: DataFrame) -> tuple[DataFrame, list[str]]:
    order = ["ordinal"] if "ordinal" in witness.columns else ["version_idx", "chapter_number", "row_idx"]  # as a tree is read
    return witness.groupBy(*SENTENCE).agg(F.min(F.struct(*order)).alias("place")), order


def pair_slice(witness: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """index_slice(pair_index(pairs(witness), witness), start, end), with no other pairs made than those of its sentences.

    How many pairs a sentence has follows from how often each version stands in it, so the index at which its pairs
    begin is known before they are made.  Sentences that tie in their place have their pairs in one order.
    """
    first, order = _places(witness)
    sizes = _named(witness).groupBy(*SENTENCE, "version").agg(F.count("*").alias("n")).groupBy(*SENTENCE).agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("n"))
    placed = running(sizes.join(first, SENTENCE).groupBy("place").agg(F.sum("n").alias("n")), ["place"], "n", "before")
    start = max(start, 0)
    reached = placed.where((F.col("before") + F.col("n") > start) & (F.lit(True) if end is None else F.col("before") < end))
    wanted = materialize(first.join(reached, "place").select(*SENTENCE, "place", F.col("before").alias("__begin")))
    within = distinct_pairs(witness.join(wanted.select(*SENTENCE), SENTENCE, "left_semi")).join(wanted, SENTENCE)
    counted = running(within, ["place", *_PAIR_ORDER], COPIES, "__before")
    base = wanted.agg(F.min("__begin").alias("__base"))
    at = counted.join(F.broadcast(base)).withColumn("__first", F.col("__base") + F.col("__before"))  # of one row
    low, high = F.greatest("__first", F.lit(start)), F.col("__first") + F.col(COPIES)
    high = high if end is None else F.least(high, F.lit(end))
    kept = at.select(*SENTENCE, "original_text_version", "original_text", "modified_text_version", "modified_text", low.alias("__low"), high.alias("__high")).where("__low < __high")
    return kept.select("*", F.explode(F.sequence(F.lit(0), ((F.col("__high") - F.col("__low") - 1) / AT_ONCE).cast("int"))).alias("__block")).select(
        *kept.columns[:-2],
        F.explode(F.sequence(F.col("__low") + F.col("__block") * AT_ONCE, F.least(F.col("__high"), F.col("__low") + (F.col("__block") + 1) * AT_ONCE) - 1)).alias("pair_index"),
    )


def index_slice(records: DataFrame, start: int = 0, end: int | None = None, column: str = "pair_index") -> DataFrame:
    """Records with start <= index < end; a negative start is 0, no end is all."""
    kept = records.where(F.col(column) >= max(start, 0))
    return kept if end is None else kept.where(F.col(column) < end)


def exploded_operations(records: DataFrame) -> DataFrame:
    """A row for each operation, with its step from 0."""
    keys = [*SENTENCE, "original_text_version", "modified_text_version"]
    return records.select(*keys, F.posexplode("operations").alias("step", "op")).select(*keys, "step", "op.*")
