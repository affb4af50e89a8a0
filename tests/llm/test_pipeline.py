"""The pipeline's stages, each through a written table, against brute force."""

import collections
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.conftest import sentences
from tests.llm.test_text_operators import TIKTOKEN, brute_components, brute_hits, brute_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, docs, texts, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    toxic = [(1000 + i, f"{sentences(i, 20, 3000)} nitwit blockhead {sentences(900 + i, 15, 3000)}", "en", "s", 1) for i in range(300)]
    clean = [(2000 + i, sentences(5000 + i, 40, 3000), "en", "s", 1) for i in range(300)]
    rest = docs.where("doc_id is not null").select(*COLUMNS)
    spark.createDataFrame(toxic + clean, rest.schema).union(rest).write.parquet(f"{root}/documents.parquet")
    labels = [(i, int(i < 2000), 1) for i, *_ in toxic + clean]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{root}/labels.parquet")
    items = [(1, dict(texts)[2][30:150]), (2, "nothing of this stands in any document at all as far as one knows")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), items


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, tables, tmp_path):
    root, items = tables
    found = spark.read.parquet(f"{root}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "byte_bpe"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows(found)
        out = stage(spark, found, root)
        if name != "byte_bpe":
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        found = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "toxicity":
            kept = {i for i, _ in rows(found)}
            assert sum(1000 <= i < 2000 for i in kept) <= 3 and {i for i, _ in before if not 1000 <= i < 2000} - kept == set()
        elif name == "near_duplicates":
            wanted = collections.Counter(i for i, _, _, stay in brute_components(before, Fraction(4, 5)) if stay)
            assert collections.Counter(i for i, _ in rows(found)) == wanted
        elif name == "substring_dedup":
            wanted = [(i, x.decode() if gone else t) for i, t, _, gone, x in brute_repeats(before, 35)]
            assert sorted(rows(found), key=repr) == sorted(wanted, key=repr)
            assert found.where("n_chars <> char_length(text)").where(F.col("n_chars") != 1).count() == 0
        elif name == "decontamination":
            hit = {r[0] for r in brute_hits(before, items, 10) if r[5]}
            assert hit and sorted(rows(found), key=repr) == sorted(((i, t) for i, t in before if i not in hit), key=repr)
        else:
            assert sorted((r.doc_id, r.n_tokens) for r in found.collect()) == sorted((i, len(TIKTOKEN.encode_ordinary(t or ""))) for i, t in before)


def test_run_is_the_stages_in_a_row(spark, tables, tmp_path):
    root, _ = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, root).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    found = __spark_entry__.queries()["pipeline"](spark, root)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, docs.collect()))
    assert corpus_pipeline.ORACLE_SQL is None


def through(spark, root, docs, folder):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, root).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


def test_empty_tables_through_all_stages(spark, tables, tmp_path):
    root, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, "some words", "en", "s", 10), (2, None, None, None, None), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    found = through(spark, str(tmp_path), docs, f"{tmp_path}/out").collect()
    assert sorted((r.doc_id, r.n_tokens) for r in found) == [(1, 2), (2, 0), (3, 0)]


def test_clashing_columns_through_all_stages(spark, tables, docs, tmp_path):
    root, _ = tables
    plain = through(spark, root, docs.select(*COLUMNS), f"{tmp_path}/plain").collect()
    clashing = through(spark, root, docs, f"{tmp_path}/clashing").collect()
    assert plain and sorted(map(repr, plain)) == sorted(map(repr, clashing))
    assert spark.read.parquet(f"{tmp_path}/clashing/3").columns == docs.columns
