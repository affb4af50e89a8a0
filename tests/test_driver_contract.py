import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from variorum import queries


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf}/{f}')")
    return c


def plain(rows):
    return sorted(tuple("null" if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["variorum/llm", "tests/llm", "corpus_pipeline.py"], ["variorum/llm", "tests/llm"]])
def test_without_the_corpus_operators(tmp_path, gone):
    root = Path(__spark_entry__.__file__).parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "variorum"):
        if (root / name).is_dir():
            shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (root / name).exists():
            shutil.copy(root / name, tmp_path)
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True) if "." not in name else (tmp_path / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; from variorum.queries import QUERIES; assert set(e.queries()) == set(e.oracle_sql()) == set(QUERIES)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_sql(spark, sf, duck, name):
    found = queries.QUERIES[name](spark, sf)
    wanted = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    key = sorted(columns)
    rows = [tuple(r[columns.index(k)] for k in key) for r in wanted.fetchall()]
    assert plain(tuple(r) for r in found.select(*key).collect()) == plain(rows)


@pytest.mark.parametrize(("name", "most"), [("edit_script", 1), ("op_cost", 1), ("collated_pairs", 1), ("pair_cost", 1), ("edit_replayed", 2), ("pair_cost_with_responses", 1), ("realign_validation", 1), ("dead_letters", 1)])
def test_scripts_are_made_once(spark, sf, name, most):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("+- == Initial Plan ==")[0].count("ArrowEvalPython") <= most
