"""Registered queries against DuckDB on the smallest tables, and the driver's contract."""

import ast
import os
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from massloom.plans import files, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(cell, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf_dir, con, name):
    got = registry.queries()[name](spark, sf_dir)
    want = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert Counter(tuple(map(cell, r)) for r in want.fetchall()) == Counter(tuple(cell(r[c]) for c in cols) for r in got.collect())


def test_entry(spark):
    assert len(__spark_entry__.entry(spark).columns) == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_imports_of_the_subpackage():
    """Nothing but the entry, the pipeline and the subpackage itself names it."""
    for top, _, files in os.walk(os.path.join(ROOT, "massloom")):
        if os.path.basename(top) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                for node in ast.walk(ast.parse(open(os.path.join(top, f)).read())):
                    names = [a.name for a in node.names] + [getattr(node, "module", "") or ""] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
                    assert not any("llm" in n.split(".") for n in names)


def test_entry_without_the_subpackage(tmp_path):
    """With the subpackage and its pipeline deleted the other queries are still there."""
    shutil.copytree(os.path.join(ROOT, "massloom"), tmp_path / "massloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op1_') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True).returncode == 0


def test_without_sql(spark, sf_dir):
    """Queries that SQL cannot express, by what must hold."""
    q = registry.queries()
    assert set(q) - set(registry.oracle_sql()) == {"aligned_names", "calibration_search"}
    got = q["aligned_names"](spark, sf_dir).collect()
    assert len(got) == 100 and all(r["agn_pos"] is None or 1 <= r["agn_pos"] <= len(r["agn_seqid"]) for r in got)
    assert [tuple(r) for r in q["calibration_search"](spark, sf_dir).collect()] == [(True, True)]


def test_report_files_carry_their_header(spark, sf_dir, tmp_path, monkeypatch):
    """A part with key 0 ties with no header: each of the report's files begins with it."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    parts.orderBy(F.desc("p_partkey")).repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(files, "fresh_path", lambda s, name: f"{tmp_path}/{name}")
    got = registry.queries()["report_round_trip"](spark, str(tmp_path))
    assert got.count() == 2 * parts.count()
    heads = {f.read_text().split("\n")[0].split("\t")[0] for f in (tmp_path / "report").glob("part-*")}
    assert heads == {"id"} and len(list((tmp_path / "report").glob("part-*"))) == 3
