"""Every query with SQL gives the SQL's rows on the smallest driver tables; no package is needed that may be absent."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from sparkloom.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, str(DATA))
    rel = db.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    assert got == want


def test_every_query_is_known():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) >= 70


def test_entry_imports_without_the_corpus_package(tmp_path):
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    (tmp_path / "sparkloom").mkdir()
    for p in (root / "sparkloom").iterdir():
        if p.name != "llm":
            (tmp_path / "sparkloom" / p.name).symlink_to(p)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLES))]
