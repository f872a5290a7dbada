"""The register: every query has a stable schema on the smallest tables, its SQL names a query, and the engine stands without the optional parts."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from lumenreel.plans import registry

ROOT = Path(__file__).resolve().parents[2]


def test_names():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert len(registry.QUERIES) - len(registry.ORACLE_SQL) <= 3


def test_nothing_else_imports_the_optional_part():
    part = "lumenreel" + ".llm"
    for path in (ROOT / "lumenreel").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(rf"(import|from)\s+{re.escape(part)}", path.read_text()), path


def test_the_rest_stands_without_the_optional_part(tmp_path):
    part = "ll" + "m"
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda _, names: [n for n in names if n in (part, ".git", "__pycache__")])
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'home_grid' in q and set(o) <= set(q) and not [n for n in q if n[:2] == 'op' and n[2].isdigit() or n == 'pipeline'], sorted(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def _value(v):
    return "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(_value(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(_value(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
