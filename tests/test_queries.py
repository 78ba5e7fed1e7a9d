"""Every query with an oracle, side by side with DuckDB on the smallest tables; and that the contract stands without the training-data operators."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from veritome.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return repr(round(x, 9))
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, oracle, name):
    found = catalog.queries()[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in found.collect())
    con = oracle.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(cell(r[i]) for i in order) for r in con.fetchall())
    assert got == want


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_contract_without_training_operators(tmp_path):
    """As after both llm folders and the pipeline module are deleted."""
    for name in ("veritome", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "veritome"
    package.mkdir()
    for part in (ROOT / "veritome").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (package / part.name).symlink_to(part)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'duplicate_inventory' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["sha", "group_id", "member_count", "total_bytes", "redundant_bytes"]
