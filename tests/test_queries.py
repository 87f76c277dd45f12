"""Every library query against its SQL on the small tables, and the entry module without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from porelight.plans import file_queries
from porelight.plans.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SMALL):
        pytest.skip("needs the small tables")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SMALL)
    if name not in ORACLES:
        assert got.count() > 0
        return
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda row: tuple((v is None, v) for v in row)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_packed_basecall_events(spark, con):
    want = con.execute(file_queries.BC_PACKED_SQL)
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, file_queries.file_bc_packed(spark, SMALL).select(*columns).collect())) == sorted(want.fetchall())


def test_entry_without_optional_parts(tmp_path):
    for name in ("porelight", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "porelight" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'event_mean_stdv' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})
