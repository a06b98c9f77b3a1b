"""Every registered query of the library against its SQL on the smallest tables."""
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from check import compare, duck
from rosterlake.plans import load_all
from rosterlake.plans.registry import ORACLES as SQL
from rosterlake.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    ok, message = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert ok, message


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_queries_load_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 200"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
