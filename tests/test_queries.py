from __future__ import annotations

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from compare import database, difference
from conftest import SMALL

import __spark_entry__ as entry

from txguard.workload import QUERIES as REGISTERED
from txguard.workload_sql import ORACLES

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return database(SMALL)


def test_every_query_has_its_sql():
    assert set(SQL) <= set(QUERIES)
    # The queries of the optional subpackage have tests of their own.
    assert {name for name in set(QUERIES) - set(SQL) if not name.startswith("op") and name != "pipeline"} == set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    assert difference(spark, tables, QUERIES[name], SQL[name], SMALL) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_optional_subpackage(tmp_path):
    """A copy of the tree without the training-data operators registers all other queries with their SQL."""
    top = Path(entry.__file__).parent
    shutil.copytree(top / "txguard", tmp_path / "txguard", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    said = subprocess.run(
        [sys.executable, "-c", "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"],
        cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True,
    )
    queries, sql = json.loads(said.stdout)
    assert queries == sorted(REGISTERED) and sql == sorted(ORACLES)
