"""Every registered query against its DuckDB statement on the smallest data set."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check_queries  # noqa: E402

from broadsheet.queryset import all_oracles, all_queries  # noqa: E402


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in check_queries.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", list(all_queries()))
def test_query_matches_its_statement(key, spark, sf_dir, duck):
    verdict, rows, _, _, note = check_queries.compare(spark, duck, sf_dir, all_queries()[key], all_oracles()[key])
    assert verdict == "ok", note
