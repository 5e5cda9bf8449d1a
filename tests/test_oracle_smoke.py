"""Registered queries vs their DuckDB oracle on sf0.001 (fast subset; the
full set runs through scripts/oracle_check.py and the driver)."""

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.oracle_check import digest
from webloom.sources.tables import TABLES

KEYS = ["extract_links", "list_pages", "html_slice_tail", "chunk_pages", "page_metadata", "last_n_log",
        "since_last_reset", "idle_sessions", "final_files", "truncate_body", "normalize_headers",
        "multi_search", "detect_language", "page_text", "batch_fetch", "correlate", "links_json",
        "follow_links"]


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, sf_small, con, key):
    df = entry.queries()[key](spark, sf_small)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "pos", "text", "href"]
    assert df.count() >= 0


def test_every_query_has_builder():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50


@pytest.mark.parametrize("key", sorted(entry.queries()))
def test_every_registered_query_runs(spark, sf_small, key):
    df = entry.queries()[key](spark, sf_small)
    assert df.count() >= 0
    assert all(f.name for f in df.schema.fields)
