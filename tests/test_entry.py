"""The registry runs, agrees with its SQL on the smallest tables, and stands without the corpus operators."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from inkgauge.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
QUICK = ["text_profile", "line_dedup", "line_quality", "urls", "table_dates", "suspicious_phones", "run_islands", "tolerance_dedup", "grids", "box_iou", "word_lines", "line_accuracy", "gate_decision", "pattern_merge", "cer_ascii"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    tidy = lambda rows: sorted(repr(tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)
    assert tidy(got.select(*columns).collect()) == tidy(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(sql, str) and sql.strip() for sql in entry.oracle_sql().values())
