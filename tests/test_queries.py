"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from tests.conftest import SF
from tidemark.plans import registry


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype("float64").round(6) + 0.0
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        pd.testing.assert_frame_equal(plain(got), plain(duck.execute(registry.ORACLES[name]).fetch_df()))
    assert len(got)


def test_the_rest_stands_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; assert 'survey_outcomes' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
