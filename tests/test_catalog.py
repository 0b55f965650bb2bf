"""Every query against its SQL."""

from __future__ import annotations

import pandas as pd
import pytest

from claimloom.plans.catalog import ORACLE, QUERIES


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    return str(round(value, 9)) if isinstance(value, float) else str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) or "" for v in r) for r in frame.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, small, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_a_docstring():
    assert all(q.__doc__ for q in QUERIES.values())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_party_merge_keeps_every_claim(spark, small):
    got = QUERIES["party_merge"](spark, small).toPandas()
    parts = spark.read.parquet(f"{small}/part.parquet").select("p_brand", "p_name").distinct().count()
    assert got.n_claims.sum() == parts
