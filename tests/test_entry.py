"""Driver contract: entry() runs, every oracle has a query, names are unique."""

import pytest

import __spark_entry__ as entry
from vireo.plans import registry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["metric", "k", "score"]
    assert len(rows) == 10


def test_oracles_have_queries():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 71


REFERENCE = registry.queries()          # the queries of this part alone; the others have tests of their own


@pytest.mark.parametrize("name", sorted(REFERENCE))
def test_query_runs_and_gives_rows(spark, sf_small, name):
    df = REFERENCE[name](spark, sf_small)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    for flag in {"trained", "finite", "best_is_argmin", "ordered", "scores_match", "same_prediction"} & set(df.columns):
        assert all(r[flag] for r in rows), flag
