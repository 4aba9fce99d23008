from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SMALL).exists(), reason="shared tables are absent")


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rank_mae" in df.columns


@needs_data
@pytest.mark.parametrize("name", ["hysteresis_states", "budget_criteria", "peer_flags", "late_revisions", "canonical_spending"])
def test_some_queries_match_their_sql(spark, name):
    from oracle_check import compare, connect

    state, *_, note = compare(spark, connect(SMALL), SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert state == "match", note
