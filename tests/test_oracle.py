"""Every registered query with checking SQL, on the smallest tables.

The queries that train the pairwise learner take long; they run when SHOWGRID_ALL is set.
"""

import os

import pytest

import __spark_entry__ as entry
import oracle
from showgrid.plans.registry import SMALL_ORACLES

FOLDER = "/root/testdata/sf0.001"
SLOW = {"pairwise_ltr", "ltr_scores", "ltr_breakdown", "holdout_evaluation"}
QUERIES, SQL = entry.queries(), entry.oracle_sql() | SMALL_ORACLES
CHOSEN = [q for q in QUERIES if q not in entry.LLM_QUERIES if os.environ.get("SHOWGRID_ALL") or q not in SLOW]


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert oracle.compare(df, FOLDER, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 30
