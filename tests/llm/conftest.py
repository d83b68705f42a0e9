import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cases import EDGE, FOLDER  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    """The rows above, with extra columns whose names the operators use inside."""
    extra = "g long, anchor long, row string, size long, taken string, target string, score string, keys string, spans string, range int, id long"
    rows = [(i, t, "en", s, len(t) if t is not None else None, *[None] * 11) for i, t, s in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + extra).repartition(5)


@pytest.fixture(scope="session")
def empty(spark, edge):
    return spark.createDataFrame([], edge.schema)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
