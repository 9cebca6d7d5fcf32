"""Every registered query against its SQL, on the smallest tables."""

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))
from oracle import compare, connect  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from laneward.plans.registry import ORACLE, QUERIES  # noqa: E402

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_its_sql():
    assert set(ORACLE) == set(NAMES) <= set(queries()) and set(NAMES) <= set(oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    problem, rows, _ = compare(spark, con, name, QUERIES, ORACLE, sf_dir)
    assert problem is None
    assert rows > 0 or name == "mention_match"


def test_flagship_entry(spark):
    df = entry(spark)
    assert df.columns == ["request_id", "lane", "risk_score", "risk_label", "ranked"]
