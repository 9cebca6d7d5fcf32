"""The registered queries against their SQL, on the smallest tables."""

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
from oracle import compare, connect  # noqa: E402

from laneward.llm.queries import ORACLE, QUERIES  # noqa: E402


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_dir, name):
    problem, rows, _ = compare(spark, connect(sf_dir), name, QUERIES, ORACLE, sf_dir)
    assert problem is None and rows > 0


@pytest.mark.parametrize("name", ["op7_lattice_scores", "op8_nearest", "op9_token_counts"])
def test_columns(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
