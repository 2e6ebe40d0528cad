"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from catalog import base, check
from helpers import SMALL

QUERIES, ORACLE = base.QUERIES, base.ORACLE
MAY_BE_EMPTY = ("h8_rehydrate", "i1_new_only_work_list", "i9_issue_filters")  # nothing to find in so few rows


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("s1_")])
def test_query_equals_sql(spark, con, name):
    verdict = check.compare(spark, con, SMALL, QUERIES[name], ORACLE.get(name))
    assert not verdict.startswith("FAIL") or verdict == "FAIL empty" and name in MAY_BE_EMPTY, verdict


def test_entry(spark):
    assert entry.entry(spark).columns == ["root_path", "alive_items", "total_size"]


def test_nearly_everything_has_sql():
    assert set(ORACLE) <= set(QUERIES)
    assert [n for n in QUERIES if n not in ORACLE] == ["a3_file_hashes"]
