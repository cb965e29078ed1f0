import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_agree():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 40


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
