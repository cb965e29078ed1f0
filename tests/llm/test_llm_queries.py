import os

import pytest
from oracle import SF, compare

from trivalent.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.SQL[name])


def test_days_agree_with_the_whole(spark):
    days = {(r.census_slice, r.metric): r for r in queries.QUERIES["p4_days"](spark, SF).collect()}
    from trivalent.llm.quantiles import grouped_percentiles

    whole = grouped_percentiles(queries.timed_values(spark, SF), ["census_slice", "metric"], "value", {"median": 0.5, "p99": 0.99}, 0.0002).collect()
    assert len(whole) == len(days) > 0
    for r in whole:
        d = days[r.census_slice, r.metric]
        assert d.n == r.n and d.median == pytest.approx(r.median) and d.p99 == pytest.approx(r.p99)


def test_containers_hold_every_text(spark):
    from pyspark.sql import functions as F

    from trivalent.session import table

    rows = queries.QUERIES["p6_containers"](spark, SF).collect()
    docs = {r.doc_id for r in table(spark, SF, "documents").where(F.length("text") > 0).collect()}
    caps = {r.budget_id: (r.capacity_tokens, r.lang) for r in table(spark, SF, "token_budgets").collect()}
    used = {}
    for r in rows:
        used[r.budget_id, r.container] = used.get((r.budget_id, r.container), 0) + r.tokens
    assert all(v <= caps[b][0] for (b, _), v in used.items())
    for b, (_, lang) in caps.items():
        if lang is None:
            assert {r.doc_id for r in rows if r.budget_id == b} == docs
    assert len({(r.budget_id, r.doc_id, r.piece) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", ["p5_selections", "p5_spread", "p7_found", "p8_found", "p8_sources", "p7_items", "p6_fill"])
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
