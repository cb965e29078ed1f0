import os

import pytest
from oracle import SF, compare

from trivalent.plans import catalogue

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, name, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_copies_against_a_plain_comparison(spark):
    """p1_found against Python dictionaries, whatever the number of partitions."""
    import json

    from trivalent.functions.records import differing_paths
    from trivalent.session import table

    want = set()
    held = {}
    for side, t in (("p", "artifact_bundles"), ("m", "artifact_bundles_mirror")):
        for r in table(spark, SF, t).collect():
            k = (r.graph_hash.strip().lower(), side)
            if k not in held or r.copied_at > held[k].copied_at:
                held[k] = r
    for h in {k for k, _ in held}:
        a, b = held.get((h, "p")), held.get((h, "m"))
        if a is None or b is None:
            want.add(("bundle", h, -1, "", "only_mirror" if a is None else "only_primary"))
            continue
        for f in ("planar_code_paths", "embedding_paths", "report_paths", "leaderboard_categories"):
            if set(a[f] or []) != set(b[f] or []):
                want.add(("bundle", h, -1, f, "differs"))
        want |= {("bundle", h, -1, p, "differs") for p in differing_paths(a.original_record, b.original_record, "original_record")}
        assert json.loads(a.original_record)
    held = {}
    for r in table(spark, SF, "review_constraints").collect():
        k = (r.graph_hash.strip().lower(), r.constraint_index, r.held_by)
        if k not in held or r.copied_at > held[k].copied_at:
            held[k] = r
    edges = lambda es: {tuple(sorted(e)) for e in es or []}
    for h, i in {k[:2] for k in held}:
        a, b = held.get((h, i, "primary")), held.get((h, i, "mirror"))
        if a is None or b is None:
            want.add(("constraint", h, i, "", "only_mirror" if a is None else "only_primary"))
            continue
        want |= {("constraint", h, i, f, "differs") for f in ("required_edges", "forbidden_edges") if edges(a[f]) != edges(b[f])}
        if a.analysis != b.analysis:
            want.add(("constraint", h, i, "analysis", "differs"))
    for parts in ("2", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {tuple(r) for r in catalogue.QUERIES["p1_found"](spark, SF).collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "2")
