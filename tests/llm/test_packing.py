import random

import numpy as np
import pytest

from trivalent.llm import packing
from trivalent.session import materialize

pytest.importorskip("tiktoken")


def test_pack_keeps_all_limits():
    rng = np.random.RandomState(1)
    tokens = rng.randint(1, 100, 700)
    loss = np.minimum(tokens, rng.randint(0, 100, 700))
    for limits in ((100, 1000, 100), (100, 2, 100), (100, 1000, 99), (100, 3, 100)):
        if limits[2] < loss.max():
            continue
        bins = packing.pack(tokens, loss, limits)
        assert (bins >= 0).all()
        for b in range(bins.max() + 1):
            own = bins == b
            assert 0 < own.sum() <= limits[1] and tokens[own].sum() <= limits[0] and loss[own].sum() <= limits[2]
    assert packing.pack(tokens, loss, (100, 1000, 100)).max() + 1 <= 1.02 * tokens.sum() / 100 + 1


def test_every_text_once_or_in_pieces(spark):
    rng = random.Random(2)
    words = ["lamp", "river", "orchard", "extraordinary", "a", "the", "ticket"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 300))), rng.choice(["en", "EN", "eng", "en-GB", "de", None]), 1) for i in range(400)]
    docs += [(1000, None, "en", 1), (1001, "", "en", 1), (1002, "word\n" * 60_000, "English", 1), (1003, "x", "fr", 1), (1003, "x", "fr", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, container int")
    budgets = spark.createDataFrame([(1, 64, None), (2, 200, "en"), (3, 0, None), (4, None, "en"), (5, 100, "xx")], "budget_id int, capacity_tokens int, lang string")
    sizes = materialize(packing.token_sizes(df), "sizes")
    n = {r.doc_id: r.tokens for r in sizes.collect()}
    assert 1000 not in n and 1001 not in n and n[1002] > 60_000
    rows = packing.fill_containers(sizes, budgets, shard_items=100).collect()
    for budget, cap, langs in ((1, 64, None), (2, 200, {"en", "EN", "eng", "en-GB", "English"})):
        own = [r for r in rows if r.budget_id == budget]
        want = {d[0] for d in docs if d[0] in n and (langs is None or d[2] in langs)}
        assert {r.doc_id for r in own} == want
        used, pieces = {}, {}
        for r in own:
            used[r.container] = used.get(r.container, 0) + r.tokens
            pieces.setdefault(r.doc_id, []).append((r.start_token, r.tokens))
        assert max(used.values()) <= cap
        for d, p in pieces.items():
            p.sort()
            assert sum(t for _, t in p) == n[d] and [s for s, _ in p] == [sum(t for _, t in p[:i]) for i in range(len(p))]
            assert len(p) == 1 or n[d] > cap
        assert sum(used.values()) / (len(used) * cap) > 0.97
    assert {r.budget_id for r in rows} == {1, 2}
    assert packing.fill_containers(sizes.limit(0), budgets).count() == 0


SIZES = "doc_id long, lang string, tokens long, loss_tokens long"


def loads(spark, sizes, capacity, **limits):
    sizes = materialize(spark.createDataFrame(sizes, SIZES), "s")
    budgets = spark.createDataFrame([(1, capacity, None)], "budget_id int, capacity_tokens int, lang string")
    bounds = materialize(packing.container_limits(sizes, budgets, **limits), "l")
    filled = packing.fill_containers(sizes, budgets, bounds)
    return packing.container_loads(filled, bounds).collect()


def test_segment_limit_binds(spark):
    got = loads(spark, [(i, "en", 1, 1) for i in range(50)], 1000, segment_tokens=142)
    assert sum(r.segments for r in got) == 50 and max(r.segments for r in got) == 7
    assert sum(r.closed_by == "segments" for r in got) == 7


def test_loss_limit_binds(spark):
    # half of the texts bear loss on all tokens, half on none: both must be mixed to fill a container
    got = loads(spark, [(i, "en", 10, 10 * (i % 2)) for i in range(200)], 100, segment_tokens=1, loss_share=0.5)
    assert sum(r.tokens for r in got) == 2000 and len(got) == 20
    assert all(r.tokens == 100 and r.loss_tokens == 50 for r in got)
    tight = loads(spark, [(i, "en", 10, 10) for i in range(200)], 100, segment_tokens=1, loss_share=0.35)
    assert all(r.loss_tokens <= 35 and r.closed_by == "loss" for r in tight) and sum(r.segments for r in tight) == 200
    # a text that alone bears more loss than the limit is not cut, and stays alone
    lone = loads(spark, [(1, "en", 90, 90), (2, "en", 5, 0), (3, "en", 30, 30)], 100, loss_share=0.5)
    assert sorted((r.segments, r.tokens) for r in lone) == [(1, 90), (2, 35)]


def test_first_line_bears_no_loss(spark):
    docs = [(1, "The river\nand the lamp", "en"), (2, "no line end", "en"), (3, "ends\n", "en"), (4, "\nstarts", "en")]
    got = {r.doc_id: (r.tokens, r.loss_tokens) for r in packing.token_sizes(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert got[2][0] == got[2][1] and got[3][1] == 0 and 0 < got[1][1] < got[1][0] and got[4][1] == got[4][0] - 1
