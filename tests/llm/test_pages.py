import random

from trivalent.llm import pages

ADVERTS = [
    "TO LET, two rooms,\n{n} Lane, No. {k}6.\nRent 1{k}s. 4d. weekly.", "** SALE **\nat {n}'s\nThis week only!\n1{k}s. 3d.", "WANTED, a strong lad\nto carry boots.\nApply Box 2{k}.",
    "Try {n}'s famed\nboots. Sold by all\ngrocers, {k}s. 4d.", "{n} & SONS\ndealers in boots\n{k} High St.", "BOOTS! BOOTS!\nBest in {n}\nonly {k}s. 4d.",
    "LOST near {n},\na small purse.\nReward {k}s. 1d.", "Dr. {n}'s PILLS\nfor all ills.\n6{k} cured in a week.\nPrice 14s. {k}d.",
]
WORDS = "river planted his heavy ticket while one late settlement reached the shoe behind a garden and long engine stood against milk market brother window".split()
SCHEMA = "doc_id long, text string, column_count int, page_lines array<struct<x0 int, y0 int, x1 int, y1 int, confidence float>>, source string"


def prose(rng, lines, width=9):
    return [" ".join(rng.choice(WORDS) for _ in range(width)) for _ in range(lines)]


def corpus(rng, count=120):
    """Pages of full lines with two adverts each; every third page holds an article whose last line is short."""
    for i in range(count):
        body = prose(rng, 3)
        for k in range(2):
            body += ADVERTS[(i + 3 * k) % len(ADVERTS)].format(n=rng.choice(["Norton", "Fenby", "Zelwick", "Tarmore"]) + "abcdefgh"[i % 8], k=1 + i % 9).split("\n")
            body += prose(rng, 3) + (["and milk."] if i % 3 == 0 else []) + prose(rng, 2)
        yield (i, "\n".join([f"{i} The Norton Argus, Monday", *body]), 1, None, "The Norton Argus")


def test_columns_heads_and_hyphens():
    lines = ["THE ZELSTED HERALD —— PRICE ONE PENNY", "second column goes", "First column of the", "page is bro-", "ken here and        on to its end."]
    x0 = [60, 500, 61, 60, 61]
    y0 = [10, 40, 40, 60, 120]
    x1 = [900, 880, 430, 300, 880]
    got = pages.ordered_lines("\n".join(lines), x0, y0, x1, 2, "The Zelstead Herald")
    assert got == ["First column of the", "page is bro-", "ken here and", "second column goes", "on to its end."]
    assert pages.joined_text(got) == "First column of the page is broken here and second column goes on to its end. "
    assert pages.letters("Ab-c d’É 1!\n") == "abcdé1".encode()


def test_running_heads_are_the_paper_s_title():
    title = "The Wickham Argus"
    for s in ("7 The Wickham Argus, Monday", "THE WICKHAM ARGUS. 12", "T HE WICKHAMARGUS —— PRICE ONE PENNY", "10 Tbe Wickharn Argus, Friday"):
        assert pages.is_running_head(s, title), s
    for s in ("THE WICKED AND THE GOOD.", "Wick", "", "The Wickham Argus tells of a long engine that stood against his milk in the garden"):
        assert not pages.is_running_head(s, title), s
    assert not pages.is_running_head("7 The Wickham Argus, Monday", None) and not pages.is_running_head("", "")


def test_odd_pages():
    assert pages.ordered_lines(None, [], [], [], 1) == [] and pages.ordered_lines("", [], [], [], 3) == []
    assert pages.ordered_lines("one line", [], [], [], 4) == ["one line"]  # boxes don't match: the text's own order
    assert pages.ordered_lines("a\nb", [5, 5], [9, 1], [9, 9], None) == ["a", "b"]
    assert len(pages.ordered_lines("\n".join(["a line of text"] * 50_000), [], [], [], 1)) == 50_000
    merged = pages.ordered_lines("aa        bb\ncc        dd", [10, 10], [1, 2], [200, 200], 2)
    assert merged == ["aa", "cc", "bb", "dd"]


def test_adverts_are_learnt_from_the_corpus(spark):
    rng = random.Random(6)
    docs = [*corpus(rng), (900, None, 1, None, None), (901, "", 2, [], ""), (902, "word " * 100_000, 1, None, "x")]
    lines, adverts = pages.ordered_pages(spark.createDataFrame(docs, SCHEMA).repartition(4))
    assert lines.count() == len(docs) and adverts.weights
    before, after = prose(rng, 2), ["and milk.", *prose(rng, 2)]
    narrow = ["river planted his heavy", "ticket while one late"], ["settlement reached", "the shoe behind a garden"]
    for a in ADVERTS:  # names and numbers never seen, also between narrow lines
        a = a.format(n="Silworth", k=7).split("\n")
        assert adverts.without([*before, *a, *after]) == before + after, a
        assert adverts.without([*narrow[0], *a, *narrow[1]]) == [*narrow[0], *narrow[1]], a
    price = ["he paid £43 3s. 1d. for it", "£58", "15s. 5d. concerning"]
    assert adverts.without(price) == price and adverts.without([]) == []
    assert pages.Adverts().without(["TO LET, two rooms,", "Rent 19s. 4d. weekly."]) == ["TO LET, two rooms,", "Rent 19s. 4d. weekly."]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    lines, adverts = pages.ordered_pages(empty)
    assert lines.count() == 0 and not adverts.weights
    lines, adverts = pages.ordered_pages(spark.createDataFrame([(1, "a\nb\nc", 1, None, None)], SCHEMA).drop("source"))
    assert lines.first().lines == ["a", "b", "c"] and not adverts.weights


def test_unknown_adverts_are_read_both_ways():
    before, after = ["That narrow river planted his heavy ticket,", "while his own", "one."], ["settlement reached the shoe behind a garden", "and the long engine stood against his milk."]
    unknown = ["FOUND at Fenby,", "a grey parrot.", "Ask at the inn."]
    lines = [before[0], "and a cold wind met them on the long road", "late.", *unknown, *after]
    none = pages.Adverts()
    assert pages.readings(lines, none) == [lines, lines[:3] + after]
    assert pages.readings(before + after, none) == [before + after]
    assert pages.readings([], none) == [[]]
