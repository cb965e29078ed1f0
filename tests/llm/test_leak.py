import random

from trivalent.llm import leak

WORDS = "lamp river orchard engine ticket meadow sailor butcher market village window garden soldier pocket lantern harvest station kitchen winter summer carriage brother sister teacher doctor".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing"]) for _ in range(n))


def page(doc, body, columns=1):
    lines = body.split("\n")
    boxes = [(60 if columns == 1 or i < len(lines) // 2 else 600, 20 * (i % max(1, len(lines) // columns)), 500 if columns == 1 or i < len(lines) // 2 else 1000, 0, 1.0) for i in range(len(lines))]
    return (doc, body, columns, [tuple(b) for b in boxes])


SCHEMA = "doc_id long, text string, column_count int, page_lines array<struct<x0 int, y0 int, x1 int, y1 int, confidence float>>"


def test_what_counts_as_a_leak(spark):
    rng = random.Random(3)
    items = [(1, text(rng, 60)), (2, "Read the passage. " + text(rng, 40) + " What came of it?"), (3, None), (4, "too short"), (5, text(rng, 30)), (6, "")]
    w1, w2 = items[0][1].split(), items[1][1].split()[3:43]
    around = lambda s: f"{text(rng, 40)} {s} {text(rng, 40)}"

    def broken(s, width=31):
        return "\n".join(s[i : i + width] + ("-" if s[i + width - 1 : i + width + 1].isalpha() else "") for i in range(0, len(s), width))

    def misread(s):
        out = list(s)
        for i in range(7, len(out), 23):
            out[i] = "*"
        return "".join(out)

    shuffled = w1[10:40]
    rng.shuffle(shuffled)
    docs = [
        page(10, around(" ".join(w1))), page(11, broken(around(" ".join(w1[20:36])))), page(12, around(misread(" ".join(w2)).upper())),
        page(13, around(" ".join(w1[5:14]))), page(14, around(" ".join(shuffled))), page(15, "\n".join([text(rng, 6), " ".join(w1[:8]), "TO LET, two rooms,", "Silworth Lane, No. 96.", "Rent 19s. 4d. weekly.", " ".join(w1[8:16]), text(rng, 6)])),
        page(16, broken(around(" ".join(w2[3:30]))), 2), (17, None, 1, None), (18, "", 2, []), page(19, text(rng, 20_000) + " " + " ".join(w1[30:50]) + " " + text(rng, 20_000)),
        (20, around(" ".join(w1)), 3, None), page(21, around(" ".join(w1[0:12]))), page(22, around(" ".join(w1[0:6]) + " and so on " + " ".join(w1[6:12]))),
    ]
    docs += [page(100 + i, text(rng, 80)) for i in range(60)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    its = spark.createDataFrame(items + items[:1] + [(7, items[0][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leak.leaked_pages(df, its).collect()}
    for i in (1, 7):  # a repeated item is found under each id
        assert {d for d, k in got if k == i} == {10, 11, 15, 19, 20, 21}
    assert {d for d, k in got if k == 2} == {12, 16} and {k for _, k in got} == {1, 2, 7}


def test_a_leak_in_very_many_pages_keeps_its_seeds(spark):
    rng = random.Random(4)
    item = text(rng, 30)
    docs = [page(i, f"{text(rng, 20)} {item} {text(rng, 20)}") for i in range(300)] + [page(1000 + i, text(rng, 70)) for i in range(50)]
    got = leak.leaked_pages(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(range(300))


def test_short_leaks_in_the_midst_of_an_item(spark):
    """Passages of 12 short words from every place of an item, a page each, clean and with two misread letters."""
    rng = random.Random(8)
    short = "cat dog hat sun box pig hen cow red wet big dry old met saw hit cut had one her his the a by".split()
    said = lambda n: " ".join(rng.choice(short) for _ in range(n))
    items = [(i, said(40)) for i in range(30)]
    docs, want = [], set()
    for i, t in items:
        at = i % 28
        s = list(" ".join(t.split()[at : at + 12]))
        if i % 2:
            for k in (len(s) // 6, len(s) // 3):
                s[k] = s[k] if s[k] == " " else "x"
        docs.append(page(i, f"{text(rng, 30)} {''.join(s)} {text(rng, 30)}"))
        want.add((i, i))
    docs += [page(10_000 + i, text(rng, 80)) for i in range(30)]
    got = leak.leaked_pages(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, text(rng, 25)) for i in range(12)]
    docs = [page(i, f"{text(rng, 20)} {t} {text(rng, 20)}") for i, t in items]
    df, its = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(leak, "BLOCK_LETTERS", 700)
    assert {(r.doc_id, r.item_id) for r in leak.leaked_pages(df, its).collect()} == {(i, i) for i, _ in items}
    assert leak.leaked_pages(df.limit(0), its).count() == 0 and leak.leaked_pages(df, its.limit(0)).count() == 0


def test_two_texts_of_one_id_and_the_exact_setting(spark):
    rng = random.Random(11)
    first, second = text(rng, 30), text(rng, 40)
    docs = [page(1, f"{text(rng, 20)} {first} {text(rng, 20)}"), page(2, f"{text(rng, 20)} {' '.join(second.split()[5:25])} {text(rng, 20)}"), page(3, text(rng, 60))]
    df, its = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, first), (1, second), (2, first)], "item_id long, text string")
    want = {(1, 1, 30), (2, 1, 20), (1, 2, 30)}
    assert {tuple(r) for r in leak.leaked_pages(df, its).collect()} == want
    assert {tuple(r) for r in leak.leaked_pages(df, its, least_seeds=1, least_fours=0).collect()} == want


def test_adverts_inside_a_leak(spark):
    """16 words of an item in full lines, an advert in their midst: of the kinds in the data and of an unknown one."""
    rng = random.Random(9)
    adverts = ["LOST near Fenby,\na small purse.\nReward 5s. 1d.", "Dr. Lomvell's PILLS\nfor all ills.\n67 cured in a week.\nPrice 14s. 6d.", "FOUND at Fenby,\na grey parrot.\nAsk at the inn."]
    items = [(i, text(rng, 30)) for i in range(len(adverts))]
    docs = []
    for (i, t), a in zip(items, adverts):
        w = t.split()
        docs.append(page(i, "\n".join([text(rng, 8), " ".join(w[4:12]), a, " ".join(w[12:20]), text(rng, 8), text(rng, 8)])))
    got = leak.leaked_pages(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.words) for r in got.collect()} == {(i, i, 16) for i, _ in items}
