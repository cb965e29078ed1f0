import random

from pyspark.sql import functions as F

from trivalent.llm import reading

EASY = "cat dog hat cup bed sun red big wet ran sat hit".split()
MID = EASY + "orchard basket village quickly brother painted station".split()
HARD = MID + "jurisdiction epistemology commensurability presupposition notwithstanding crystallisation".split()
SCHEMA = "doc_id long, text string, column_count int, page_lines array<struct<x0 int, y0 int, x1 int, y1 int, confidence float>>, features int"


def make(rng, words, length):
    return " ".join(" ".join(rng.choice(words) for _ in range(length)).capitalize() + "." for _ in range(25))


def test_levels_are_learnt_from_few_labels(spark):
    rng = random.Random(1)
    docs, truth = [], {}
    for i in range(400):
        level = 1 + i % 4
        truth[i] = level
        body = make(rng, (EASY, EASY + MID, MID, HARD)[level - 1], (4, 8, 14, 22)[level - 1])
        docs.append((i, body + (" Xq" + "z" * (i % 9)), 1, None, 0))
    docs += [(900, None, 1, None, 0), (901, "", 1, [], 0), (902, "word " * 200_000, 1, None, 0)]
    labels = [(i, r, min(4, max(1, truth[i] + (rng.random() < 0.1)))) for i in range(0, 400, 3) for r in (1, 2)] + [(1, 1, None), (1, 2, 9), (None, 1, 2), (5000, 1, 1)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(df, spark.createDataFrame(labels * 2, "doc_id long, rater int, reading_level int")).collect()}
    assert len(got) == 403 and set(got.values()) <= {1, 2, 3, 4}
    assert sum(got[i] == v for i, v in truth.items() if i % 3) / sum(1 for i in truth if i % 3) > 0.95


def test_without_labels_or_pages(spark):
    df = spark.createDataFrame([(1, "A cat sat.", 1, None, 0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, rater int, reading_level int")
    assert [tuple(r) for r in reading.reading_levels(df, none).collect()] == [(1, None)]
    assert reading.reading_levels(df.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1, 3)], "doc_id long, rater int, reading_level int")
    assert [tuple(r) for r in reading.reading_levels(df, one).collect()] == [(1, 3)]


def test_english_by_any_name(spark):
    names = {"en": True, "EN": True, " eng ": True, "en-GB": True, "English": True, "en_US": True, "de": False, "enm": False, "": False, None: False}
    df = spark.createDataFrame([(k,) for k in names], "lang string").withColumn("e", reading.is_english("lang"))
    assert {r.lang: r.e for r in df.collect()} == names


def test_label_sample_is_bounded(spark):
    labels = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(1).alias("rater"), F.lit(2).alias("reading_level"))
    assert reading.label_sample(labels, 50).count() == 50
