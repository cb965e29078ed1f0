"""Problem 8: how demanding the article text of each page is, by a familiar-word formula.

The shares of words outside high-frequency lists, taken from the document frequencies of the whole
corpus, and the average sentence length are weighed into four levels. The lists are nested: each holds a share of the
words, the most frequent ones, so the bounds are quantiles of the document frequencies. Words that hardly any document
has are misread words, broken pieces and names; they count neither as familiar nor as unfamiliar.

The weights are fitted on a bounded sample of readers' labels (``LABELS`` rows, those of the least
hash); counts, lists and scores cover every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .pages import Adverts, joined_text, ordered_pages

#: The lists: the most frequent 30 %, 28 % and so on to 2 % of all words counted, by their document frequencies.
LISTS = tuple(round(0.02 * k, 2) for k in range(15, 0, -1))
#: A word of fewer documents than this share isn't counted; so the lexicon has at most (words a page) / KNOWN entries.
KNOWN = 0.002
LABELS = 20_000
LEVELS = 4
RIDGE = 1e-4
UNLIKELY = 0.15
FLUSH_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_END = re.compile(r"(?<!\bMr)(?<!\bMrs)(?<!\bNo)(?<!\blb)[.!?](?=\s+[\"'A-Z0-9£]|\s*$)")


def is_english(lang: Column | str) -> Column:
    """Whether a language tag names English: en, EN, eng, en-GB, English and the like."""
    c = F.col(lang) if isinstance(lang, str) else lang
    return F.coalesce(F.lower(F.trim(c)).rlike(r"^(en|eng|english)([-_ (/].*)?$"), F.lit(False))


def _read(adverts_of):
    """(doc_id, keep, lines) -> (doc_id, sentences, words) of the pages to keep and, per partition, (word, documents) of all."""
    names = ["doc_id", "sentences", "words", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adverts = adverts_of.value
        seen: Counter[str] = Counter()

        def counts() -> pa.RecordBatch:
            none = pa.nulls(len(seen), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.nulls(len(seen), pa.int32()), pa.nulls(len(seen), pa.string()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=names)

        for b in batches:
            ids, ends, texts = [], [], []
            for d, keep, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                text = joined_text(adverts.without(lines))
                words = _WORD.findall(text.lower())
                seen.update(set(words))
                if keep:
                    ids.append(d)
                    ends.append(max(1, len(_END.findall(text))))
                    texts.append(" ".join(words))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends, pa.int32()), pa.array(texts, pa.string()), pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.int64())], names=names)
            if len(seen) > FLUSH_WORDS:
                yield counts()
                seen.clear()
        if seen:
            yield counts()

    return run


def _measure(rank_of, lists: int):
    """(doc_id, sentences, words) -> (doc_id, features): shares outside each list, log of words a sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = rank_of.value
        for b in batches:
            out = np.zeros((b.num_rows, lists + 1))
            for i, (ends, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                words = text.split()
                held = np.bincount([rank[w] for w in words if w in rank], minlength=lists + 1)
                # held[k]: words in exactly the first k lists, which are the widest ones
                out[i, :lists] = np.cumsum(held)[:lists] / max(1, held.sum())
                out[i, lists] = np.log(max(1, len(words)) / ends)
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (lists + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["doc_id", "features"])

    return run


def list_bounds(frequencies: np.ndarray, shares: tuple[float, ...] = LISTS) -> np.ndarray:
    """The document frequency from which a word is among the most frequent of each share of the words."""
    return np.quantile(frequencies, 1 - np.array(shares), method="inverted_cdf") if len(frequencies) else np.zeros(len(shares))


def page_features(documents: DataFrame, keep: Column | None = None, adverts: Adverts | None = None) -> DataFrame:
    """(doc_id, features) of the pages to ``keep`` (all unless given); document frequencies count every page given."""
    sc = documents.sparkSession.sparkContext
    lines, known = ordered_pages(documents, adverts, keep)
    read = materialize(lines.mapInArrow(_read(sc.broadcast(known)), "doc_id long, sentences int, words string, word string, n long"), "words")
    docs = read.where("word is null")
    total = lines.count()
    # at most (words a page) / KNOWN entries
    common = read.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, KNOWN * total)).toPandas()
    n = common["n"].to_numpy().astype(np.int64)
    rank = dict(zip(common["word"], (n[:, None] >= list_bounds(n)[None, :]).sum(axis=1).tolist()))
    return docs.select("doc_id", "sentences", "words").mapInArrow(_measure(sc.broadcast(rank), len(LISTS)), "doc_id long, features array<double>")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _newton(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Multinomial logistic weights (features x levels) with a small ridge."""
    n, d = x.shape
    hot, b = np.eye(LEVELS)[y], np.zeros((d, LEVELS))
    for _ in range(rounds):
        p = _softmax(x @ b)
        grad = x.T @ (p - hot) / n + RIDGE * b
        hess = np.zeros((LEVELS * d, LEVELS * d))
        for i in range(LEVELS):
            for j in range(LEVELS):
                w = p[:, i] * ((i == j) - p[:, j])
                hess[i * d : (i + 1) * d, j * d : (j + 1) * d] = (x * w[:, None]).T @ x / n
        hess[np.diag_indices_from(hess)] += RIDGE
        step = np.linalg.solve(hess, grad.T.ravel()).reshape(LEVELS, d).T
        b -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return b


class Formula:
    """Centred features times weights; the level of the largest score."""

    def __init__(self, features: np.ndarray, levels: np.ndarray) -> None:
        self.mean, self.scale = features.mean(axis=0), features.std(axis=0) + 1e-9
        x, y = self._design(features), levels - 1
        b = _newton(x, y)
        likely = _softmax(x @ b)[np.arange(len(y)), y] > UNLIKELY  # raters err; what the first fit finds unlikely is left out
        self.weights = _newton(x[likely], y[likely]) if likely.any() else b

    def _design(self, features: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(features)), (features - self.mean) / self.scale])

    def levels(self, features: np.ndarray) -> np.ndarray:
        return (self._design(features) @ self.weights).argmax(axis=1) + 1


def usable_labels(labels: DataFrame) -> DataFrame:
    """Each reader's label of a page once, without nulls and impossible levels."""
    usable = labels.where(F.col("reading_level").between(1, LEVELS) & F.col("doc_id").isNotNull())
    return usable.select(F.col("doc_id").cast("long").alias("doc_id"), "rater", F.col("reading_level").cast("int").alias("reading_level")).distinct()


def label_sample(labels: DataFrame, most: int = LABELS) -> DataFrame:
    """At most ``most`` rows of ``usable_labels``, those of the least hash."""
    return labels.orderBy(F.xxhash64("doc_id", "rater", "reading_level"), "doc_id", "rater", "reading_level").limit(most)


def reading_levels(documents: DataFrame, labels: DataFrame, keep: Column | None = None, adverts: Adverts | None = None, most: int = LABELS) -> DataFrame:
    """(doc_id, reading_level) of every page to ``keep`` (all unless given), on the levels of ``labels``.

    Document frequencies count every page given. The weights are fitted on at most ``most`` labels of pages that are kept.
    A page without words has the level that no words and one sentence come to. Without any usable label
    there is no scale, and the level is null. A page filed twice under two ids has a row for each;
    an empty corpus gives no row. Extra columns are ignored. Pages are read whole. ``adverts`` are learnt from the
    pages unless handed over; ``Adverts()`` knows none.
    """
    sc = documents.sparkSession.sparkContext
    features = materialize(page_features(documents, keep, adverts), "features")
    scored = usable_labels(labels).join(features.select("doc_id"), "doc_id", "left_semi")
    sample = label_sample(scored, most).join(features, "doc_id").select("features", "reading_level").toPandas()
    if not len(sample):
        return features.select("doc_id", F.lit(None).cast("int").alias("reading_level"))
    formula_of = sc.broadcast(Formula(np.array(sample["features"].tolist()), sample["reading_level"].to_numpy().astype(int)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(formula_of.value.levels(x), pa.int32())], names=["doc_id", "reading_level"])

    return features.mapInArrow(run, "doc_id long, reading_level int")
