"""Problem 7: passages of evaluation items inside a corpus of scanned pages.

1. Every page is brought into reading order, freed of adverts (``pages``) and brought to its bare letters; a page
   with short lines that may be an unknown advert is read both ways.
2. Every letter n-gram of an item is a seed, so a leak of any part has all of its seeds, however often
   it leaked. Seeds join pages to items; seeds that agree on one diagonal make a candidate.
3. A candidate goes on if near its seeds page and item share half of the 4-grams of some twelve consecutive words
   of the item; that leaves out common phrases, and is less than a leak with one letter in seven misread has.
4. A banded Smith-Waterman alignment of each candidate's letters finds the longest run of whole words
   that the page holds, whatever the scan did to single letters.

The items are a stated query set; it goes to the tasks in blocks of a checked size, as many as needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .pages import Adverts, joined_text, letters, ordered_pages, readings

GRAM = 12
LEAST_SEEDS = 4  # on one diagonal; the shortest leaks of 12 words hold so many with two misread letters
BLOCK, NEAR, SHIFT = 64, 48, 3  # letters of an item looked at together, of a stretch at least, to either side of the diagonal
LEAST_FOURS = 0.5  # share of a stretch's 4-grams
SIDE = 3 * BLOCK + SHIFT  # bytes between pages, so that what is looked at of one ends before the next
GROUP_LETTERS, GROUP_PAGES, CLOSE_ROWS = 200_000, 256, 4096  # of pages looked up at once, candidates compared at once
BAND = 16
MATCH, OTHER, GAP = 2, -3, -3
SLACK = 5
PAIRS, PAIR_CELLS = 512, 16_000_000  # aligned at once: at most so many pairs, and bytes of their paths
BLOCK_LETTERS = 4_000_000  # letters of items broadcast at once
_MUL = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def grams(text: bytes) -> np.ndarray:
    """64-bit hashes of all n-grams (n = 12) of a text."""
    if len(text) < GRAM:
        return np.zeros(0, dtype=np.uint64)
    h = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    for step, mul in zip((1, 2, 4), _MUL):
        four = h
        h = h[:-step] * mul + h[step:]
    # h holds 8-grams, four 4-grams: 12 = 8 + 4
    return (h[: len(text) - GRAM + 1] ^ (h[: len(text) - GRAM + 1] >> np.uint64(29))) * _MUL[3] + four[8 : 8 + len(text) - GRAM + 1]


class SeedIndex:
    """Sorted n-grams with their places in items, behind a bit table that turns most look-ups away."""

    def __init__(self, gram: np.ndarray, item: np.ndarray, pos: np.ndarray) -> None:
        order = np.argsort(gram, kind="stable")
        self.gram, first = np.unique(gram[order], return_index=True)
        self.item, self.pos = item[order], pos[order]
        self.first = np.append(first, len(gram))
        self.shift = np.uint64(64 - max(16, min(26, int(np.log2(len(gram) + 1)) + 4)))
        self.bits = np.zeros(1 << int(np.uint64(64) - self.shift), dtype=bool)
        self.bits[(self.gram >> self.shift).astype(np.int64)] = True

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in g that are in the index, and the index's number for each."""
        at = np.flatnonzero(self.bits[(g >> self.shift).astype(np.int64)])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.gram, g[at]), len(self.gram) - 1)
        same = self.gram[k] == g[at]
        return at[same], k[same]

    def candidates(self, g: np.ndarray, least: int, page: np.ndarray, pages: int) -> tuple[np.ndarray, ...]:
        """Item, page, diagonal, seeds and one seed's block of the diagonals with at least so many seeds; a row for each block of the item that has some.

        ``page`` tells which of the ``pages`` each place of ``g`` belongs to.
        """
        at, k = self.find(g)
        n = self.first[k + 1] - self.first[k]
        idx = np.repeat(self.first[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(at) else at
        pos, at = self.pos[idx].astype(np.int64), np.repeat(at, n)
        key = ((self.item[idx].astype(np.int64) * pages + page[at]) << 32) + at - pos + (1 << 31)
        order = np.argsort(key, kind="stable")
        key, block = key[order], pos[order] // BLOCK
        cut = np.flatnonzero(np.concatenate(([True], np.diff(key) > BAND // 2, [True]))) if len(key) else np.zeros(1, np.int64)
        sizes = np.diff(cut)
        enough = sizes >= least
        cluster = np.repeat(np.cumsum(enough) - 1, sizes)[np.repeat(enough, sizes)]
        wide = np.unique((cluster << 32) + block[np.repeat(enough, sizes)])
        cluster, block = wide >> 32, wide & 0xFFFFFFFF
        mid = key[cut[:-1][enough] + sizes[enough] // 2][cluster]
        return (mid >> 32) // pages, (mid >> 32) % pages, (mid & 0xFFFFFFFF) - (1 << 31), sizes[enough][cluster], block


def fours(text: np.ndarray) -> np.ndarray:
    """The 4-grams of a text of bytes as numbers."""
    t = text.astype(np.uint32)
    return t[:-3] | t[1:-2] << np.uint32(8) | t[2:-1] << np.uint32(16) | t[3:] << np.uint32(24)


class Letters:
    """The letters of all items in one array, items by place, and for each word's first letter the end of the stretch of so many words that begins there."""

    def __init__(self, words: dict[int, list[bytes]], least_words: int = 12) -> None:
        self.ids = np.array(sorted(words), dtype=np.int64)
        texts = [b"".join(words[i]) for i in self.ids.tolist()]
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        side = 3 * BLOCK  # so that blocks may reach beyond their item
        self.start = np.concatenate(([0], np.cumsum(self.size + 2 * side)[:-1])) + side
        self.text = np.frombuffer(b"".join(bytes(side) + t + bytes(side) for t in texts), dtype=np.uint8)
        self.fours = fours(self.text)
        self.stretch = np.zeros(len(self.text), dtype=np.int32)  # letters of the stretch, 0 where none begins
        for i, at in zip(self.ids.tolist(), self.start.tolist()):
            begin = np.concatenate(([0], np.cumsum([len(w) for w in words[i]])))
            self.stretch[at + begin[: -least_words]] = begin[least_words:] - begin[:-least_words]

    def close(self, page: np.ndarray, item: np.ndarray, diag: np.ndarray, block: np.ndarray, least: float = LEAST_FOURS) -> np.ndarray:
        """Which candidates share enough 4-grams with the text of the pages in some stretch around their block of seeds.

        ``page`` has at least ``SIDE`` bytes that are no letters on either side of what a candidate may reach.
        """
        if least <= 0:
            return np.ones(len(item), dtype=bool)
        out = np.zeros(len(item), dtype=bool)
        own, near = self.fours, fours(page)
        for a in range(0, len(item), CLOSE_ROWS):
            rows = slice(a, a + CLOSE_ROWS)
            begin, width = (block[rows] - 1) * BLOCK, 3 * BLOCK
            place = (self.start[item[rows]] + begin)[:, None] + np.arange(width - 3)
            mine = own[place]
            row = np.clip((begin + diag[rows] - SHIFT)[:, None] + np.arange(width - 3 + 2 * SHIFT), 0, len(near) - 1)
            theirs = near[row]
            same = theirs[:, : width - 3] == mine
            for s in range(1, 2 * SHIFT + 1):
                same |= theirs[:, s : s + width - 3] == mine
            sums = np.zeros((len(mine), width - 2), dtype=np.int32)
            np.cumsum(same, axis=1, dtype=np.int32, out=sums[:, 1:])
            r, at = np.nonzero(self.stretch[place[:, : width - NEAR]])
            # a stretch that goes on beyond what is looked at counts as far as that
            seen = np.minimum(self.stretch[place[r, at]], width - at)
            good = sums[r, at + seen - 3] - sums[r, at] >= least * (seen - 3)
            out[a + r[good]] = True
        return out


def item_words(text: str | None) -> list[bytes]:
    return [w for w in map(letters, (text or "").split()) if w]


def seed_index(all_letters: Letters) -> SeedIndex:
    """All n-grams of the items, with the items by place."""
    each = [grams(all_letters.text[a : a + n].tobytes()) for a, n in zip(all_letters.start, all_letters.size)]
    sizes = [len(g) for g in each]
    return SeedIndex(np.concatenate(each), np.repeat(np.arange(len(each), dtype=np.int32), sizes), np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]))


def _spell(adverts_of):
    """(doc_id, lines) -> (doc_id, letters), a row for each way to read a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adverts = adverts_of.value
        for b in batches:
            out = [(d, letters(joined_text(own))) for d, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for own in readings(lines, adverts)]
            if out:
                ids, texts = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary()).cast(pa.binary())], names=["doc_id", "letters"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    """Pages (doc_id, letters) in groups of bounded size; a longer page is a group of its own."""
    for b in batches:
        group, size = [], 0
        for d, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            group.append((d, s))
            size += len(s)
            if size >= GROUP_LETTERS or len(group) == GROUP_PAGES:
                yield group
                group, size = [], 0
        if group:
            yield group


def _seek(index_of, letters_of, least_seeds: int, least_fours: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = index_of.value, letters_of.value
        gap = b"\1" * SIDE
        for group in _grouped(batches):
            start = np.cumsum([SIDE, *(len(s) + SIDE for _, s in group)])
            whole = gap + b"".join(s + gap for _, s in group)
            page_of = np.repeat(np.arange(len(group)), np.diff(start))
            g = grams(whole)
            item, page, diag, seeds, block = index.candidates(g, least_seeds, np.concatenate((np.zeros(SIDE, np.int64), page_of)), len(group))
            if not len(item):
                continue
            close = known.close(np.frombuffer(whole, np.uint8), item, diag, block, least_fours)
            out = []
            local = diag[close] - start[page[close]]
            for p, i, at, n in sorted(set(zip(page[close].tolist(), item[close].tolist(), local.tolist(), seeds[close].tolist()))):
                d, s = group[p]
                a = max(0, at - BAND)
                out.append((d, int(known.ids[i]), at - a, n, s[a : max(0, at + int(known.size[i]) + BAND)]))
            if out:
                cols = list(zip(*out))
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "diag", "seeds", "piece"])

    return run


def align(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
    """Banded Smith-Waterman of many (item, piece, diagonal) at once: the piece's place of each item letter, -1 if unmatched."""
    size, n, w = len(pairs), max(len(a) for a, _, _ in pairs), 2 * BAND + 1
    item, page = np.zeros((size, n), np.uint8), np.full((size, n + w), 1, np.uint8)
    for r, (a, b, diag) in enumerate(pairs):
        item[r, : len(a)] = a
        lo = diag - BAND
        s, e = max(lo, 0), min(len(b), lo + n + w)
        if e > s:
            page[r, s - lo : e - lo] = b[s:e]
    score, ways = np.zeros((size, w), np.int32), np.zeros((n, size, w), np.int8)
    best, best_i, best_k = np.zeros(size, np.int32), np.zeros(size, np.int64), np.zeros(size, np.int64)
    ramp, edge = (np.arange(w) * -GAP).astype(np.int32), np.zeros((size, 1), np.int32)
    for i in range(n):
        step = np.where(page[:, i : i + w] == item[:, i : i + 1], MATCH, OTHER).astype(np.int32)
        step[item[:, i] == 0] = -100
        both, skip = score + step, np.concatenate((score[:, 1:], edge), axis=1) + GAP
        top = np.maximum(both, skip)
        way = np.where(both >= skip, 1, 2).astype(np.int8)
        way[top <= 0] = 0
        base = np.maximum(top, 0)
        score = np.maximum.accumulate(base + ramp, axis=1) - ramp
        way[score > base] = 3
        ways[i] = way
        m = score.max(axis=1)
        g = m > best
        if g.any():
            best[g], best_i[g], best_k[g] = m[g], i, score[g].argmax(axis=1)
    place, rows = np.full((size, n), -1, np.int64), np.arange(size)
    i, k, live = best_i, best_k, best > 0
    while live.any():
        way = np.where(live, ways[i, rows, k], 0)
        live = way > 0
        hit = (way == 1) & (page[rows, np.minimum(i + k, n + w - 1)] == item[rows, i])
        place[rows[hit], i[hit]] = (i + k)[hit]
        k = np.where(way == 2, k + 1, np.where(way == 3, k - 1, k))
        i = np.where((way == 1) | (way == 2), i - 1, i)
        live &= (i >= 0) & (k >= 0) & (k < w)
        i, k = np.maximum(i, 0), np.clip(k, 0, w - 1)
    return [place[r, : len(a)] for r, (a, _, _) in enumerate(pairs)]


def longest_run(place: np.ndarray, words: list[bytes]) -> int:
    """Most consecutive words of the item that the alignment holds.

    Inside a run half of a word's letters suffice; its first and last word must be there from end to end.
    Between two words the page may have at most ``SLACK`` letters that the item hasn't.
    """
    matched = place >= 0
    size = np.array([len(w) for w in words])
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    count = np.add.reduceat(matched.astype(np.int64), start)
    loose = np.where(size <= 2, count == size, count * 2 >= size)
    whole = loose & ((matched[start] & matched[start + size - 1]) | (count >= 0.8 * size))
    at = np.flatnonzero(matched)
    far = np.zeros(len(words), dtype=bool)  # words before which the page goes on with something else
    if len(at) > 1:
        jump = np.diff(place[at]) - np.diff(at) > SLACK
        far[np.searchsorted(start, at[1:][jump], side="right") - 1] = True
    cut = np.flatnonzero(np.concatenate(([True], (loose[1:] != loose[:-1]) | far[1:], [True])))
    best = 0
    for a, b in zip(cut[:-1], cut[1:]):
        if loose[a]:
            ends = np.flatnonzero(whole[a:b])
            if len(ends):
                best = max(best, int(ends[-1] - ends[0] + 1))
    return best


def _verify(words_of, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = words_of.value
        joined: dict[int, np.ndarray] = {}
        for b in batches:
            rows = list(zip(*[b.column(i).to_pylist() for i in range(4)]))
            for _, item, _, _ in rows:
                if item not in joined:
                    joined[item] = np.frombuffer(b"".join(words[item]), np.uint8)
            rows.sort(key=lambda r: len(joined[r[1]]))
            out, at = [], 0
            while at < len(rows):
                longest = len(joined[rows[min(at + PAIRS, len(rows)) - 1][1]])
                take = max(1, min(PAIRS, PAIR_CELLS // ((longest + 1) * (2 * BAND + 1))))
                some = rows[at : at + take]
                at += take
                hits = align([(joined[i], np.frombuffer(p, np.uint8), g) for _, i, g, p in some])
                for (d, i, _, _), m in zip(some, hits):
                    if (r := longest_run(m, words[i])) >= least_words:
                        out.append((d, ids[i], r))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "words"])

    return run


def leaked_pages(
    documents: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", least_words: int = 12,
    least_seeds: int = LEAST_SEEDS, least_fours: float = LEAST_FOURS, adverts: Adverts | None = None,
) -> DataFrame:
    """(doc_id, item_id, words): pages that hold at least ``least_words`` consecutive words of an item.

    ``words`` is the longest such run. Capitals, punctuation, broken lines, adverts, column order and
    single misread letters don't matter; the order of words does. Items of fewer words, null and empty
    texts on either side give nothing; items repeated under other ids are found under each, one given
    twice under one id counts once, and of different texts under one id each is sought. Pages are taken whole. Extra columns are ignored.
    ``documents`` has the columns doc_id, text, column_count and page_lines, and source where titles are known.
    With ``least_seeds`` 1 and ``least_fours`` 0 every page that shares one n-gram of 12 letters with an item is aligned.
    ``adverts`` are learnt from the pages unless handed over; ``Adverts()`` knows none.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    none = "doc_id long, item_id long, words int"
    slim = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = slim.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if not total:
        return spark.createDataFrame([], none)
    blocks = int(total // BLOCK_LETTERS) + 1
    lines, known_adverts = ordered_pages(documents, adverts)
    spelt = lines.select("doc_id", "lines").mapInArrow(_spell(sc.broadcast(known_adverts)), "doc_id long, letters binary")
    if blocks > 1:  # read once for every block of items
        spelt = materialize(spelt, "letters")
    parts = []
    for block in range(blocks):
        own = slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else slim
        # numbered in the block, as one id may have several texts
        listed = [(i, w) for i, t in own.orderBy("item_id", "text").collect() if len(w := item_words(t)) >= least_words]
        if not listed:
            continue
        words = {n: w for n, (_, w) in enumerate(listed)}
        known = Letters(words, least_words)
        words_of, index_of, letters_of = sc.broadcast((words, [i for i, _ in listed])), sc.broadcast(seed_index(known)), sc.broadcast(known)
        sought = spelt.mapInArrow(_seek(index_of, letters_of, least_seeds, least_fours), "doc_id long, item_id long, diag int, seeds int, piece binary")
        checked = sought.repartition("doc_id", "item_id").select("doc_id", "item_id", "diag", "piece").mapInArrow(_verify(words_of, least_words), none)
        parts.append(checked)
    if not parts:
        return spark.createDataFrame([], none)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
