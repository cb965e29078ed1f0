"""Scanned pages: from the lines a scan gave back to the article lines as they were printed.

Small Python helpers that run inside Arrow batches; the pages are partitioned by Spark. ``ordered_pages``
brings every page's lines into reading order once and writes them. Small adverts are learnt from them, by one
aggregation over the corpus: where the layout shows an advert (three or more short lines in a row between full ones), the
words of these lines are counted, and those of all other short lines; a line whose words speak for an advert,
next to another such line, is one, also in narrow columns, whose lines are all short.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

ADVERT_LINE = 26  # letters of a short line; those of an advert line, at most four more
#: A word of adverts counts if it makes up this share of the pages, or of all words of advert lines (which bounds the table's size).
WORD_SHARE, TABLE_SHARE, LEAST_WORDS = 0.0005, 1 / 200_000, 3
MARGIN = -2.0  # log odds that a line's words must reach; below even, as a line counts only beside another
FLUSH_WORDS = 400_000
_GAP = re.compile(r"\s{3,}")
_TAIL = re.compile(r"[\-¬=­][\s.,;:'·~^|*]{0,2}$")
_DIGITS = re.compile(r"\d+")


def column_edges(x0: list[int], x1: list[int], columns: int) -> list[float]:
    """Left edges of the columns: clusters of line starts, or equal parts where a scan joined all lines."""
    edges: list[list[int]] = []
    for x in sorted(x0):
        if edges and x - edges[-1][-1] <= 45:
            edges[-1].append(x)
        else:
            edges.append([x])
    need = max(1, len(x0) // 60)
    found = [e for e in edges if len(e) >= need] or edges
    if len(found) >= columns:
        found = sorted(sorted(found, key=len, reverse=True)[:columns], key=lambda e: e[0])
        return [float(median(e)) for e in found]
    left, right = min(x0), max(x1)
    even = [left + (right - left) * i / columns for i in range(columns)]
    known = [float(median(e)) for e in found]
    return [min(known, key=lambda k: abs(k - e)) if min(abs(k - e) for k in known) < (right - left) / (2.5 * columns) else e for e in even]


def reading_order(lines: list[str], x0: list[int], y0: list[int], x1: list[int], columns: int) -> list[str]:
    """Lines of a page by column and height; lines run together across columns are parted at their wide gaps."""
    if columns <= 1 or len(lines) < 2:
        return lines
    whole = [i for i, s in enumerate(lines) if not _GAP.search(s.strip())]
    basis = whole if len(whole) > 2 else range(len(lines))
    edges = column_edges([x0[i] for i in basis], x1, columns)
    bounds = [(a + b) / 2 for a, b in zip(edges, edges[1:])]

    def column(x: float) -> int:
        k = 0
        while k < len(bounds) and x > bounds[k]:
            k += 1
        return k

    placed = []
    for i, s in enumerate(lines):
        if "   " not in s:
            placed.append((column(x0[i]), y0[i], i, s))
            continue
        at, width, first = 0, max(1, len(s)), column(x0[i])
        last = first - 1
        for part in _GAP.split(s):
            if not part:
                continue
            at = s.index(part, at)
            k = first if last < first else max(last + 1, column(x0[i] + (x1[i] - x0[i]) * at / width))
            placed.append((k, y0[i], i, part))
            at, last = at + len(part), k
    placed.sort(key=lambda p: p[:3])
    return [p[3] for p in placed]


def line_words(line: str) -> list[str]:
    """A line's words as they stand, digits folded, with its first and its last word marked as such."""
    words = _DIGITS.sub("#", line).split()
    if words:
        words[0], words[-1] = "^" + words[0], ("^" if len(words) == 1 else "") + words[-1] + "$"
    return words


def short_runs(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of three or more short lines between full ones, as adverts of any kind stand; a first line in small letters ends a paragraph and isn't of it."""
    full = sorted(map(len, lines))[len(lines) * 3 // 4] if lines else 0
    short = [len(s) <= min(ADVERT_LINE, 0.7 * full) for s in lines]
    i = 0
    while i < len(lines):
        end = i
        while end < len(lines) and short[end]:
            end += 1
        first = i + (end > i and lines[i][:1].islower())
        if i and end < len(lines) and end - first >= 3:
            yield first, end
        i = max(end, i + 1)


class Adverts:
    """What tells advert lines from other short lines: a weight for each word, one for words not listed, and one for lines as such. Without weights no line is one."""

    def __init__(self, weights: dict[str, float] | None = None, other: float = 0.0, prior: float = 0.0, margin: float = MARGIN) -> None:
        self.weights, self.other, self.prior, self.margin = weights or {}, other, prior, margin

    def speaks(self, line: str) -> bool:
        return len(line) <= ADVERT_LINE + 4 and self.prior + sum(self.weights.get(w, self.other) for w in line_words(line)) > self.margin

    def dropped(self, lines: list[str]) -> set[int]:
        """Places of advert lines: two or more next to each other, or with a single short line between them, which goes as well."""
        hit = [i for i, s in enumerate(lines) if self.speaks(s)] if self.weights else []
        drop: set[int] = set()
        for a, b in zip(hit, hit[1:]):
            if b - a == 1 or b - a == 2 and len(lines[a + 1]) <= ADVERT_LINE + 4:
                drop.update(range(a, b + 1))
        return drop

    def without(self, lines: list[str]) -> list[str]:
        drop = self.dropped(lines)
        return [s for i, s in enumerate(lines) if i not in drop] if drop else lines


def readings(lines: list[str], adverts: Adverts) -> list[list[str]]:
    """A page's lines without adverts, and where short runs are left over the same without these too, which may take headings and short lines along."""
    drop = adverts.dropped(lines)
    first = [s for i, s in enumerate(lines) if i not in drop] if drop else lines
    runs = {k for a, b in short_runs(lines) for k in range(a, b)}
    if runs <= drop:
        return [first]
    return [first, adverts.without([s for i, s in enumerate(lines) if i not in runs])]


def is_running_head(line: str, title: str | None) -> bool:
    """Whether a page's first line is its newspaper's title with number, day or price: half of the title's letter triples are in it, and not much else."""
    t, s = letters(title or ""), letters(line)
    triples = {t[i : i + 3] for i in range(len(t) - 2)}
    return len(triples) > 3 and len(s) <= len(t) + 25 and 2 * sum(g in s for g in triples) >= len(triples)


def ordered_lines(text: str | None, x0: list[int], y0: list[int], x1: list[int], columns: int | None, title: str | None = None) -> list[str]:
    """A page's lines in their printed order, without its running head.

    A null or empty text has none. Where boxes and lines don't match, the text's own order holds.
    """
    if not text:
        return []
    lines = text.split("\n")
    boxed = len(lines) == len(x0)
    head = 1 if len(lines) > 1 and is_running_head(lines[0], title) else 0
    lines = lines[head:]
    if boxed and columns and columns > 1:
        lines = reading_order(lines, x0[head:], y0[head:], x1[head:], columns)
    return [s for s in (s.strip() for s in lines) if s]


def joined_text(lines: list[str]) -> str:
    """One text of the lines; words broken with a mark at line ends are joined."""
    out = []
    for s in lines:
        m = _TAIL.search(s)
        out.append(s[: m.start()] if m and m.start() and s[m.start() - 1].isalpha() else s + " ")
    return "".join(out)


_ASCII_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
_OTHER = re.compile(r"[^\x00-\x7f]+")


def letters(text: str) -> bytes:
    """Letters and digits only, in lower case (UTF-8): a form that broken and split words don't change."""
    text = text.lower()
    if not text.isascii():
        text = _OTHER.sub(lambda m: "".join(c for c in m[0] if c.isalnum()), text)
    return text.encode().translate(None, _ASCII_MARKS)


def page_frame(documents: DataFrame, keep: Column | None = None) -> DataFrame:
    """The columns that pages are read from, pruned at the scan: ids, text, columns, left, top and right of the boxes, the title, and ``keep``."""
    box = [F.col(f"page_lines.{c}").alias(c) for c in ("x0", "y0", "x1")]
    title = F.col("source").cast("string") if "source" in documents.columns else F.lit(None).cast("string")
    kept = (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("keep")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("column_count").cast("int").alias("column_count"), *box, title.alias("title"), kept)


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages -> (doc_id, keep, lines) and, per partition, (word, inside, outside): how often advert runs and other short lines hold it; the empty word counts the lines."""
    names = ["doc_id", "keep", "lines", "word", "inside", "outside"]
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()

    def counts() -> pa.RecordBatch:
        words = list(inside.keys() | outside.keys())
        none = (pa.nulls(len(words), t) for t in (pa.int64(), pa.bool_(), pa.list_(pa.string())))
        cols = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (inside, outside))]
        return pa.RecordBatch.from_arrays([*none, *cols], names=names)

    for b in batches:
        texts, counts_, titles = (b.column(i).to_pylist() for i in (1, 2, 6))
        flat = [(c.offsets.to_pylist(), c.values.to_pylist()) for c in (b.column(i) for i in (3, 4, 5))]
        out = []
        for k, (t, c, title) in enumerate(zip(texts, counts_, titles)):
            box = [v[o[k] : o[k + 1]] for o, v in flat] if c and c > 1 else [[], [], []]
            lines = ordered_lines(t, *box, c, title)
            out.append(lines)
            runs = {i for a, z in short_runs(lines) for i in range(a, z)}
            for i, s in enumerate(lines):
                if i in runs:
                    inside.update(line_words(s))
                    inside[""] += 1
                elif len(s) <= ADVERT_LINE + 4:
                    outside.update(line_words(s))
                    outside[""] += 1
        if out:
            n = len(out)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(7), pa.array(out, pa.list_(pa.string())), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
        if len(inside) + len(outside) > FLUSH_WORDS:
            yield counts()
            inside.clear()
            outside.clear()
    if inside or outside:
        yield counts()


def learnt_adverts(read: DataFrame) -> Adverts:
    """The weights of words from the counts in a frame of ``_order``; naive Bayes with half a count added. A corpus without advert runs has none."""
    counted = read.where("word is not null")
    each = F.col("word") != ""
    pages, r, o, n1, n0 = (read.agg(
        F.count_if(F.col("word").isNull()), F.sum(F.when(each, F.col("inside"))), F.sum(F.when(each, F.col("outside"))), F.sum(F.when(~each, F.col("inside"))), F.sum(F.when(~each, F.col("outside"))),
    ).first())
    if not r:
        return Adverts()
    least = max(LEAST_WORDS, WORD_SHARE * pages, TABLE_SHARE * r)
    words = counted.where(each).groupBy("word").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b")).where(F.col("a") >= least).collect()  # at most 1 / TABLE_SHARE
    odds = lambda a, b: log((a + 0.5) / r) - log((b + 0.5) / ((o or 0) + 1))
    return Adverts({w: odds(a, b) for w, a, b in words}, odds(r - sum(a for _, a, _ in words), (o or 0) - sum(b for _, _, b in words)), log(n1 / (n0 or 1)))


def ordered_pages(documents: DataFrame, adverts: Adverts | None = None, keep: Column | None = None) -> tuple[DataFrame, Adverts]:
    """(doc_id, keep, lines) of every page, written, and the adverts learnt from them (or those handed over)."""
    read = materialize(page_frame(documents, keep).mapInArrow(_order, "doc_id long, keep boolean, lines array<string>, word string, inside long, outside long"), "pages")
    return read.where("word is null").select("doc_id", "keep", "lines"), learnt_adverts(read) if adverts is None else adverts
