"""Problem 6: filling containers of fixed capacity with texts, by vector bin packing.

An item has three demands: tokens, one segment, and the tokens that bear loss; a container has a
limit on each (``container_limits``). Items larger than a container are cut into full containers and a rest. The rests and
the smaller items are spread over shards of bounded size by hash; in each shard the dot-product
heuristic opens one container after the other and adds the fitting item whose demand points most
into the room that is left. Items of poorly filled containers go into a second round of fewer shards.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

SHARD_ITEMS = 6000
FULL_ENOUGH = 0.985
#: A container takes a segment for so many of its tokens, and ``LEAST_SEGMENTS`` at least.
SEGMENT_TOKENS, LEAST_SEGMENTS = 128, 4
#: A container's share of loss-bearing tokens may exceed that of all the budget's texts by this factor.
LOSS_ROOM = 1.015
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Names and three-letter codes of languages beside their two-letter codes.
LANGUAGES = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "fra": "fr", "fre": "fr", "french": "fr", "francais": "fr", "français": "fr",
    "spa": "es", "spanish": "es", "ita": "it", "italian": "it", "nld": "nl", "dut": "nl", "dutch": "nl", "por": "pt", "portuguese": "pt",
}


def norm_lang(col: Column | str) -> Column:
    """A language tag as its two-letter code where known: EN, eng, en-GB and English are all ``en``."""
    c = F.regexp_extract(F.lower(F.trim(F.col(col) if isinstance(col, str) else col)), r"^([^-_ (/]*)", 1)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, c), F.nullif(c, F.lit("")))


@lru_cache(maxsize=2)
def _encoding(name: str, pattern: str):
    import tiktoken
    from pyspark import SparkFiles

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """(doc_id, lang, tokens, loss_tokens) of every non-empty text; loss falls on all tokens but those of the first line.

    ``vocabulary`` is a file of the driver's or of a shared file system, which Spark hands to the tasks; ``pattern`` parts a text into words (that of the public tokenizers unless given).
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(name, pattern)
        for b in batches:
            tokens, loss = [], []
            for t in b.column(2).to_pylist():
                ids = encoding.encode_ordinary(t)
                line, at = len(t[: t.find("\n") + 1].encode()), 0
                while line > 0:  # the first line's tokens, from the one encoding
                    line -= len(encoding.decode_single_token_bytes(ids[at]))
                    at += 1
                tokens.append(len(ids))
                loss.append(len(ids) - at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens, pa.int64()), pa.array(loss, pa.int64())], names=["doc_id", "lang", "tokens", "loss_tokens"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), norm_lang("lang").alias("lang"), "text").where("length(text) > 0 and doc_id is not null")
    return texts.mapInArrow(run, "doc_id long, lang string, tokens long, loss_tokens long").where("tokens > 0")


def pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """Container number of each item, by the dot-product heuristic; every item must have a container's tokens at most.

    An item that alone bears more loss than the limit has a container to itself.
    """
    room0 = np.array(limits, dtype=np.float64)
    n = len(tokens)
    out = np.full(n, -1, dtype=np.int64)
    demand = np.column_stack([tokens / room0[0], np.full(n, 1 / room0[1]), loss / room0[2]])
    order = np.lexsort((-loss, -tokens))
    demand = demand[order] * demand.mean(axis=0)  # dimensions weigh by how scarce they are
    tok, los = tokens[order].astype(np.int64), loss[order].astype(np.int64)
    left, number = np.arange(n), 0
    while len(left):
        room = np.array(limits, dtype=np.int64)
        taken = []
        alive = np.ones(len(left), dtype=bool)
        t, c, d = tok[left], los[left], demand[left]
        while room[1] > 0:
            first = int(np.searchsorted(-t, -room[0]))  # larger items don't fit: tokens fall along the list
            if first == len(t):
                break
            fits = alive[first:] & ((c[first:] <= room[2]) | (not taken))
            score = np.where(fits, d[first:] @ (room / room0), -1.0)
            k = int(score.argmax())
            if score[k] < 0:
                break
            k += first
            alive[k] = False
            taken.append(left[k])
            room -= (t[k], 1, c[k])
            if room[2] < 0:
                break
        out[order[taken]] = number
        number += 1
        left = left[alive]
    return out


def _pack_shard(table: pa.Table) -> pa.Table:
    table = table.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]).combine_chunks()
    limits = tuple(table[c][0].as_py() for c in ("capacity_tokens", "most_segments", "most_loss"))
    bins = pack(table["tokens"].to_numpy(), table["loss_tokens"].to_numpy(), limits)
    used = np.bincount(bins, weights=table["tokens"].to_numpy()).astype(np.int64)[bins] if len(bins) else bins
    return table.append_column("bin", pa.array(bins, pa.int64())).append_column("used", pa.array(used, pa.int64()))


def _budget_items(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, capacity_tokens, doc_id, tokens, loss_tokens): every text once for each budget it belongs to."""
    usable = budgets.where("capacity_tokens > 0 and budget_id is not null").select("budget_id", F.col("capacity_tokens").cast("long").alias("capacity_tokens"), F.coalesce(norm_lang("lang"), F.lit("*")).alias("key"))
    once = sizes.groupBy("doc_id").agg(F.min(F.struct("tokens", "loss_tokens", "lang")).alias("s")).select("doc_id", "s.*")
    keyed = once.withColumn("key", F.explode(F.array_distinct(F.array(F.lit("*"), F.coalesce("lang", F.lit("*"))))))
    return keyed.join(usable, "key").select("budget_id", "capacity_tokens", "doc_id", "tokens", "loss_tokens")


def container_limits(sizes: DataFrame, budgets: DataFrame, segment_tokens: int = SEGMENT_TOKENS, loss_share: float | None = None) -> DataFrame:
    """(budget_id, capacity_tokens, most_segments, most_loss) of every budget that has texts.

    ``segment_tokens``: a segment for so many tokens of the capacity, four at least. ``loss_share``: loss-bearing tokens as a
    share of the capacity; unless given it is their share of all tokens of the budget's texts, and ``LOSS_ROOM`` more.
    """
    agg = _budget_items(sizes, budgets).groupBy("budget_id", "capacity_tokens").agg(F.sum("loss_tokens").alias("l"), F.sum("tokens").alias("t"))
    share = F.lit(loss_share) if loss_share is not None else F.col("l") / F.col("t") * LOSS_ROOM
    cap = F.col("capacity_tokens")
    return agg.select("budget_id", cap, F.greatest(F.lit(LEAST_SEGMENTS), F.floor(cap / segment_tokens)).cast("long").alias("most_segments"), F.least(cap, F.greatest(F.lit(1), F.floor(cap * share))).cast("long").alias("most_loss"))


def fill_containers(sizes: DataFrame, budgets: DataFrame, limits: DataFrame | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(budget_id, container, doc_id, piece, start_token, tokens, loss_tokens): each text in its container.

    ``sizes`` is a written frame as of ``token_sizes``; ``budgets`` has budget_id, capacity_tokens and
    lang (null: all). A text of more tokens than the capacity gives pieces of the full capacity, in
    containers of their own, and a rest; all others stay whole (piece 0). A container holds at most the
    capacity in tokens, and at most what ``limits`` (``container_limits`` unless given) say of segments and loss-bearing tokens; only
    a text or piece that alone bears more loss than that has a container to itself.
    Documents repeated under one id are packed once. Budgets with a null or non-positive capacity and
    budgets without texts give no rows. Equal sizes are taken by rising id.
    """
    limits = container_limits(sizes, budgets) if limits is None else limits
    known = limits.select("budget_id", "most_segments", "most_loss")
    items = _budget_items(sizes, budgets)
    full = F.floor(F.col("tokens") / F.col("capacity_tokens")).cast("int")
    cut = (
        items.where(F.col("tokens") >= F.col("capacity_tokens"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), full - 1)))
        .select(
            "budget_id", F.concat_ws("-", F.lit("w"), "doc_id", "piece").alias("container"), "doc_id", "piece",
            (F.col("piece") * F.col("capacity_tokens")).cast("long").alias("start_token"), F.col("capacity_tokens").alias("tokens"),
            # the first line, which bears no loss, lies at the front
            F.greatest(F.lit(0), F.least(F.col("capacity_tokens"), (F.col("piece") + 1) * F.col("capacity_tokens") - F.col("tokens") + F.col("loss_tokens"))).cast("long").alias("loss_tokens"),
        )
    )
    start = F.col("tokens") - F.col("tokens") % F.col("capacity_tokens")
    rest = items.where(F.col("tokens") % F.col("capacity_tokens") > 0).join(F.broadcast(known), "budget_id").select(
        "budget_id", "capacity_tokens", "most_segments", "most_loss", "doc_id", full.alias("piece"), start.alias("start_token"),
        (F.col("tokens") - start).alias("tokens"), F.least(F.col("loss_tokens"), F.col("tokens") - start).alias("loss_tokens"),
    )  # fmt: skip; limits: a row a budget

    def packed(frame: DataFrame, round_: int) -> DataFrame:
        """One round: shards of at most about ``shard_items`` of each budget."""
        counts = {r[0]: r[1] for r in frame.groupBy("budget_id").count().collect()}  # one row a budget
        shards = F.lit(1)
        if counts:
            table = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, -(-v // shard_items))])
            shards = F.element_at(table, F.col("budget_id"))
        sharded = frame.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_)), shards).cast("int"))
        schema = T.StructType([*sharded.schema.fields, T.StructField("bin", T.LongType()), T.StructField("used", T.LongType())])
        spread = sharded.groupBy("budget_id", "shard").applyInArrow(_pack_shard, schema)
        return spread.withColumn("container", F.concat_ws("-", F.lit(f"r{round_}"), "shard", "bin"))

    first = materialize(packed(materialize(rest, "rests"), 1), "packed")
    good = F.col("used") >= FULL_ENOUGH * F.col("capacity_tokens")
    second = packed(first.where(~good).select(*rest.columns), 2)
    columns = ["budget_id", "container", "doc_id", "piece", "start_token", "tokens", "loss_tokens"]
    return cut.select(*columns).unionByName(first.where(good).select(*columns)).unionByName(second.select(*columns))


def container_loads(filled: DataFrame, limits: DataFrame) -> DataFrame:
    """(budget_id, container, limits, tokens, segments, loss_tokens, closed_by): what each container holds, and the limit that leaves least room for a further text."""
    held = filled.groupBy("budget_id", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss_tokens"))
    loss_room, room = F.col("most_loss") - F.col("loss_tokens"), F.col("capacity_tokens") - F.col("tokens")
    by = F.when(room == 0, "tokens").when(F.col("segments") >= F.col("most_segments"), "segments").when(loss_room < room, "loss").otherwise("tokens")
    return held.join(F.broadcast(limits), "budget_id").withColumn("closed_by", by)
