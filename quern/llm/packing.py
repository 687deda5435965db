"""Filling fixed-capacity containers with texts by sum-of-squares packing.

Each text goes where the sum over all residual gaps of the squared number of open
containers with that gap becomes smallest.  Texts are placed in blocks of
bounded size, largest first; what lies in containers that are not full after the first
pass is taken out and placed again, in blocks of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tokens import TOKENIZERS, token_counts
from quern.plans.tables import written

#: Items of a block: large enough that a block wastes well under a thousandth, small enough for one task.
BLOCK_ITEMS = 20_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item, placed in the order given; sizes from 1 to `capacity`."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)
    where, made = np.empty(len(sizes), dtype=np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        # squares change by 2(n[g - s] - n[g]) + 2 if a gap g is used, by 2n[C - s] + 1 for a new container; full ones have no gap
        gaps = np.flatnonzero(count[size:])
        grow, target = (2 * int(count[capacity - size]) + 1 if size < capacity else 0), -1
        if len(gaps):
            change = 2 * (count[gaps] - count[gaps + size]) + 2
            if gaps[0] == 0:
                change[0] = 1 - 2 * count[size]
            best = int(change.argmin())
            if change[best] <= grow:
                target = int(gaps[best]) + size
        if target < 0:
            box, target, made = made, capacity, made + 1
        else:
            box = open_at[target].pop()
            count[target] -= 1
        where[i] = box
        if target > size:
            open_at[target - size].append(box)
            count[target - size] += 1
    return where


def _placed(items: DataFrame, level: str) -> DataFrame:
    """`items` with `box` and `used`, packed by `container_kind` and `block`."""

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        box = sum_of_squares(group["tokens"].to_numpy(), int(group["capacity"].iloc[0]))
        used = np.bincount(box, weights=group["tokens"].to_numpy())
        return group.assign(box=[f"{level}-{b}-{n}" for b, n in zip(group["block"], box)], used=used[box].astype(np.int64))

    schema = "container_kind string, capacity int, doc_id bigint, part int, start bigint, tokens bigint, block bigint, box string, used bigint"
    return items.groupBy("container_kind", "block").applyInPandas(place, schema)


def _blocks(items: DataFrame) -> DataFrame:
    """`items` with `block`: as many hash blocks for each kind as keep them near BLOCK_ITEMS."""
    sizes = items.groupBy("container_kind").agg(F.ceil(F.count("*") / BLOCK_ITEMS).alias("_blocks"))
    return items.join(F.broadcast(sizes), "container_kind").withColumn("block", F.pmod(F.xxhash64("doc_id", "part"), F.col("_blocks"))).drop("_blocks")


def pack_documents(docs: DataFrame, containers: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row `container_kind, container_id, capacity, used, texts` for each container.

    `texts` lists `doc_id, part, start, tokens`: the tokens `start` up to `start + tokens` of the
    document's encoding by the kind's tokenizer.  A text over the capacity is cut into
    full parts and a rest, any other text stays whole.  Null and empty texts are left out, and so
    are kinds without tokenizer or with no capacity; empty tables give no rows.  `containers` is a
    short list of settings, whose tokenizers are read by the driver.
    """
    kinds = containers.select("container_kind", "tokenizer", F.col("capacity").cast("int").alias("capacity")).where("capacity > 0 and tokenizer is not null and container_kind is not null").distinct()
    names = sorted(r[0] for r in kinds.select("tokenizer").distinct().collect())
    counts = written(token_counts(docs.select("doc_id", "text").where("text <> ''"), "doc_id", "text", names, folder).where("n_tokens > 0"), "counts")
    sized = counts.join(F.broadcast(kinds), "tokenizer")
    full, rest = F.floor(F.col("n_tokens") / F.col("capacity")), F.col("n_tokens") % F.col("capacity")
    filled = sized.where(full > 0).select("container_kind", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), (full - 1).cast("int"))).alias("part"))
    filled = filled.select("container_kind", "capacity", "doc_id", "part", (F.col("part").cast("long") * F.col("capacity")).alias("start"), F.col("capacity").cast("long").alias("tokens"), F.concat_ws("-", F.lit("f"), "doc_id", "part").alias("box"), F.col("capacity").cast("long").alias("used"))
    items = sized.where(rest > 0).select("container_kind", "capacity", "doc_id", full.cast("int").alias("part"), (F.col("n_tokens") - rest).alias("start"), rest.cast("long").alias("tokens"))

    first = written(_placed(_blocks(items), "a"), "first")
    again = first.where("used < capacity").drop("block", "box", "used")
    second = _placed(_blocks(again), "b")
    cols = ["container_kind", "capacity", "doc_id", "part", "start", "tokens", "box", "used"]
    packed = filled.select(*cols).unionByName(first.where("used = capacity").select(*cols)).unionByName(second.select(*cols))
    return packed.groupBy("container_kind", F.col("box").alias("container_id"), "capacity", "used").agg(F.array_sort(F.collect_list(F.struct("doc_id", "part", "start", "tokens"))).alias("texts"))


def fill_report(packed: DataFrame) -> DataFrame:
    """For each kind: containers, tokens, the least number that could hold them, and the share of unused space."""
    out = packed.groupBy("container_kind", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    return out.withColumn("at_least", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("unused", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity")))


def pack_check(docs: DataFrame, containers: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row `container_kind, doc_id, whole, fits, needless` for each document of each kind, from what `pack_documents` made.

    `whole`: its parts lie end to end from the first to the last token of the document, counted anew; `fits`: none of its
    containers holds more than its capacity, or other than what it says; `needless`: it is split though it fits a container.
    """
    packed = pack_documents(docs, containers, folder)
    held = packed.withColumn("_sum", F.aggregate("texts", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]))
    parts = held.select("container_kind", "capacity", ((F.col("used") <= F.col("capacity")) & (F.col("used") == F.col("_sum"))).alias("ok"), F.explode("texts").alias("t")).select("container_kind", "capacity", "ok", "t.*")
    one = parts.groupBy("container_kind", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "tokens"))).alias("p"), F.min("ok").alias("fits"), F.max("capacity").alias("capacity"))
    end = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: F.when(x["start"] == a, a + x["tokens"]).otherwise(F.lit(None)))
    kinds = containers.where("capacity > 0 and tokenizer is not null and container_kind is not null").select("container_kind", "tokenizer").distinct()
    names = sorted(r[0] for r in kinds.select("tokenizer").distinct().collect())
    counts = token_counts(docs.select("doc_id", "text").where("text <> ''"), "doc_id", "text", names, folder).where("n_tokens > 0").join(F.broadcast(kinds), "tokenizer").select("container_kind", "doc_id", "n_tokens")
    both = one.join(counts, ["container_kind", "doc_id"], "full_outer")
    return both.select("container_kind", "doc_id", F.coalesce(end == F.col("n_tokens"), F.lit(False)).alias("whole"), F.coalesce("fits", F.lit(False)).alias("fits"), F.coalesce((F.size("p") > 1) & (F.col("n_tokens") <= F.col("capacity")), F.lit(False)).alias("needless"))
