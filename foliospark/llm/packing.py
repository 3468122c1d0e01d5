"""Problem 8: items into containers of fixed capacity.

Vector bin packing by the dot-product heuristic: an open container takes, of all
items that fit its remaining tokens, segments and loss-bearing tokens, the one
whose size vector has the largest weighted dot product with what remains; when
nothing fits, the next container is opened. A text that alone exceeds the capacity
is cut into full pieces and a rest, and only then; with a limit on loss-bearing
tokens below the capacity, one that exceeds that limit alone is cut as well, so no
container breaks a limit. Loss-bearing tokens of pieces are counted, not estimated.

Scale: items are packed in blocks of about ``block_items``, chosen by hash, so
each task holds a bounded number whatever the source or size distribution. What
ends up in badly filled containers is packed again in new blocks, ``rounds`` times.

Defined results: documents without tokens need no room and come out with a null
container; ties go to the smaller id; null ids are left out; capacities that are
null or not positive are no task; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.token_sizes import DEFAULT_TOKENIZER, sizes
from foliospark.plans.scale import cut

BLOCK_ITEMS = 4096
#: Containers filled below this are taken apart and packed again.
GOOD_FILL = 0.97
#: A container holds at most one segment per so many tokens of capacity.
TOKENS_PER_SEGMENT = 32
RESULT = "bin_name string, container_id string, doc_id bigint, piece int, tokens bigint, loss_tokens bigint"
SCHEMA = "bin_name string, round int, block int, slot int, id bigint, piece int, tokens bigint, loss_tokens bigint, capacity bigint, filled bigint"


def pack_block(tokens: np.ndarray, loss: np.ndarray, capacity: int, max_segments: int, max_loss: int) -> np.ndarray:
    """Container number of each item; items must come in descending size, each within all limits."""
    n = len(tokens)
    slot = np.full(n, -1, dtype=np.int32)
    size = np.stack([tokens / capacity, np.full(n, 1.0 / max_segments), loss / max(1, max_loss)])
    weight = size.mean(1) / max(1e-12, size.mean(1).sum())
    weighted = size * weight[:, None]
    left = np.arange(n)
    k = 0
    while len(left):
        room, segments, room_loss = capacity, max_segments, max_loss
        took = []
        live = left
        while len(live) and segments:
            live = live[(tokens[live] <= room) & (loss[live] <= room_loss)]
            if not len(live):
                break
            rest = np.array([room / capacity, segments / max_segments, room_loss / max(1, max_loss)])
            best = live[int(np.argmax(rest @ weighted[:, live]))]
            took.append(best)
            room -= int(tokens[best])
            room_loss -= int(loss[best])
            segments -= 1
            live = live[live != best]
        if not took:
            raise ValueError("an item exceeds the limits on its own")
        slot[took] = k
        left = left[slot[left] < 0]
        k += 1
    return slot


def limits(capacity: int, tokens_per_segment: int, loss_share: float) -> tuple[int, int]:
    """Most segments and most loss-bearing tokens of a container."""
    return max(1, capacity // tokens_per_segment), max(1, int(capacity * loss_share))


def _packer(tokens_per_segment: int, loss_share: float, round_no: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["tokens", "loss_tokens", "id", "piece"], ascending=[False, False, True, True], kind="stable").reset_index(drop=True)
        capacity = int(p["capacity"].iloc[0])
        slot = pack_block(p["tokens"].to_numpy(), p["loss_tokens"].to_numpy(), capacity, *limits(capacity, tokens_per_segment, loss_share))
        p["slot"] = slot
        p["round"] = np.int32(round_no)
        p["filled"] = p.groupby("slot")["tokens"].transform("sum")
        return p[["bin_name", "round", "block", "slot", "id", "piece", "tokens", "loss_tokens", "capacity", "filled"]]

    return run


def _blocks(items: DataFrame, block_items: int, salt: int) -> DataFrame:
    counts = items.groupBy("bin_name").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block_items)).alias("n_blocks"))
    return items.join(F.broadcast(counts), "bin_name").withColumn("block", F.pmod(F.xxhash64("id", "piece", F.lit(salt)), F.col("n_blocks")).cast("int")).drop("n_blocks")


def pack(docs: DataFrame, bins: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, tokens_per_segment: int = TOKENS_PER_SEGMENT, loss_share: float = 1.0, block_items: int = BLOCK_ITEMS, rounds: int = 2) -> DataFrame:
    """(bin_name, container_id, doc_id, piece, tokens, loss_tokens): every document in every packing task."""
    sized = cut(sizes(docs, id_col, text_col, tokenizer=tokenizer).select(F.col(id_col).cast("bigint").alias("id"), "tokens", "loss_tokens", "context"))
    tasks = []
    for r in bins.where("bin_name is not null and capacity_tokens > 0").select("bin_name", "capacity_tokens").distinct().collect():  # a handful of packing tasks
        capacity = int(r["capacity_tokens"])
        most_loss = limits(capacity, tokens_per_segment, loss_share)[1]
        tasks.append(F.struct(F.lit(r["bin_name"]).alias("bin_name"), F.lit(capacity).cast("bigint").alias("capacity"), F.lit(min(capacity, most_loss)).cast("bigint").alias("unit"), F.lit(most_loss).cast("bigint").alias("most_loss")))
    if not tasks:
        return docs.sparkSession.createDataFrame([], RESULT)
    each = sized.withColumn("task", F.explode(F.array(*tasks))).select("task.*", "id", "tokens", "loss_tokens", "context")
    n_pieces = F.when((F.col("tokens") > F.col("capacity")) | (F.col("loss_tokens") > F.col("most_loss")), F.ceil(F.col("tokens") / F.col("unit"))).otherwise(1).cast("int")
    first, last = F.col("piece") * F.col("unit"), F.when(F.col("n") == 1, F.col("tokens")).otherwise(F.least(F.col("tokens"), (F.col("piece") + 1) * F.col("unit")))
    inside = F.aggregate("context", F.lit(0).cast("bigint"), lambda acc, x: acc + F.greatest(F.lit(0), F.least(F.col("b"), x["e"]) - F.greatest(F.col("a"), x["s"])))
    pieces = (
        each.where("tokens > 0")
        .withColumn("n", n_pieces)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumns({"a": first, "b": last})
        .select("bin_name", "capacity", "id", "piece", (F.col("b") - F.col("a")).alias("tokens"), (F.col("b") - F.col("a") - inside).alias("loss_tokens"))
    )
    alone = F.col("tokens") == F.col("capacity")
    whole = pieces.where(alone).select("bin_name", F.concat_ws("-", F.lit("whole"), "id", "piece").alias("container_id"), "id", "piece", "tokens", "loss_tokens")
    items = pieces.where(~alone)
    done = []
    for r in range(rounds):
        packed = cut(_blocks(items, block_items, 17 + r).groupBy("bin_name", "block").applyInPandas(_packer(tokens_per_segment, loss_share, r), SCHEMA))
        last = r == rounds - 1
        good = F.lit(True) if last else F.col("filled") >= F.lit(GOOD_FILL) * F.col("capacity")
        done.append(packed.where(good))
        items = packed.where(~good).select("bin_name", "capacity", "id", "piece", "tokens", "loss_tokens")
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    placed = placed.select("bin_name", F.concat_ws("-", F.concat(F.lit("r"), F.col("round")), "block", "slot").alias("container_id"), "id", "piece", "tokens", "loss_tokens")
    empty = each.where("tokens = 0").select("bin_name", F.lit(None).cast("string").alias("container_id"), "id", F.lit(0).alias("piece"), "tokens", "loss_tokens")
    return whole.unionByName(placed).unionByName(empty).select("bin_name", "container_id", F.col("id").alias("doc_id"), "piece", "tokens", "loss_tokens")


def fill_report(packed: DataFrame, bins: DataFrame, tokens_per_segment: int = TOKENS_PER_SEGMENT, loss_share: float = 1.0) -> DataFrame:
    """(bin_name, n_containers, n_items, tokens, fill, segment_fill, loss_fill, at_segments, at_loss): shares of each limit that are used, and containers that have reached the limits on segments and on loss-bearing tokens."""
    tasks = F.broadcast(bins.select("bin_name", F.col("capacity_tokens").cast("bigint").alias("capacity"), F.greatest(F.lit(1), F.floor(F.col("capacity_tokens") / tokens_per_segment)).alias("most"), F.greatest(F.lit(1), F.floor(F.col("capacity_tokens") * F.lit(loss_share))).alias("most_loss")))
    per = packed.where("container_id is not null").groupBy("bin_name", "container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"), F.sum("loss_tokens").alias("l")).join(tasks, "bin_name")
    share = lambda x, most: F.round(F.sum(x) / F.sum(most), 6)
    return per.groupBy("bin_name").agg(
        F.count("*").alias("n_containers"),
        F.sum("k").alias("n_items"),
        F.sum("t").alias("tokens"),
        share("t", "capacity").alias("fill"),
        share("k", "most").alias("segment_fill"),
        share("l", "most_loss").alias("loss_fill"),
        F.count_if(F.col("k") == F.col("most")).alias("at_segments"),
        F.count_if(F.col("l") >= F.lit(GOOD_FILL) * F.col("most_loss")).alias("at_loss"),
    )


def breaches(packed: DataFrame, docs: DataFrame, bins: DataFrame, tokens_per_segment: int = TOKENS_PER_SEGMENT, loss_share: float = 1.0, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(bin_name, n_documents, over_tokens, over_segments, over_loss, lost, divided): containers beyond a limit, documents whose pieces don't add up, and documents divided although within all limits."""
    tasks = F.broadcast(bins.select("bin_name", F.col("capacity_tokens").cast("bigint").alias("capacity"), F.greatest(F.lit(1), F.floor(F.col("capacity_tokens") / tokens_per_segment)).alias("most"), F.greatest(F.lit(1), F.floor(F.col("capacity_tokens") * F.lit(loss_share))).alias("most_loss")))
    per = packed.where("container_id is not null").groupBy("bin_name", "container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"), F.sum("loss_tokens").alias("l")).join(tasks, "bin_name")
    over = per.groupBy("bin_name").agg(F.count_if(F.col("t") > F.col("capacity")).alias("over_tokens"), F.count_if(F.col("k") > F.col("most")).alias("over_segments"), F.count_if(F.col("l") > F.col("most_loss")).alias("over_loss"))
    want = sizes(docs, tokenizer=tokenizer).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("tokens").alias("n"), F.col("loss_tokens").alias("n_loss"))
    got = packed.groupBy("bin_name", "doc_id").agg(F.sum("tokens").alias("t"), F.sum("loss_tokens").alias("l"), F.count("*").alias("k")).join(want, "doc_id").join(tasks, "bin_name")
    docs_of = got.groupBy("bin_name").agg(F.count("*").alias("n_documents"), F.count_if((F.col("t") != F.col("n")) | (F.col("l") != F.col("n_loss"))).alias("lost"), F.count_if((F.col("k") > 1) & (F.col("n") <= F.col("capacity")) & (F.col("n_loss") <= F.col("most_loss"))).alias("divided"))
    return docs_of.join(over, "bin_name").select("bin_name", "n_documents", "over_tokens", "over_segments", "over_loss", "lost", "divided")
