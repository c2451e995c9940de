"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups (equal texts) stay together.  Large groups are units of their own; the
others are dealt by hash into ``cells`` cells a shard, and a cell is a unit.
Units are placed in the order of their size, each on the shard where the dot
product of its demand with the residual capacity is highest among the shards
that still have room for its bytes.  A group that is larger than a whole shard
in one of the three has to be split: it is dealt by id into the fewest pieces
that fit.

Only the units reach the driver: at most ``cells`` times ``shards`` cells and
three times as many groups, as each large group has at least that share
of all bytes, tokens or rows.  Numbers inside the shards are made from
counts of sub-groups, so no task holds a whole shard.

Defined results: null texts count as empty; rows with null or repeated ids are
kept one for one; only the id and the text are read; an empty table has no
shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextbest.llm.common import id_and_text, number_within, written

ROW_BYTES = 16
WEIGHTS = (1.0, 0.5, 0.5)


def place(units: np.ndarray, shards: int, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """A shard for each unit (rows of bytes, tokens, rows)."""
    total = np.maximum(units.sum(axis=0), 1)
    share = units / total * shards  # of a shard's fair part
    room = np.ones((shards, 3))
    out = np.zeros(len(units), dtype=np.int64)
    for i in np.lexsort((-share[:, 1], -share[:, 0])) if len(units) else []:
        need = share[i]
        score = (room * need * weights).sum(axis=1)
        fits = room[:, 0] >= need[0]
        best = int(np.argmax(np.where(fits, score, -np.inf))) if fits.any() else int(np.argmax(room[:, 0]))
        out[i] = best
        room[best] -= need
    return out


def balanced(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", cells: int = 256, sub_groups: int = 64) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, group): every row with its shard and its gapless number there."""
    spark = docs.sparkSession
    base = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    words = F.regexp_count("text", F.lit("[^ \\t-\\r]+"))
    rows = base.select("doc_id", (F.octet_length("text").cast("long") + ROW_BYTES).alias("size"), words.cast("long").alias("tokens"),
                       F.crc32("text").alias("text_crc32"), F.sha2("text", 256).alias("group"))
    rows = written(rows, "shard-rows")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")]
    groups = written(rows.groupBy("group").agg(*sums), "shard-groups")
    all_of = groups.agg(F.sum("size"), F.sum("tokens"), F.sum("n")).first()
    total = [int(x or 0) for x in all_of]
    large = F.lit(False)
    for name, t in zip(("size", "tokens", "n"), total, strict=True):
        if t:
            large = large | (F.col(name) * (shards * cells) >= F.lit(t))
    heavy = groups.where(large).select("group", "size", "tokens", "n").toPandas()  # at most 3 * shards * cells rows
    heavy["parts"] = [max(1, *(int(np.ceil(shards * x / t)) for x, t in zip(r, total, strict=True) if t)) for r in heavy[["size", "tokens", "n"]].itertuples(index=False)] if len(heavy) else []
    parts = spark.createDataFrame(heavy[["group", "parts"]].values.tolist(), "group string, parts int")
    cell = F.pmod(F.xxhash64("group"), F.lit(shards * cells))
    unit = F.when(F.col("parts").isNull(), F.concat(F.lit("c"), cell)).otherwise(
        F.concat("group", F.lit(":"), F.pmod(F.xxhash64("doc_id"), F.col("parts"))))
    dealt = rows.join(F.broadcast(parts), "group", "left").withColumn("unit", unit).drop("parts")
    units = dealt.groupBy("unit").agg(*sums).toPandas().sort_values("unit", ignore_index=True)
    at = place(units[["size", "tokens", "n"]].to_numpy(dtype=np.float64), shards)
    homes = spark.createDataFrame([(u, int(s)) for u, s in zip(units["unit"], at, strict=True)], "unit string, shard int")
    placed = dealt.join(F.broadcast(homes), "unit")
    sub = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(sub_groups, total[2] // (shards * 100_000))))
    return number_within(placed, ["shard"], ["doc_id", "group"], sub, "slot").select("doc_id", "size", "text_crc32", "shard", "slot", "group")
