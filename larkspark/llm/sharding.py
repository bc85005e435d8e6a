"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Tokens are the words of a text (runs without white space), counted over the whole text, or a column that the
caller has counted by a tokenizer of its own (tokens_col). The result has them, so their balance can be checked.

Rows with equal texts are a group and stay together, unless the group alone holds more than a shard's share;
then it is split by a hash of the id. A group goes to the shard where the dot product of its size vector with
the shard's residual capacity is highest, of equal ones to the first. Groups that hold a notable part of a shard
are placed first; their number is bounded by that part. The others are dealt by a hash into tasks of bounded
size, each of which places its groups, largest first, into its part of the residual capacities. Slots are
numbered by counts for each bucket of ids, so no task holds a shard.

The law is `bytes`: the shards' bytes are near equal.

Defined results: a null text has no bytes and no words, like the empty one, and belongs to its group. A text of
any length is one row; its bytes and words are counted by the engine. Groups of equal size are placed in the
order of their texts' digests. Rows with the same id or null ids are placed and numbered each for itself. An empty
table gives an empty result. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: A group that holds over 1 / NOTABLE of a shard's share of any measure is placed first: 3 * shards * NOTABLE groups at most.
NOTABLE = 400
#: Parts of a group that is larger than a shard's share.
PARTS = 64
GROUPS_PER_TASK = 20_000
ROWS_PER_BUCKET = 50_000
MEASURES = ("bytes", "tokens", "rows")
#: A word: a run without white space.
WORD = r"[^\x20\x09-\x0D]+"


def place(sizes: list[tuple[float, float, float]], residual: list[list[float]]) -> list[int]:
    """The shard of each size vector, in the given order; residual (shards by measures) is reduced in place.

    Where the highest dot product is not positive the shards are full, and the same rule goes on below zero.
    """
    out = []
    shards = range(len(residual))
    for a, b, c in sizes:
        best = max(shards, key=lambda s: a * residual[s][0] + b * residual[s][1] + c * residual[s][2])  # noqa: B023
        r = residual[best]
        r[0] -= a
        r[1] -= b
        r[2] -= c
        out.append(best)
    return out


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """Returns id, size (bytes and 1), text_crc32, law, shard, slot, grown_shard, tokens."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = text.cast("binary")
    words = F.coalesce(F.col(tokens_col), F.lit(0)).cast("long") if tokens_col else F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), words.alias("tokens"), F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("key"))
    rows = cut(rows, "sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return rows.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
    share = {m: max(total[m], 1) / shards for m in MEASURES}
    # At most 3 * shards groups can be larger than a shard's share.
    large = rows.groupBy("key").agg(*sums).filter(" or ".join(f"{m} > {share[m]!r}" for m in MEASURES)).select("key").collect()
    part = F.lit(-1)
    if large:
        part = F.when(F.col("key").isin([bytes(r["key"]) for r in large]), F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).otherwise(part)
    rows = rows.withColumn("part", part)
    groups = cut(rows.groupBy("key", "part").agg(*sums), "groups")
    notable = " or ".join(f"{m} > {share[m] / NOTABLE!r}" for m in MEASURES)
    scaled = lambda r: tuple(r[m] / share[m] for m in MEASURES)
    first = sorted(groups.filter(notable).collect(), key=lambda r: (-max(scaled(r)), bytes(r["key"]), r["part"]))
    residual = [[1.0, 1.0, 1.0] for _ in range(shards)]
    where = place([scaled(r) for r in first], residual)
    spark = docs.sparkSession
    placed = spark.createDataFrame([(bytes(r["key"]), r["part"], s) for r, s in zip(first, where, strict=True)], "key binary, part int, shard int")
    small = groups.filter(f"not ({notable})")
    left = small.agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in MEASURES]).first()
    tasks = max(1, round((left["n"] or 0) / GROUPS_PER_TASK))

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = [tuple(x / share[m] for x, m in zip(r, MEASURES, strict=True)) for r in zip(rows["bytes"], rows["tokens"], rows["rows"], strict=True)]
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i][0], bytes(rows["key"].iloc[i]), rows["part"].iloc[i]))
        # This task's part of each shard's residual capacity is its part of what is left to place.
        own = [sum(s[m] for s in sizes) for m in range(3)]
        all_ = [sum(r[m] for r in residual) for m in range(3)]
        here = [[r[m] / all_[m] * own[m] if all_[m] > 0 else own[m] / shards for m in range(3)] for r in residual]
        got = place([sizes[i] for i in order], here)
        return pd.DataFrame({"key": [rows["key"].iloc[i] for i in order], "part": [rows["part"].iloc[i] for i in order], "shard": got})

    others = small.withColumn("task", F.pmod(F.xxhash64("key", "part"), F.lit(tasks))).groupBy("task").applyInPandas(task, "key binary, part int, shard int")
    # A part of a group stays whole, so a join on key and part that meets a hot group is one that the engine may split.
    dealt = cut(rows.join(placed.unionByName(others), ["key", "part"]).drop("key", "part"), "placed")
    buckets = max(1, -(-total["rows"] // ROWS_PER_BUCKET))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32")) - 1
    out = dealt.withColumn("number", number).join(offsets, ["shard", "bucket"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
