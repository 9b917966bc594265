"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in blocks. How many rows of each block go to each shard is drawn once, exactly as a
uniform permutation would deal them (the matrix has the blocks' sizes and the shards' sizes as
margins). Then each block is permuted locally and cut at its row of the matrix, the pieces are
exchanged, and each shard is permuted again. Only DataFrame operations move rows; the driver
sees one count a block.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm import common

SHARDS, SEED = 8, 20240601
#: Rows a block holds about, and the number of blocks that the matrix may have; beyond their product blocks grow.
BLOCK_ROWS, MAX_BLOCKS = 20_000, 1 << 20


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn`` of good + bad.

    Totals beyond numpy's limit are drawn by inversion of the law within 12 standard deviations of its mode;
    what lies beyond has less mass than the last bit of the uniform number that is inverted, so no draw would differ.
    """
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn and good else 0
    low, high = max(0, drawn - bad), min(drawn, good)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    p = good / (good + bad)
    span = 20 + int(12 * math.sqrt(max(1.0, drawn * p * (1 - p))))
    k = np.arange(max(low, mode - span), min(high, mode + span) + 1, dtype=np.float64)
    steps = np.log((good - k[:-1]) * (drawn - k[:-1])) - np.log((k[1:]) * (bad - drawn + k[1:]))
    log = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(log - log.max()))
    return int(k[np.searchsorted(mass, rng.random() * mass[-1])])


def matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """A row a block, a column a shard: rows sum to ``sizes``, columns differ by one at most."""
    rng, total = np.random.default_rng(seed), sum(sizes)
    left = [total // shards + (j < total % shards) for j in range(shards)]
    out = []
    for n in sizes:
        row, rest = [], sum(left)
        for room in left:
            k = hypergeometric(rng, room, rest - room, n)
            row.append(k)
            rest -= room
            n -= k
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def shuffle(df: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in its shard).

    Shard counts differ by one at most. The result follows from the rows, ``keys`` (columns that
    tell rows apart), ``shards`` and ``seed``, whatever the partitions, so repeated tasks agree. Null
    keys hash like any value; rows equal in all keys lie in one block and are interchangeable. An
    empty table stays empty. Columns named shard or slot are replaced, others are kept, whatever their names.
    """
    spark = df.sparkSession
    own = [c for c in df.columns if c not in ("shard", "slot")]
    # columns have numbers on the way, so that helper columns clash with none and unused ones are pruned
    flat = df.select(*[F.col(f"`{c}`").alias(f"u{i}") for i, c in enumerate(own)])
    values = [F.col(f"u{own.index(k)}") for k in keys]
    hashed = flat.withColumn("h", F.xxhash64(F.lit(seed), *values))
    rows = df.count()
    blocks = min(MAX_BLOCKS, max(64, -(-rows // BLOCK_ROWS)))
    blocked = hashed.withColumn("block", F.pmod(F.xxhash64("h", F.lit(0)), F.lit(blocks)).cast("int"))
    sizes = {r["block"]: r["count"] for r in blocked.groupBy("block").count().collect()}
    drawn = matrix([sizes.get(i, 0) for i in range(blocks)], shards, seed)
    cuts = spark.createDataFrame([(i, np.cumsum(row).tolist()) for i, row in enumerate(drawn)], T.StructType([T.StructField("block", T.IntegerType()), T.StructField("cuts", T.ArrayType(T.LongType()))]))
    cuts = common.table(cuts, "shuffle-matrix")

    def dealt(part: DataFrame, ties: list[F.Column]) -> DataFrame:
        local = Window.partitionBy("block").orderBy(F.xxhash64("h", F.lit(1)), *ties)
        ranked = part.withColumn("r", F.row_number().over(local)).join(cuts, "block")
        return ranked.withColumn("shard", F.expr("size(filter(cuts, c -> c < r))").cast("int")).withColumn("piece", F.pmod(F.xxhash64("h", F.lit(2)), F.lit(-(-blocks // shards))).cast("int")).drop("r", "cuts", "block")

    # rows of one h share a piece and the ranks that their ties may permute, so the counts need no keys, which may be long
    counts = dealt(blocked.select("h", "block"), []).groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")
    offsets = common.table(counts.select("shard", "piece", before.alias("before")), "shuffle-offsets", 1)
    again = Window.partitionBy("shard", "piece").orderBy(F.xxhash64("h", F.lit(3)), *values)
    placed = dealt(blocked, values).withColumn("r", F.row_number().over(again)).join(offsets, ["shard", "piece"])
    return placed.select(*[F.col(f"u{i}").alias(c) for i, c in enumerate(own)], "shard", (F.col("before") + F.col("r") - 1).alias("slot"))


def op4_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shuffle(common.read(spark, sf_dir, "documents"), ["doc_id", "text"])
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
