"""Redirect graphs: every entry points to at most one other, chains may dangle or run in circles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope import scratch

#: A walk inspects this many entries, so one edge fewer is followed.
MOST_ENTRIES = 50


def closure(edges: DataFrame, key: str = "archive") -> DataFrame:
    """(archive, src, terminal, hops) of ``edges`` (archive, src, dst): where each chain ends.

    Pointers are doubled: each round joins every pointer to the pointer of its target, so six rounds reach 64 hops;
    fewer do if no pointer moves. Every round is written, so that the plan of the next has one join and not all before
    it. A terminal is null if the chain runs in a circle, takes too many hops, or has no target.
    """
    spark = edges.sparkSession
    at, path = scratch.table(edges.select(key, "src", F.col("dst").alias("to"), F.lit(1).alias("hops")), "redirects")
    for _ in range((MOST_ENTRIES - 1).bit_length()):
        moved, moved_path = scratch.table(_double(at, key), "redirects")
        scratch.remove(spark, path)
        at, path = moved.drop("moved"), moved_path
        if moved.where("moved").isEmpty():
            break
    sources = at.select(F.col(key).alias("_k"), F.col("src").alias("_s"))
    ended = at.join(sources, (at[key] == F.col("_k")) & (at["to"] == F.col("_s")), "left")
    good = F.col("_s").isNull() & (F.col("hops") < MOST_ENTRIES)
    return ended.select(key, "src", F.when(good, F.col("to")).alias("terminal"), F.when(good, F.col("hops")).alias("hops"))


def reached(edges: DataFrame, most: int = MOST_ENTRIES, key: str = "archive") -> DataFrame:
    """(archive, src, terminal, hops) of ``edges``: where a walk of ``most`` hops gets, or how far its chain leads.

    Walks of n hops make those of 2n, and one hop more where ``most`` has a bit, so rounds grow with its logarithm.
    """
    spark = edges.sparkSession
    one, first = scratch.table(edges.select(key, "src", F.col("dst").alias("to"), F.lit(1).alias("hops")), "redirects")
    at, path = one, first
    for double in (x for bit in f"{most:b}"[1:] for x in (True, False)[: 1 + int(bit)]):
        moved, moved_path = scratch.table(_double(at, key, at if double else one), "redirects")
        if path != first:
            scratch.remove(spark, path)
        at, path = moved.drop("moved"), moved_path
        if moved.where("moved").isEmpty():
            break
    if path != first:
        scratch.remove(spark, first)
    return at.select(key, "src", F.col("to").alias("terminal"), "hops")


def _double(at: DataFrame, key: str, by: DataFrame | None = None) -> DataFrame:
    """Every pointer moved to the pointer of its target (in ``by``, or its own kind), with ``moved`` where there is one."""
    ahead = (at if by is None else by).select(F.col(key).alias("_k"), F.col("src").alias("_s"), F.col("to").alias("_to"), F.col("hops").alias("_hops"))
    joined = at.join(ahead, (at[key] == F.col("_k")) & (at["to"] == F.col("_s")), "left")
    hops = F.col("hops") + F.coalesce("_hops", F.lit(0))
    return joined.select(key, "src", F.coalesce("_to", "to").alias("to"), hops.alias("hops"), F.col("_s").isNotNull().alias("moved"))


def live(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """Redirects whose target is among ``articles`` (archive, idx)."""
    return edges.join(articles, (edges["archive"] == articles["archive"]) & (edges["dst"] == articles["idx"]), "left_semi")


def dangling(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Redirects whose target is no entry at all."""
    return edges.join(entries, (edges["archive"] == entries["archive"]) & (edges["dst"] == entries["idx"]), "left_anti")
