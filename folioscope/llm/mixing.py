"""Temperature mixing: sources by an exponent of their token shares, in budgeted block permutations.

A source with the share p of all tokens gets a weight in proportion to p^a. The exponent a, from 0
(all sources alike) to 1 (as they are), is bisected: the least one whose weights repeat no source
more than a limit allows, or the one whose weights have a wanted entropy. A source then gives its
tokens in passes over a random order of its documents, whole ones and a last one cut at the budget,
and the stream of all is cut into blocks that each hold every source by its weight. Only DataFrame
operations are used; the driver sees a few numbers for each try of the exponent.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm import common

MAX_REPEATS, BLOCK_TOKENS, SEED = 2.0, 1_000_000, "mix-1"
WORDS = r"[^ \t\n\x0B\f\r]+"
#: Exponents tried at once, and rounds: the bracket shrinks below 1e-12.
TRIES, ROUNDS = 64, 7


def n_tokens(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def exponent(totals: DataFrame, max_repeats: float | None, entropy: float | None, budget: int | None) -> float:
    """The least exponent in [0, 1] that meets the limit; 1 if none does. ``totals``: tokens a source.

    Repeats and entropy are monotone in the exponent, so each round keeps the bracket between
    the last exponent that fails and the first that holds.
    """
    shares = totals.where("tokens > 0").select((F.col("tokens") / F.sum("tokens").over(Window.partitionBy())).alias("p"), "tokens")
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / (TRIES - 1)
        grid = [low + step * i for i in range(TRIES)]
        at = shares.select("p", "tokens", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))).alias("i")).withColumn("v", F.pow("p", F.lit(low) + F.lit(step) * F.col("i")))
        z = at.groupBy("i").agg(F.sum("v").alias("z"), F.sum(F.col("v") * F.log("v")).alias("vl"), F.max(F.col("v") / F.col("tokens")).alias("most"), F.max(F.col("tokens") / F.col("v")).alias("need"))
        tried = {r["i"]: r for r in z.collect()}
        if not tried:
            return 1.0

        def holds(r: dict) -> bool:
            if entropy is not None:
                return math.log(r["z"]) - r["vl"] / r["z"] <= entropy
            passes = r["need"] * r["most"] if budget is None else budget * r["most"] / r["z"]
            return passes <= max_repeats * (1 + 1e-13)

        first = next((i for i in range(TRIES) if holds(tried[i])), None)
        if first is None or first == 0:
            return high if first is None else low
        low, high = grid[first - 1], grid[first]
    return high


def mix(docs: DataFrame, max_repeats: float = MAX_REPEATS, entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source and any others), each row once for every pass that takes it.

    Without ``budget`` the tokens to give are the fewest that take every document of every source
    once, so none is left out. Adds n_tokens (words), epoch (int, from 1), block (long, from 0)
    and mix_key, by which a block's rows are sorted to permute it. Null sources are one source;
    null texts have no tokens; sources without tokens pass once. A pass orders rows by a hash of doc_id
    and text; ties are equal rows. Empty tables give no rows. Columns of those four names are replaced,
    others are kept, whatever their names.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("n_tokens", "epoch", "block", "mix_key")]
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    mark = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    # the rows' columns have numbers on the way, so that helper columns clash with none and unused ones are pruned
    counted = docs.select(*[F.col(f"`{c}`").alias(f"u{i}") for i, c in enumerate(own)], "source", n_tokens().alias("n_tokens"), mark.alias("_mark"))
    totals = common.table(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "mix-totals", 1)
    a = round(exponent(totals, max_repeats, entropy, budget), 9)
    every = Window.partitionBy()
    plan = totals.withColumn("v", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.sum("tokens").over(every), F.lit(a)))).withColumn("w", F.col("v") / F.sum("v").over(every))
    whole = F.lit(budget).cast("double") if budget is not None else F.max(F.col("tokens") / F.col("w")).over(every)
    plan = plan.withColumn("give", whole * F.col("w")).withColumn("budget", F.sum("give").over(every))
    plan = plan.withColumn("full", F.coalesce(F.floor(F.col("give") / F.col("tokens") + 1e-9), F.lit(1)).cast("long"))
    plan = plan.withColumn("rest", F.coalesce(F.greatest(F.lit(0), F.round(F.col("give") - F.col("full") * F.col("tokens"))), F.lit(0)).cast("long"))
    plan = plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.coalesce(F.col("budget"), F.lit(0.0)) / block_tokens)).cast("long"))
    plan = plan.withColumn("_sid", F.row_number().over(Window.orderBy("source")))
    plan = common.table(plan.select(F.col("source").alias("_source"), "_sid", "tokens", "full", "rest", "blocks"), "mix-plan", 1)
    passes = counted.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    passes = passes.withColumn("epoch", F.explode(F.expr("sequence(1, int(full) + if(rest > 0, 1, 0))")) if budget is None else F.explode(F.expr("if(full + rest = 0, array(), sequence(1, int(full) + if(rest > 0, 1, 0)))")))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.col("_mark")).cast("binary"))
    passes = passes.withColumn("_key", key)
    most = totals.agg(F.max("rows")).first()[0] or 1
    digits = max(1, math.ceil(math.log(max(1, most / 2000), 16)))
    passes = passes.withColumn("_range", F.expr(f"left(_key, {digits})"))
    # how many tokens of a pass stand before a document: within its key range, and the ranges before
    slim = passes.groupBy("_sid", "epoch", "_range").agg(F.sum("n_tokens").alias("_held"))
    before = F.sum("_held").over(Window.partitionBy("_sid", "epoch").orderBy("_range")) - F.col("_held")
    ranges = common.table(slim.select("_sid", "epoch", "_range", before.alias("_before")), "mix-ranges")
    inside = Window.partitionBy("_sid", "epoch", "_range").orderBy("_key")
    placed = passes.withColumn("_inside", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    placed = placed.join(ranges, ["_sid", "epoch", "_range"])
    placed = placed.withColumn("_at", F.col("_before") + F.col("_inside")).where("epoch <= full or _at < rest")
    stream = F.expr("full * tokens + rest")
    block = F.when(stream > 0, F.floor(((F.col("epoch") - 1) * F.col("tokens") + F.col("_at")) / stream * F.col("blocks"))).otherwise(0)
    block = F.least(block, F.col("blocks") - 1).cast("long")
    return placed.select(*[F.col(f"u{i}").alias(c) for i, c in enumerate(own)], "n_tokens", "epoch", block.alias("block"), F.md5(F.concat(F.lit("in-block:"), F.col("_key")).cast("binary")).alias("mix_key"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "epoch", "block", "mix_key")


OP6_SQL = rf"""
WITH c AS (SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) AS BIGINT) AS n_tokens FROM documents),
t AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM c GROUP BY source),
p AS (SELECT source, tokens, tokens / (SELECT sum(tokens) FROM t) AS p FROM t),
x AS (SELECT round(CASE WHEN max(p) <= {MAX_REPEATS} * min(p) THEN 0 ELSE 1 - ln({MAX_REPEATS}) / ln(max(p) / min(p)) END, 9) AS a FROM p WHERE tokens > 0),
w AS (SELECT source, tokens, pow(p, a) / sum(pow(p, a)) OVER () AS w FROM p, x WHERE tokens > 0),
g AS (SELECT source, tokens, max(tokens / w) OVER () * w AS give, max(tokens / w) OVER () AS budget FROM w),
f AS (SELECT source, tokens, give, budget, CAST(floor(give / tokens + 1e-9) AS BIGINT) AS f FROM g),
n AS (SELECT source, tokens, f, CAST(greatest(0, round(give - f * tokens)) AS BIGINT) AS rest, CAST(greatest(1, ceil(budget / {BLOCK_TOKENS})) AS BIGINT) AS blocks FROM f
      UNION ALL SELECT source, 0, 1, 0, (SELECT CAST(greatest(1, ceil(coalesce(max(budget), 0) / {BLOCK_TOKENS})) AS BIGINT) FROM g) FROM t WHERE tokens = 0),
e AS (SELECT c.*, n.tokens, n.f, n.rest, n.blocks, CAST(unnest(range(1, n.f + CASE WHEN n.rest > 0 THEN 2 ELSE 1 END)) AS INT) AS epoch FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source),
k AS (SELECT *, md5('{SEED}:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM e),
o AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY k ROWS UNBOUNDED PRECEDING) - n_tokens AS BIGINT) AS pos FROM k)
SELECT doc_id, source, n_tokens, epoch,
  CAST(least(CASE WHEN f * tokens + rest > 0 THEN floor(((epoch - 1) * tokens + pos) / (f * tokens + rest) * blocks) ELSE 0 END, blocks - 1) AS BIGINT) AS block,
  md5('in-block:' || k) AS mix_key
FROM o WHERE epoch <= f OR pos < rest
"""
