"""One-permutation MinHash fingerprints: a text's shingles are hashed and binned once.

A shingle's hash picks one of ``BINS`` bins by its high bits; a bin keeps its least hash. An empty bin
takes the value of another by optimal densification: it looks through the bins in an order of its
own, the same for all texts, until one is filled. What it takes is hashed with its own number, so
that unlike values agree by chance in each bin anew, not in all that took them. The fingerprint holds the ``LOW`` lowest bits of
each bin, as a hex digit. Of two texts with the likeness J, a digit agrees with the probability
J + (1 - J) / 2^LOW, so the share of agreeing digits is corrected for the chance hits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm import common

SHINGLE, BINS, LOW = 5, 128, 4
_SHIFT = 64 - BINS.bit_length() + 1


def _orders(bins: int) -> list[list[int]]:
    """For each bin the order in which it looks for a filled one: all the others, by a mixed hash."""

    def mixed(x: int) -> int:
        for _ in range(2):
            x = ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & (2**64 - 1)
        return x ^ (x >> 29)

    return [sorted((b for b in range(bins) if b != own), key=lambda b: mixed(own * bins + b + 1)) for own in range(bins)]


def shingle_hashes(text: str) -> str:
    """SQL: the 64-bit hashes of a text's shingles of ``SHINGLE`` words; shorter texts are one; no words, none."""
    words = rf"filter(split({text}, '[ \\t\\n\\x0B\\f\\r]+'), w -> w <> '')"
    five = ", ".join(f"get(w, i + {k})" for k in range(SHINGLE))
    return f"transform(array({words}), w -> if(size(w) = 0, array(), transform(sequence(0, greatest(0, size(w) - {SHINGLE})), i -> xxhash64({five}))))[0]"


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the column ``name``: the fingerprint of ``text``, '' where it has no word or is null.

    A column of that name is replaced, others are kept, whatever their names. The stages are columns of
    their own, each used twice or more: Catalyst copies a column that is used once into its use, here the
    body of a lambda, where it would be computed for each bin.
    """
    ordered, least, bins, full = common.unused(df, 4)
    first = f"filter({ordered}, (x, i) -> i = 0 or shiftrightunsigned(x, {_SHIFT}) <> shiftrightunsigned({ordered}[i - 1], {_SHIFT}))"
    orders = ", ".join("array(" + ", ".join(map(str, order)) + ")" for order in _orders(BINS))
    out = df.withColumn(ordered, F.expr(f"sort_array({shingle_hashes(f'coalesce({text}, {chr(39) * 2})')})"))
    out = out.withColumn(least, F.expr(first)).drop(ordered)
    out = out.withColumn(bins, F.expr(f"map_from_arrays(transform({least}, x -> int(shiftrightunsigned(x, {_SHIFT}))), {least})")).drop(least)
    out = out.withColumn(full, F.expr(f"if(size({bins}) = 0, array(), transform(sequence(0, {BINS - 1}), b -> try_element_at({bins}, b)))")).drop(bins)
    filled = f"transform(array({orders}), (o, b) -> coalesce({full}[b], xxhash64(element_at(transform(filter(o, x -> {full}[x] is not null), x -> {full}[x]), 1), b)))"
    digits = f"array_join(transform({{}}, v -> lower(hex(v & {2**LOW - 1}))), '')"
    has = f"exists({full}, v -> v is not null)"
    whole = f"forall({full}, v -> v is not null)"
    return out.withColumn(name, F.expr(f"case when not {has} then '' when {whole} then {digits.format(full)} else {digits.format(filled)} end")).drop(full)


def likeness(a: str, b: str) -> F.Column:
    """The estimated Jaccard likeness of two fingerprints, 0 to 1; two empty ones are alike, one is unlike any."""
    share = f"size(filter(sequence(1, {BINS}), i -> substring({a}, i, 1) = substring({b}, i, 1))) / {BINS}D"
    chance = 1 / 2**LOW
    return F.expr(f"case when {a} = {b} then 1D when {a} = '' or {b} = '' then 0D else greatest(0D, least(1D, ({share} - {chance}D) / {1 - chance}D)) end")


def with_next(raw: DataFrame, fill: Callable[[DataFrame], DataFrame], columns: list[str], rows: int) -> DataFrame:
    """``fill(raw)`` with ``next``: a struct of ``columns`` of the row that follows by descending doc_id, the first after the last.

    Rows are dealt to ranges of doc_id, and only the ranges' ends meet, one row a range. Equal
    ids are ordered by text; null ids come last.
    """
    pieces = max(1, min(4096, -(-rows // 4000)))
    marks = raw.select(F.percentile_approx("doc_id", F.array(*[F.lit((i + 1) / pieces) for i in range(pieces)]), 10_000)).first()[0] or []
    marks = sorted(set(marks))[:-1]
    placed = F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m < F.col("doc_id"))) if marks else F.lit(0)
    ranged = raw.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(placed))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    held = F.struct(*columns)
    follows = fill(ranged).withColumn("_next", F.lead(held).over(Window.partitionBy("_range").orderBy(*order)))
    top = ranged.groupBy("_range").agg(F.max("doc_id").alias("_top"))
    firsts = ranged.join(F.broadcast(top), "_range").where(F.col("doc_id").eqNullSafe(F.col("_top")))
    firsts = fill(firsts.groupBy("_range").agg(F.min("text").alias("text"))).select("_range", held.alias("_first"))
    wrap = Window.partitionBy()
    firsts = firsts.withColumn("_jump", F.coalesce(F.lead("_first").over(Window.orderBy(F.col("_range").desc())), F.first("_first").over(wrap.orderBy(F.col("_range").desc()))))
    firsts = common.table(firsts.select("_range", "_jump"), "next-firsts", 1)
    return follows.join(firsts, "_range").withColumn("next", F.coalesce("_next", "_jump")).drop("_range", "_next", "_jump")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.count()
    docs = with_next(docs, lambda x: fingerprint(x, "text", "fingerprint"), ["text", "fingerprint"], rows)
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    docs = docs.withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars - n_chars div 2)), substring(next.text, 1, int(n_chars div 2)))"))
    docs = docs.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"), "edited")
    docs = fingerprint(docs, "edited", "edited_fingerprint").drop("edited")
    return docs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
