"""Weights of matching documents, local and pooled ranks, and the tiers of a search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators import postings as px

LOCAL_TOP = 50


def term_weight(n: Column, df: Column) -> Column:
    """The natural logarithm of the odds that a document has the term, with a soft floor."""
    odds = (n - df + 0.5) / (df + 0.5)
    return F.log(F.when(odds < 2, odds * 0.5 + 1).otherwise(odds))


Weigh = Callable[..., Column]


def saturating(k1: float, k2: float, k3: float, b: float, least: float) -> Weigh:
    """BM25 weights. A term's count in the query enters linearly, as each is a term of its own, so ``k3`` changes
    nothing; ``k2`` doesn't either. ``least`` is the least relative length; an average length of 0 counts as that."""

    def weigh(n: Column, df: Column, wqf: Column, wdf: Column, doclen: Column, average: Column) -> Column:
        relative = F.greatest(F.coalesce(F.try_divide(doclen, average), F.lit(0.0)), F.lit(least))
        return term_weight(n, df) * wqf * (k1 + 1) * wdf / ((relative * b + (1 - b)) * k1 + wdf)

    return weigh


#: Parameters of the schemes by default; bm25 takes k1, k2, k3, b and the least relative length, trad takes k.
DEFAULTS = {"bm25": (1.0, 0.0, 1.0, 0.5, 0.5), "trad": (1.0,), "bool": ()}
bm25 = saturating(*DEFAULTS["bm25"])


def scheme(name: str, parameters: Sequence[float] | None = None) -> Weigh:
    """The weights of a scheme, whatever the case of its name; without ``parameters`` the default ones."""
    known = name.lower()
    if known not in DEFAULTS:
        raise ValueError(f"unknown weighting scheme {name!r}; there are {', '.join(sorted(DEFAULTS))}")
    given = DEFAULTS[known] if parameters is None else tuple(parameters)
    if len(given) != len(DEFAULTS[known]):
        raise ValueError(f"{known} takes {len(DEFAULTS[known])} parameters, not {len(given)}")
    if known == "bool":
        return lambda *_: F.lit(0.0)
    return saturating(*(given if known == "bm25" else (given[0], 0.0, 0.0, 1.0, 0.0)))


def query_terms(spark: SparkSession, terms: list[str]) -> DataFrame:
    """term, wqf: a handful of rows that come with the query, so they are broadcast."""
    found: dict[str, int] = {}
    for t in terms:
        found[t] = found.get(t, 0) + 1
    return F.broadcast(spark.createDataFrame(list(found.items()), "term string, wqf long"))


def matches(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """Postings of the query's terms alone, with doclen: one scan, filtered before anything is exchanged."""
    from folioscope.functions import text as fx

    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(terms)])
    words = docs.select(*px.KEYS, fx.tokens(fx.fold(F.col(text))).alias("w"))
    words = words.select(*px.KEYS, F.size("w").cast("long").alias("doclen"), F.filter("w", lambda t: F.array_contains(wanted, t)).alias("w"))
    each = words.select(*px.KEYS, "doclen", F.explode("w").alias("term"))
    return each.groupBy(*px.KEYS, "term").agg(F.first("doclen").alias("doclen"), F.count("*").alias("wdf"))


def score(found: DataFrame, stats: DataFrame, frequencies: DataFrame, query: DataFrame, by: list[str], weigh=bm25) -> DataFrame:
    """Scores of matching documents. ``stats`` (n_docs, average) and ``frequencies`` (term, df) are per ``by``,
    pooled over all archives if that is empty."""
    joined = found.join(query, "term").join(F.broadcast(frequencies), [*by, "term"])
    joined = joined.join(F.broadcast(stats), by) if by else joined.crossJoin(F.broadcast(stats))
    each = weigh(F.col("n_docs"), F.col("df"), F.col("wqf"), F.col("wdf"), F.col("doclen"), F.col("average"))
    return joined.groupBy(*px.KEYS).agg(F.round(F.sum(each), 6).alias("score"))


def search(docs: DataFrame, terms: list[str], pooled: bool = False, weigh=bm25, text: str = "text") -> DataFrame:
    """archive, doc_id, score of the documents with any of the terms; statistics per archive, or of all."""
    by = [] if pooled else ["archive"]
    found = matches(docs, terms, text)
    length = px.lengths_of(docs, text)
    stats = length.groupBy(*by).agg(F.count("*").alias("n_docs"), (F.sum("doclen") / F.count("*")).alias("average"))
    frequencies = found.groupBy(*by, "term").agg(F.count("*").alias("df"))
    return score(found, stats, frequencies, query_terms(docs.sparkSession, terms), by, weigh)


def top(scored: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The first ``k`` rows by score, per ``by`` if given; ties by archive and document."""
    if not by:
        return scored.orderBy(F.desc("score"), "archive", "doc_id").limit(k)
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def all_terms(docs: DataFrame, terms: list[str], text: str = "title") -> DataFrame:
    """Documents whose text has every one of the terms."""
    wanted = list(dict.fromkeys(terms))
    found = matches(docs, wanted, text)
    return found.groupBy(*px.KEYS).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).drop("n")


def rotation(lists: DataFrame) -> DataFrame:
    """Interleaves the archives' ranked lists, rank by rank: ``lists`` has archive and rank."""
    return lists.withColumn("position", F.row_number().over(Window.orderBy("rank", "archive")))


def first_wins(hits: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the hits with one key the first in order."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
