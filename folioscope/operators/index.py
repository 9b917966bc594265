"""A search index that is written once and reopened: Parquet tables of postings, term and archive statistics, lengths.

Postings and terms are partitioned by a hash of the term, so that a search lists only the folders of its own words, and
sorted by term, so that row groups without them are skipped. A row of the postings is a list: a term in a run of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import scratch
from folioscope.functions import stem
from folioscope.functions import text as fx
from folioscope.operators import postings as px
from folioscope.operators import ranking as rx
from folioscope.operators import stems

#: Bytes of text that one run of documents holds at most; a longer text is one alone.
RUN = 8 << 20
#: Folders of terms, unless an index is written with others.
BUCKETS = 256
#: The longest term in bytes, and what marks a stem beside a surface form.
LONGEST = 240
STEM = "Z"
#: How words become terms: as they are, with marked stems beside them, as stems alone, as marked stems alone.
STRATEGIES = ("none", "some", "all", "all_z")
SCHEMAS = {
    "archives": "archive string, stemmer string, n_docs long, total_len long, strategy string, buckets int",
    "lengths": "stemmer string, archive string, doc_id long, doclen long",
    "postings": "stemmer string, archive string, term string, doc_ids array<long>, doclens array<long>, wdfs array<long>, bucket int",
    "terms": "stemmer string, archive string, term string, df long, cf long, bucket int",
}
#: What runs of documents become: lists of terms with df and cf in the run; kind 0 has its documents and their lengths, and no term.
_LISTS = "kind int, stemmer string, archive string, term string, df long, cf long, doc_ids array<long>, doclens array<long>, wdfs array<long>"


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def stemmer(language: Column) -> Column:
    """The language whose stems an archive takes: its code, else the first two letters; empty if there is none."""
    key = F.lower(language)
    names = F.create_map(*[F.lit(x) for pair in stem.CODES.items() for x in pair])
    known = F.coalesce(F.try_element_at(names, key), F.left(key, F.lit(2)))
    return F.when(known.isin(list(stem.STEMMERS)), known).otherwise("")


def _forms(strategy: str, key: str, word: str) -> list[str]:
    """The terms of a word in an archive whose stemmer is ``key``."""
    if not key or strategy == "none":
        return [word]
    root = stems.remembered(key, word)
    return {"some": [word, STEM + root], "all": [root], "all_z": [STEM + root]}[strategy]


def _runs(strategy: str) -> Callable:
    """Inverts runs of documents (stemmer, keys, spaced text ``w``) where they are read: far fewer rows than postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in px.steps(batches, "w", RUN):
            rows, codes, wdf, words = px.count(step["w"])
            short = pc.less_equal(pc.binary_length(words), LONGEST).to_numpy(zero_copy_only=False)[codes]
            rows, codes, wdf = rows[short], codes[short], wdf[short]
            known: dict[tuple[str, str | None], int] = {}
            group = np.array([known.setdefault(k, len(known)) for k in zip(step["stemmer"].to_pylist(), step["archive"].to_pylist(), strict=True)], np.int64)
            stemmed = np.array([key != "" for key, _ in known], bool)[group] if strategy == "some" else np.zeros(step.num_rows, bool)
            doclen = np.bincount(rows, wdf, step.num_rows).astype(np.int64) * (1 + stemmed)
            if strategy != "none":
                n = max(len(words), 1)
                pairs, which = np.unique(group[rows] * n + codes, return_inverse=True)
                of, word = np.divmod(pairs, n)
                names = [key for key, _ in known]
                forms = [_forms(strategy, names[g], w) for g, w in zip(of.tolist(), words.take(pa.array(word)).to_pylist(), strict=True)]
                coded = pa.array([f for each in forms for f in each], pa.string()).dictionary_encode()
                many = np.array([len(f) for f in forms], np.int64)
                # a pair's forms follow each other from its first on
                first, times = (np.cumsum(many) - many)[which], many[which]
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                codes, words = coded.indices.to_numpy()[np.repeat(first, times) + nth].astype(np.int64), coded.dictionary
                rows, codes, wdf = stems.recount(np.repeat(rows, times), codes, np.repeat(wdf, times), max(len(words), 1))
            n = max(len(words), 1)
            key = group[rows] * n + codes
            order = np.argsort(key, kind="stable")
            key, rows, wdf = key[order], rows[order], wdf[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            yield _batch(1, list(known), *np.divmod(key[starts], n), words, starts, wdf, rows, step, doclen)
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            yield _batch(0, list(known), group[order][starts], None, None, starts, None, order, step, doclen)

    return run


def _batch(kind, groups, of, codes, words, starts, wdf, rows, step, doclen) -> pa.RecordBatch:
    """Lists that begin at ``starts`` of ``rows``."""
    n = len(starts)
    offsets = pa.array(np.append(starts, len(rows)), pa.int32())
    lists = lambda values: pa.ListArray.from_arrays(offsets, values)
    cf = None if wdf is None else pa.array(np.add.reduceat(wdf, starts) if n else wdf, pa.int64())
    columns = {
        "kind": pa.array(np.full(n, kind), pa.int32()),
        "stemmer": pa.array([k for k, _ in groups], pa.string()).take(pa.array(of)),
        "archive": pa.array([a for _, a in groups], pa.string()).take(pa.array(of)),
        "term": pa.nulls(n, pa.string()) if words is None else words.take(pa.array(codes)),
        "df": pa.array(np.diff(np.append(starts, len(rows))), pa.int64()),
        "cf": pa.nulls(n, pa.int64()) if cf is None else cf,
        "doc_ids": lists(step["doc_id"].take(pa.array(rows))),
        "doclens": lists(pa.array(doclen[rows])),
        "wdfs": pa.nulls(n, pa.list_(pa.int64())) if wdf is None else lists(pa.array(wdf, pa.int64())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def write(docs: DataFrame, path: str, text: str = "text", languages: DataFrame | None = None, strategy: str = "none", buckets: int = BUCKETS) -> Index:
    """Writes the index of ``docs`` (archive, doc_id and a text; archive and doc_id are the key) below ``path``.

    ``languages`` (archive, language) chooses stems; without it an archive's name is its language. Words of more than
    240 bytes index nothing. A null or empty text has length 0 and counts as a document. Texts are taken apart once, and
    runs of documents inverted where they are read. A term may hold most of the postings: its lists, one a run, are dealt
    by ranges of term and document, so one term fills many tasks.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    spark = docs.sparkSession
    own = docs.select("archive", F.col("doc_id").cast("long").alias("doc_id"), fx.spaced(fx.fold(F.coalesce(F.col(text), F.lit("")))).alias("w"))
    if languages is None:
        own = own.withColumn("stemmer", stemmer(F.col("archive")))
    else:
        own = own.join(languages.select("archive", stemmer(F.col("language")).alias("stemmer")), "archive", "left")
    own = own.fillna("", ["stemmer"]).select("stemmer", *px.KEYS, "w")
    made = scratch.folder(spark, "index")
    own.mapInArrow(_runs(strategy), _LISTS).write.partitionBy("kind").parquet(made)
    runs = spark.read.schema(_LISTS).parquet(made)
    held = F.inline(F.arrays_zip("doc_ids", "doclens")).alias("doc_id", "doclen")
    runs.where("kind = 0").select("stemmer", "archive", held).write.mode("error").parquet(f"{path}/lengths")
    lists = runs.where("kind = 1").withColumn("bucket", bucket(F.col("term"), buckets))
    order = ["bucket", "term", "archive"]
    posts = lists.select("stemmer", "archive", "term", "doc_ids", "doclens", "wdfs", "bucket")
    posts.repartitionByRange(*order, F.get("doc_ids", F.lit(0))).sortWithinPartitions(*order).write.mode("error").partitionBy("bucket").parquet(f"{path}/postings")
    terms = lists.groupBy("bucket", "stemmer", "archive", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    terms.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("error").partitionBy("bucket").parquet(f"{path}/terms")
    scratch.remove(spark, made)
    stats = spark.read.parquet(f"{path}/lengths").groupBy("archive", "stemmer").agg(F.count("*").alias("n_docs"), F.sum("doclen").alias("total_len"))
    stats.withColumn("strategy", F.lit(strategy)).withColumn("buckets", F.lit(buckets)).write.mode("error").parquet(f"{path}/archives")  # last, so that an index with it is whole
    return Index(spark, path)


class Index:
    """A written index. Scored sets are DataFrames of archive, doc_id and score."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.archives, self.lengths, lists, self.terms = (spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items())
        one = F.inline(F.arrays_zip("doc_ids", "doclens", "wdfs")).alias("doc_id", "doclen", "wdf")
        self.postings = lists.select("stemmer", "archive", "term", "bucket", one)
        found = self.archives.select("strategy", "buckets").first()
        self.strategy, self.buckets = tuple(found) if found else ("none", BUCKETS)

    def _forms(self, key: str, word: str) -> list[str]:
        root = stem.stem(key, word) if key else None
        if root is None or self.strategy == "none":
            return [word]
        return [root] if self.strategy == "all" else [STEM + root]

    def query(self, words: Sequence[str]) -> DataFrame:
        """stemmer, term, wqf: the words in the terms of each stemmer, a handful of rows."""
        counts: dict[tuple[str, str], int] = {}
        for key in ("", *stem.STEMMERS):
            for term in (t for w in words for t in self._forms(key, w)):
                counts[key, term] = counts.get((key, term), 0) + 1
        return self.spark.createDataFrame([(*k, n) for k, n in counts.items()], "stemmer string, term string, wqf long")

    def _only(self, table: DataFrame, query: DataFrame, archives: Sequence[str] | None) -> DataFrame:
        wanted = query.select("term").distinct().select("term", bucket(F.col("term"), self.buckets).alias("b")).collect()  # the query's words
        table = table.where(F.col("bucket").isin(sorted({r["b"] for r in wanted})) & F.col("term").isin(sorted(r["term"] for r in wanted)))
        return table if archives is None else table.where(F.col("archive").isin(list(archives)))

    def search(self, words: Sequence[str], pooled: bool = False, weigh=rx.bm25, archives: Sequence[str] | None = None) -> DataFrame:
        """Documents with any of the words; statistics per archive, or of all archives searched."""
        if not words:
            return self.match_all().limit(0)
        by = [] if pooled else ["archive"]
        query = self.query(words)
        found = self._only(self.postings, query, archives).select("stemmer", *px.KEYS, "term", "wdf", "doclen")
        known = self._only(self.terms, query, archives).groupBy(*by, "term").agg(F.sum("df").alias("df"))
        held = self.archives if archives is None else self.archives.where(F.col("archive").isin(list(archives)))
        stats = held.groupBy(*by).agg(F.sum("n_docs").alias("n_docs"), (F.sum("total_len") / F.sum("n_docs")).alias("average"))
        joined = found.join(F.broadcast(query), ["stemmer", "term"]).join(known, [*by, "term"])
        joined = joined.join(stats, by) if by else joined.crossJoin(F.broadcast(stats))
        each = weigh(F.col("n_docs"), F.col("df"), F.col("wqf"), F.col("wdf"), F.col("doclen"), F.col("average"))
        return joined.groupBy(*px.KEYS).agg(F.round(F.sum(each), 6).alias("score"))

    def all_terms(self, words: Sequence[str], archives: Sequence[str] | None = None) -> DataFrame:
        """archive, doc_id of the documents with every one of the words."""
        query = self.query(words)
        needed = query.groupBy("stemmer").agg(F.count("*").alias("needed"))
        found = self._only(self.postings, query, archives).join(F.broadcast(query), ["stemmer", "term"])
        counted = found.groupBy("stemmer", *px.KEYS).agg(F.count("*").alias("n")).join(F.broadcast(needed), "stemmer")
        return counted.where("n = needed").select(*px.KEYS)

    def match_all(self) -> DataFrame:
        """Every document, with weight 0."""
        return self.lengths.select(*px.KEYS, F.lit(0.0).alias("score"))

    def expand(self, prefix: str) -> DataFrame:
        """archive, term, df of the terms that begin with ``prefix``: what a wildcard stands for."""
        return self.terms.where(F.startswith("term", F.lit(prefix))).select("archive", "term", "df")

    def wildcard(self, prefix: str) -> DataFrame:
        """Documents with a term that begins with ``prefix``, with weight 0."""
        return self.postings.where(F.startswith("term", F.lit(prefix))).select(*px.KEYS).distinct().withColumn("score", F.lit(0.0))


# --- boolean operators over scored sets -----------------------------------------------------------------


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """In one of them; weights add up."""
    return a.unionByName(b).groupBy(*px.KEYS).agg(F.round(F.sum("score"), 6).alias("score"))


def highest(a: DataFrame, b: DataFrame) -> DataFrame:
    """In one of them; the greater weight counts."""
    return a.unionByName(b).groupBy(*px.KEYS).agg(F.max("score").alias("score"))


def exactly_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """In one of them and not in the other."""
    return a.unionByName(b).groupBy(*px.KEYS).agg(F.max("score").alias("score"), F.count("*").alias("_n")).where("_n = 1").drop("_n")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """In both; weights add up."""
    return a.join(b.withColumnRenamed("score", "_more"), px.KEYS).select(*px.KEYS, F.round(F.col("score") + F.col("_more"), 6).alias("score"))


def maybe(a: DataFrame, b: DataFrame) -> DataFrame:
    """In the first; the second's weight is added where it matches."""
    more = b.withColumnRenamed("score", "_more")
    return a.join(more, px.KEYS, "left").select(*px.KEYS, F.round(F.col("score") + F.coalesce("_more", F.lit(0.0)), 6).alias("score"))


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*px.KEYS), px.KEYS, "left_anti")


def filtered(a: DataFrame, b: DataFrame) -> DataFrame:
    """In both, with the weights of the first."""
    return a.join(b.select(*px.KEYS), px.KEYS, "left_semi")


def scaled(a: DataFrame, factor: float) -> DataFrame:
    return a.withColumn("score", F.round(F.col("score") * factor, 6))


def page(scored: DataFrame, first: int, most: int) -> DataFrame:
    """``most`` rows from rank ``first`` on, counted from 0; ties by archive and document."""
    return scored.orderBy(F.desc("score"), "archive", "doc_id").offset(first).limit(most)


def percent(scored: DataFrame) -> DataFrame:
    """Weights as whole percentages of the best; all are 100 where no weight is above 0."""
    best = scored.agg(F.max("score").alias("_best"))
    share = F.when(F.col("_best") > 0, F.floor(F.round(F.col("score") / F.col("_best") * 100, 6))).otherwise(100)
    return scored.crossJoin(F.broadcast(best)).select(*scored.columns, share.cast("int").alias("percent"))
