"""Inverted indexes as tables: postings, document lengths, collection and term statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import text as fx

KEYS = ["archive", "doc_id"]
#: Bytes of text whose words a worker counts at once; a longer text is counted alone.
STEP = 4 << 20


def terms(docs: DataFrame, text: Column) -> DataFrame:
    """A row for each occurrence of a term: archive, doc_id, term."""
    return docs.select(*KEYS, F.explode(fx.tokens(text)).alias("term"))


def once(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each key once: texts of a repeated key become one, with a line break between them."""
    if docs.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs
    return docs.groupBy(*KEYS).agg(F.concat_ws("\n", F.collect_list(text)).alias(text))


def steps(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose ``column`` holds at most ``most`` bytes, or single rows."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def count(spaced: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of texts of words between spaces: row, code and count of each row's distinct words, in that order, and the words by code."""
    parts = pc.split_pattern(spaced, " ")
    coded = pc.list_flatten(parts).dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    rows = pc.list_parent_indices(parts).to_numpy()
    true = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not true.all():
        kept = true[codes]
        codes, rows = codes[kept], rows[kept]
    keys, wdf = np.unique(rows.astype(np.int64) * max(len(words), 1) + codes, return_counts=True)
    rows, codes = np.divmod(keys, max(len(words), 1))
    return rows, codes, wdf, words


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step in steps(batches, "w"):
        rows, codes, wdf, words = count(step["w"])
        archive, doc = (step[k].take(pa.array(rows)) for k in KEYS)
        yield pa.RecordBatch.from_arrays([archive, words.take(pa.array(codes)), doc, pa.array(wdf, pa.int64())], ["archive", "term", "doc_id", "wdf"])


def by_word(docs: DataFrame, run: Callable, text: str = "text") -> DataFrame:
    """archive, term, doc_id, wdf that ``run`` makes of batches of the keys and the folded, spaced text ``w``."""
    each = once(docs.select(*KEYS, text), text).select(*KEYS, fx.spaced(fx.fold(F.col(text))).alias("w"))
    fields = [each.schema["archive"], T.StructField("term", T.StringType()), each.schema["doc_id"], T.StructField("wdf", T.LongType())]
    return each.mapInArrow(run, T.StructType(fields))


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """archive, term, doc_id, wdf of the folded text. Words are counted where their document is read, so no row of
    them is exchanged; texts of a repeated key are merged before, the only exchange of texts."""
    return by_word(docs, _rows, text)


def lengths(posts: DataFrame) -> DataFrame:
    return posts.groupBy(*KEYS).agg(F.sum("wdf").alias("doclen"))


def lengths_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """Document lengths without building postings: the number of tokens, a scan without an exchange."""
    return docs.select(*KEYS, F.size(fx.tokens(fx.fold(F.col(text)))).cast("long").alias("doclen"))


def counted(docs: DataFrame, words: Column, name: str) -> DataFrame:
    """keys, ``name``: ``words`` of a row summed up by key, where that is above 0. Only sums are exchanged."""
    return docs.select(*KEYS, words.cast("long").alias(name)).groupBy(*KEYS).agg(F.sum(name).alias(name)).where(F.col(name) > 0)


def collection(length: DataFrame) -> DataFrame:
    return length.groupBy("archive").agg(F.count("*").alias("n_docs"), F.sum("doclen").alias("total_len"))


def term_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("archive", "term").agg(F.count("*").alias("df"))
