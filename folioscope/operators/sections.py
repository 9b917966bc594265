"""Sections of documents as rows. Only cutting a document into regions runs in Python, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioscope.functions import markup, render
from folioscope.operators import postings as px

_REGIONS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("paragraphs", T.ArrayType(T.StringType()))]))


#: Bytes of source that are Python objects at a time, whatever an Arrow batch holds; a longer source is taken alone.
STEP = 1 << 20


def _rows(found: list[tuple[str, list[str]]]) -> list[dict]:
    return [{"pos": k, "name": name, "paragraphs": paragraphs} for k, (name, paragraphs) in enumerate(found)]


def _each(f: Callable, kind: T.DataType):
    """``f`` of each row as a column expression. A batch stays in Arrow; only a step of its rows is Python objects."""
    arrow = to_arrow_type(kind)

    def run(*columns: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays(list(columns), [str(k) for k in range(len(columns))])
        parts = [pa.array([f(*row) for row in zip(*(c.to_pylist() for c in step.columns), strict=True)], arrow) for step in px.steps(iter([batch]), "0", STEP)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return F.arrow_udf(run, kind)


html_sections = _each(lambda s: _rows(markup.html_sections(s or "")), _REGIONS)
md_sections = _each(lambda s: _rows(markup.md_sections(s or "")), _REGIONS)
html_section_content = _each(lambda s, n: markup.html_section_content(s or "", n or ""), T.StringType())
md_section_content = _each(lambda s, n: markup.md_section_content(s or "", n or ""), T.StringType())
html_to_md = _each(lambda s, t, x: render.html_to_md(s or "", t or None, x or None), T.StringType())
html_unescape = _each(lambda t: None if t is None else markup.unescape(t), T.StringType())
percent_decode = _each(lambda t: None if t is None else markup.percent_decode(t), T.StringType())


def sections(docs: DataFrame, source: str, keys: list[str], markdown: bool = False) -> DataFrame:
    """keys, pos, name, paragraphs: the introduction first, then a row a heading."""
    cut = md_sections if markdown else html_sections
    return docs.select(*keys, F.explode(cut(F.col(source))).alias("s")).select(*keys, "s.*")


def intro_preview(regions: Column) -> Column:
    from folioscope.functions import text as fx

    first = F.get(F.get(regions, 0)["paragraphs"], 0)
    return F.coalesce(fx.preview(first), F.lit(""))


#: A region is shown from this share of the best score on, and regions are shown at all up to this share of them.
KEPT_SCORE, KEPT_REGIONS = 0.5, 0.4


def scored(regions: DataFrame, keys: list[str], terms: list[str], words: Column) -> DataFrame:
    """keys, pos, score of the regions with any of the terms: BM25 among the regions of one document.

    Statistics are windows over a document's regions, one exchange for all terms.
    """
    from folioscope.operators import ranking

    own = Window.partitionBy(*keys)
    each = regions.withColumn("_w", words).withColumn("_len", F.size("_w"))
    each = each.withColumn("_n", F.count("*").over(own)).withColumn("_average", F.sum("_len").over(own) / F.col("_n"))
    parts = []
    for k, term in enumerate(dict.fromkeys(terms)):
        each = each.withColumn(f"_wdf{k}", F.size(F.filter("_w", _equals(term))))
        each = each.withColumn(f"_df{k}", F.count_if(F.col(f"_wdf{k}") > 0).over(own))
        weight = ranking.bm25(F.col("_n"), F.col(f"_df{k}"), F.lit(terms.count(term)), F.col(f"_wdf{k}"), F.col("_len"), F.col("_average"))
        parts.append(F.when(F.col(f"_wdf{k}") > 0, weight))
    found = each.withColumn("_parts", F.array_compact(F.array(*parts))).where(F.size("_parts") > 0)
    total = F.round(F.aggregate("_parts", F.lit(0.0), lambda a, x: a + x), 6)
    return found.withColumn("score", total).drop(*[c for c in found.columns if c.startswith("_") and c != "_n"])


def relevant(found: DataFrame, keys: list[str], shown: Column) -> DataFrame:
    """keys, shown (array): the regions of ``scored`` worth showing, in order; null if they are too many."""
    best = found.withColumn("_best", F.max("score").over(Window.partitionBy(*keys)))
    kept = best.where((F.col("score") >= KEPT_SCORE * F.col("_best")) & (F.col("_best") > 0))
    lists = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("s")))).alias("_l"), F.first("_n").alias("_n"))
    return lists.select(*keys, F.when(F.size("_l") <= F.col("_n") * KEPT_REGIONS, F.transform("_l", lambda x: x["s"])).alias("shown"))


def _equals(term: str):
    return lambda t: t == term
