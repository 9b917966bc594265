"""Bulk conversion of HTML archives: Markdown articles, search tables, listings and counts as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import markup
from folioscope.functions import text as fx
from folioscope.operators import redirects, sections

#: Metadata that a converted archive keeps, and the language of archives that name none.
METADATA = ["Name", "Title", "Language", "Description", "Date", "Publisher", "Creator"]
DEFAULT_LANGUAGE = "eng"


@F.pandas_udf(T.BooleanType())
def _blank(markdown: pd.Series) -> pd.Series:
    return markdown.map(lambda m: markup.is_blank_article(m or ""))


@F.pandas_udf(T.StringType())
def _intro(markdown: pd.Series) -> pd.Series:
    return markdown.map(lambda m: markup.index_text(m or ""))


def metadata(entries: DataFrame) -> DataFrame:
    """archive, key, value: what an archive says of itself; a missing language is the default."""
    value = F.col("content").cast("string")
    found = entries.where("namespace = 'M'").select("archive", F.regexp_replace("full_path", "^M/(?:M/)?", "").alias("key"), value.alias("value"))
    found = found.where(F.col("key").isin(METADATA) & (F.trim("value") != ""))
    bare = entries.select("archive").distinct().join(found.where("key = 'Language'"), "archive", "left_anti")
    return found.unionByName(bare.select("archive", F.lit("Language").alias("key"), F.lit(DEFAULT_LANGUAGE).alias("value")))


def convert(entries: DataFrame, limit: int | None = None, intro_only: bool = False, redirect_titles: bool = False, exclude_categories: bool = False) -> dict[str, DataFrame]:
    """The tables of a converted library.

    articles: archive, entry_idx, path, title, markdown and what an article is. full_text and titles: what the search
    indexes take. redirects: those that lead to an article. listing: titles in order. counter, metadata, summary.
    """
    if limit is not None:
        entries = entries.where(F.col("entry_idx") < limit)
    meta = metadata(entries)
    language = meta.where("key = 'Language'").groupBy("archive").agg(fx.language_code(F.first("value")).alias("language"))
    pages = entries.where((F.col("kind") == "item") & F.col("namespace").isin("C", "A") & F.startswith("mime_type", F.lit("text/html")))
    text = F.col("content").cast("string")
    pages = pages.join(F.broadcast(language), "archive", "left").withColumn("readable", F.is_valid_utf8(text)).withColumn("html", F.when(F.col("readable"), text))
    pages = pages.withColumn("category", F.coalesce(fx.is_category_page(F.col("html")), F.lit(False))).withColumn("partial", F.startswith("url", F.lit("_categories_partials_")))
    if exclude_categories:
        pages = pages.where(~F.col("category") & ~F.col("partial"))
    shown = F.when(F.col("title") == F.col("full_path"), F.replace("url", F.lit("_"), F.lit(" "))).otherwise(F.col("title"))
    pages = pages.withColumn("title", fx.trim_title(shown)).withColumn("markdown", F.when(F.col("readable"), sections.html_to_md("html", "title", "language")))
    articles = pages.withColumn("blank", _blank("markdown")).select("archive", "entry_idx", F.col("full_path").alias("path"), "title", "markdown", "category", "partial", "blank", "readable")
    good = articles.where("readable")
    full_text = good.where("not category and not partial and not blank")
    content = _intro("markdown") if intro_only else F.col("markdown")
    full_text = full_text.select("archive", F.col("entry_idx").alias("doc_id"), "path", fx.fold(F.col("title")).alias("folded_title"), content.alias("text"))
    full_text = full_text.withColumn("wordcount", fx.word_count(fx.fold(F.col("text"))))
    edges = entries.where("kind = 'redirect'").select("archive", F.col("entry_idx").alias("src"), F.col("redirect_idx").alias("dst"))
    ends = redirects.closure(edges).where("terminal is not null")
    kept = good.select("archive", F.col("entry_idx").alias("terminal"), F.col("path").alias("target_path"))
    alive = ends.join(kept, ["archive", "terminal"]).join(entries.select("archive", F.col("entry_idx").alias("src"), "full_path", "title"), ["archive", "src"])
    alive = alive.select("archive", F.col("src").alias("entry_idx"), F.col("full_path").alias("path"), F.when(F.col("title") == F.col("full_path"), fx.path_title(F.col("full_path"))).otherwise(F.col("title")).alias("title"), "target_path")
    named = good.where("not partial" if redirect_titles else "not partial and not blank")
    titles = named.select("archive", F.col("entry_idx").alias("doc_id"), "path", "title", F.col("path").alias("target_path"))
    if redirect_titles:
        titles = titles.unionByName(alive.select("archive", F.col("entry_idx").alias("doc_id"), "path", "title", "target_path"))
    titles = titles.withColumn("folded_title", fx.fold(F.col("title")))
    listing = good.select("archive", F.coalesce(F.nullif("title", F.lit("")), "path").alias("title"), "path", "entry_idx")
    listing = listing.withColumn("position", F.row_number().over(Window.partitionBy("archive").orderBy("title", "path")))
    counts = good.groupBy("archive").agg(F.count("*").alias("n"))
    counter = counts.select("archive", F.concat(F.lit("text/markdown="), "n").alias("counter"))
    summary = articles.agg(F.count("*").alias("processed"), F.count_if("readable").alias("converted"), F.count_if(~F.col("readable")).alias("failures"), F.count_if("category").alias("categories"), F.count_if("partial").alias("partials"), F.coalesce(F.sum(F.octet_length("markdown")), F.lit(0)).alias("bytes"))
    return {"articles": good, "full_text": full_text, "titles": titles, "redirects": alive, "listing": listing, "counter": counter, "metadata": meta, "summary": summary}
