"""The driver's tables as a library of archives: documents by language, exact copies as redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TITLE_CHARS = 60


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive, doc_id, path, title, text."""
    docs = read(spark, sf_dir, "documents")
    title = F.left(F.get(F.split("text", "\n"), 0), F.lit(TITLE_CHARS))
    return docs.select(F.col("lang").alias("archive"), "doc_id", F.concat(F.lit("C/doc_"), "doc_id").alias("path"), title.alias("title"), "text")


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirect edges: a document with the same text as an earlier one points to the one before it."""
    docs = read(spark, sf_dir, "documents").select(F.col("lang").alias("archive"), "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    before = F.lag("doc_id").over(Window.partitionBy("archive", "digest").orderBy("doc_id"))
    return docs.select("archive", F.col("doc_id").alias("src"), before.alias("dst")).where("dst is not null")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as directory entries: archive, path, title, mime_type, bytes."""
    docs = articles(spark, sf_dir).select("archive", "path", "title", F.lit("text/plain").alias("mime_type"), F.octet_length("text").alias("bytes"))
    path = F.concat(F.lit("C/page_"), "page_id")
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    pages = read(spark, sf_dir, "pages").select(F.lit("web").alias("archive"), path.alias("path"), title.alias("title"), F.lit("text/html").alias("mime_type"), F.octet_length("html").alias("bytes"))
    return docs.unionByName(pages)
