"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes what each stage returns and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import common, decontaminate, jaccard, mixing, toxicity, wavelet
from folioscope.session import ship

#: Near duplicates: shingles of five words, a likeness of 0.8 or more.
SHINGLE, PERCENT = 5, 80
#: Decontamination: a verbatim match of so many words with an item, or so many items that occur, as those of few words do.
MATCH_WORDS, MATCH_ITEMS = decontaminate.WINDOW, 2

#: Iterative stages and trained models have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a network learned from the labelled ones among them."""
    net = toxicity.train(docs, common.read(ship(spark), sf_dir, "labels"))
    return toxicity.score(docs, net).where("score < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each class that links of likeness connect."""
    ship(spark)
    return jaccard.unique(docs, PERCENT, SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a match of MATCH_WORDS words with a benchmark item, and with fewer than MATCH_ITEMS items."""
    found = decontaminate.scan(docs, common.read(ship(spark), sf_dir, "benchmark"))
    leaked = F.exists("matches", lambda m: m["n_words"] >= MATCH_WORDS) | (F.size("items") >= MATCH_ITEMS)
    return found.where(~leaked).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again, up to the limit of repeats."""
    return mixing.mix(docs).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet matrix shards: for each document its place, length and checksum there."""
    ship(spark)
    return wavelet.tokens(docs).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
