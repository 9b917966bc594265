"""The pipeline's stages, each on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import common


def planted(spark, data):
    docs = common.read(spark, data, "documents")
    item = common.read(spark, data, "benchmark").orderBy("item_id").first()["text"]
    own = docs.where("n_chars > 800").orderBy("doc_id").first()
    rows = [(900_001, f"Some words before. {item} And some after.", "en", "src1", 0), (900_002, own["text"] + " more", own["lang"], "src2", 0), (900_003, None, None, None, None)]
    return docs.union(spark.createDataFrame(rows, docs.schema)), own["doc_id"]


def test_stages(spark, data):
    docs, own = planted(spark, data)
    docs = common.table(docs, "t")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    clean = stages["toxicity"](spark, docs, data)
    assert clean.columns == docs.columns and ids(clean) < ids(docs) and 900_003 in ids(clean)
    unique = stages["near_duplicates"](spark, docs, data)
    assert unique.columns == docs.columns and {own, 900_001} <= ids(unique) and 900_002 not in ids(unique)
    left = stages["decontamination"](spark, docs, data)
    assert left.columns == docs.columns and 900_001 not in ids(left) and {own, 900_002, 900_003} <= ids(left)
    mixed = stages["mixing"](spark, docs, data)
    assert mixed.columns == docs.columns and ids(mixed) == ids(docs)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    written = stages["token_ids"](spark, docs, data)
    assert ids(written) == ids(docs) and {"start", "n_tokens", "ids_crc32"} < set(written.columns)
    for stage in list(stages.values()):
        assert stage(spark, docs.limit(0), data).count() == 0


def test_run(spark, data):
    assert 0 < corpus_pipeline.run(spark, data).count()
