"""Postings, lengths and stems against counts in plain Python, with odd texts and repeated keys."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.functions import stem
from folioscope.operators import postings as px
from folioscope.operators import stems
from folioscope.plans import catalog

ROWS = [
    ("en", 1, "Things, thing! the Thing"), ("en", 1, "thing \u00e9t\u00e9\u0301 x2"), ("fr", 1, "things"), ("en", 2, ""), ("en", 3, None), ("de", 4, " ,. "), (None, 5, "thing things"),
    ("en", None, "a"), ("en", 6, "a" * 300 + " b " * 50), ("en", 7, "the"),
]


def words(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower().replace("\u00e9", "e").replace("\u0301", "")).split()


def expected(form=lambda archive, word: word):
    return Counter((a, form(a, w), d) for a, d, t in ROWS for w in words(t))


def counts(posts):
    got = [(tuple(r)[:3], r["wdf"]) for r in posts.select("archive", "term", "doc_id", "wdf").collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "archive string, doc_id long, text string")


@pytest.mark.parametrize("rows", [ROWS, ROWS[1:]])
def test_postings(docs, rows):
    given = docs.where(F.col("text").isNull() | (F.col("text") != ROWS[0][2])) if rows is not ROWS else docs
    assert counts(px.postings(given)) == Counter((a, w, d) for a, d, t in rows for w in words(t))


@pytest.mark.parametrize("most", [1, 9, 1 << 20])
def test_steps(most):
    texts = [None, "", "a b a", " b ", "c" * 20, None, "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["w"])
    parts = list(px.steps(iter([batch, batch.slice(0, 0)]), "w", most))
    assert [t for p in parts for t in p["w"].to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p["w"].to_pylist()) <= most for p in parts)
    found = Counter()
    for k, p in enumerate(parts):
        rows, codes, wdf, words = px.count(p["w"])
        found.update({(sum(x.num_rows for x in parts[:k]) + r, words[c].as_py()): n for r, c, n in zip(rows.tolist(), codes.tolist(), wdf.tolist(), strict=True)})
    assert found == Counter((k, w) for k, t in enumerate(texts) for w in (t or "").split())


def test_no_word_is_exchanged(docs):
    plan = px.postings(docs.where("doc_id > 1"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


@pytest.mark.parametrize("lang", ["en", "de", "fr"])
def test_first_letters(lang):
    rng = random.Random(7)
    made = ["".join(rng.choice("aeiouyäöüßsstndrlg") for _ in range(rng.randint(1, 9))) + rng.choice(["", "ing", "ies", "heit", "ly", "s", "ung", "y"]) for _ in range(5000)]
    for w in [*made, *stem._EN_EXCEPT, "ßy"]:
        assert w.startswith(tuple(stem.first_letters(stem.stem(lang, w))))


def test_stems(docs):
    assert counts(stems.postings(docs)) == expected(stem.stem)
    assert counts(stems.postings(docs, only=["thing"])) == {k: n for k, n in expected(stem.stem).items() if k[1] == "thing"}
    asked = stem.stemmed(px.postings(docs)).where("term = 'thing'")
    assert counts(asked) == {k: n for k, n in expected(stem.stem).items() if k[1] == "thing" and k[0] is not None}


@pytest.mark.parametrize("name", ["doc_length", "indexed_text_size", "postings_build", "stemmed_search"])
def test_queries_on_repeated_keys(spark, docs, tmp_path, name):
    docs.withColumnRenamed("archive", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    if name in ("postings_build", "stemmed_search"):
        assert counts(got) == (expected() if name == "postings_build" else {k: n for k, n in expected(stem.stem).items() if k[1] == "thing"})
        return
    size = Counter()
    for (a, w, d), n in expected().items():
        size[a, d] += n * (1 if name == "doc_length" else len(w.encode()))
    assert {(r["archive"], r["doc_id"]): r[2] for r in got.collect()} == size
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
