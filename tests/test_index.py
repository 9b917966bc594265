import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.operators import index as ix
from folioscope.operators import ranking as rx

ROWS = [("en", 1, "Running runs, the run"), ("en", 2, "the runner sat"), ("en", 3, ""), ("en", 4, None), ("xx", 1, "running the " + "y" * 241), ("de", 7, "Die H\u00e4user the")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "archive string, doc_id long, text string").withColumn("bucket", F.lit("extra"))


@pytest.fixture(scope="module")
def plain(docs, tmp_path_factory):
    return ix.write(docs, f"file://{tmp_path_factory.mktemp('index')}/plain", buckets=8)


def rows(scored):
    return sorted(tuple(r) for r in scored.collect())


def keys(scored):
    return [r[:2] for r in rows(scored)]


def test_scores_equal_those_without_an_index(spark, docs, plain):
    short = docs.withColumn("text", F.coalesce(F.regexp_replace("text", "y{241}", ""), F.lit("")))
    for pooled in (False, True):
        assert rows(plain.search(["the", "run", "the"], pooled)) == rows(rx.search(short, ["the", "run", "the"], pooled))
    again = ix.Index(spark, plain.path)
    assert keys(again.search(["the"], archives=["de"])) == [("de", 7)]
    assert rows(again.search([])) == [] and rows(again.search(["absent"])) == []


def test_reads_only_the_words_folders(plain):
    plan = plain.search(["the"])._jdf.queryExecution().executedPlan().toString()
    assert any("bucket" in part[:120] for part in plan.split("PartitionFilters: [")[1:])
    assert any("term" in part[:200] for part in plan.split("PushedFilters: [")[1:])


def test_postings_are_lists_by_run(spark, docs, tmp_path):
    plain = ix.write(docs.coalesce(1), f"file://{tmp_path}/i", buckets=8)
    lists = spark.read.parquet(f"{plain.path}/postings")
    assert lists.count() < plain.postings.count() == plain.terms.agg(F.sum("df")).first()[0]
    assert {tuple(r) for r in plain.postings.where("term = 'the'").select("archive", "doc_id", "doclen", "wdf").collect()} == {("en", 1, 4, 1), ("en", 2, 3, 1), ("xx", 1, 2, 1), ("de", 7, 3, 1)}


@pytest.mark.parametrize("strategy", ix.STRATEGIES)
def test_runs_equal_one_run(strategy):
    """Documents one at a time give the postings that they give together."""
    columns = [pa.array(["en", "en", "", "", "en"]), pa.array(["en", "en", "xx", None, "en"]), pa.array([1, 2, 1, None, 3]), pa.array(["run the runs run", "", "run " + "y" * 241, "a", "runs running"])]
    whole = pa.RecordBatch.from_arrays(columns, ["stemmer", "archive", "doc_id", "w"])

    def rows(*batches):
        found = pa.Table.from_batches([b for b in ix._runs(strategy)(iter(batches)) if b.num_rows]).to_pylist()
        assert all(r["df"] == len(r["doc_ids"]) and (r["cf"] is None or r["cf"] == sum(r["wdfs"])) for r in found)
        return sorted(((r["kind"], r["archive"], r["term"], d, n, r["wdfs"] and r["wdfs"][k]) for r in found for k, (d, n) in enumerate(zip(r["doc_ids"], r["doclens"], strict=True))), key=repr)

    assert rows(whole) == rows(*(whole.slice(k, 1) for k in range(5)), whole.slice(0, 0))
    terms = {"none": ["run", "runs", "the"], "some": ["Zrun", "Zthe", "run", "runs", "the"], "all": ["run", "the"], "all_z": ["Zrun", "Zthe"]}[strategy]
    assert [r[2] for r in rows(whole) if r[0] == 1 and r[3] == 1 and r[1] == "en"] == terms
    assert [(r[3], r[4]) for r in rows(whole) if r[0] == 0 and r[1] == "en"] == [(1, 8 if strategy == "some" else 4), (2, 0), (3, 4 if strategy == "some" else 2)]


@pytest.mark.parametrize(("strategy", "found"), [("none", [("en", 1), ("xx", 1)]), ("some", [("en", 1), ("xx", 1)]), ("all", [("en", 1), ("xx", 1)]), ("all_z", [("en", 1), ("xx", 1)])])
def test_stems_by_archive(docs, tmp_path, strategy, found):
    made = ix.write(docs, f"file://{tmp_path}/i", strategy=strategy, buckets=8)
    assert keys(made.search(["running"])) == found
    assert keys(made.search(["runs"])) == [("en", 1)]
    assert keys(made.search(["haus"])) == ([] if strategy == "none" else [("de", 7)])
    assert keys(made.all_terms(["running", "runs"])) == [("en", 1)]
    length = {(r["archive"], r["doc_id"]): r["doclen"] for r in made.lengths.collect()}
    assert length == {("en", 1): 8 if strategy == "some" else 4, ("en", 2): 6 if strategy == "some" else 3, ("en", 3): 0, ("en", 4): 0, ("xx", 1): 2, ("de", 7): 6 if strategy == "some" else 3}
    with pytest.raises(ValueError, match="strategy"):
        ix.write(docs, f"file://{tmp_path}/j", strategy="most")


def test_languages_and_empty_tables(docs, tmp_path):
    languages = docs.sparkSession.createDataFrame([("xx", "eng"), ("en", "zho")], "archive string, language string")
    made = ix.write(docs, f"file://{tmp_path}/i", languages=languages, strategy="all", buckets=8)
    assert keys(made.search(["runs"])) == [("en", 1), ("xx", 1)]
    empty = ix.write(docs.limit(0), f"file://{tmp_path}/e")
    assert rows(empty.search(["the"])) == rows(empty.match_all()) == rows(ix.percent(empty.search(["the"]))) == []


def test_boolean_operators(plain):
    a, b = plain.search(["the"]), plain.search(["running"])
    x, y = ({r[:2]: r[2] for r in rows(s)} for s in (a, b))
    as_dict = lambda s: {r[:2]: pytest.approx(r[2], abs=2e-6) for r in rows(s)}
    assert as_dict(ix.either(a, b)) == {k: x.get(k, 0) + y.get(k, 0) for k in x | y}
    assert as_dict(ix.highest(a, b)) == {k: max(x.get(k, 0), y.get(k, 0)) for k in x | y}
    assert as_dict(ix.both(a, b)) == {k: x[k] + y[k] for k in x.keys() & y.keys()}
    assert as_dict(ix.maybe(a, b)) == {k: x[k] + y.get(k, 0) for k in x}
    assert as_dict(ix.without(a, b)) == as_dict(ix.exactly_one(a, b)) == {k: x[k] for k in x.keys() - y.keys()}
    assert as_dict(ix.filtered(a, b)) == {k: x[k] for k in x.keys() & y.keys()}
    assert as_dict(ix.scaled(a, 2.0)) == {k: 2 * v for k, v in x.items()}
    assert len(keys(plain.match_all())) == 6 and keys(plain.wildcard("run")) == [("en", 1), ("en", 2), ("xx", 1)]
    assert {r["term"] for r in plain.expand("run").collect()} == {"running", "runs", "run", "runner"}
    ranked = rx.top(a, 10).collect()
    assert ix.page(a, 1, 2).collect() == ranked[1:3] and ix.page(a, 9, 2).collect() == []
    shares = ix.percent(a).collect()
    assert max(r["percent"] for r in shares) == 100 and {r["percent"] for r in ix.percent(plain.match_all()).collect()} == {100}
