"""Column expressions over pages: a batch's rows become Python objects a step at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.functions import markup, render
from folioscope.operators import sections

PAGES = ["<h1>A</h1><p>one<h2>B</h2><p>two", "", None, "<p>" + "x " * 900_000, "<p>last &amp; least"]


def test_rows_and_order(spark):
    docs = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").coalesce(1)
    got = {r["page_id"]: r for r in docs.select("page_id", sections.html_to_md("html", F.lit("T"), F.lit("eng")).alias("md"), sections.html_unescape("html").alias("u")).collect()}
    assert all(got[k]["md"] == render.html_to_md(p or "", "T", "eng") and got[k]["u"] == (p and markup.unescape(p)) for k, p in enumerate(PAGES))
    rows = [(r["page_id"], r["pos"], r["name"], r["paragraphs"]) for r in sections.sections(docs, "html", ["page_id"]).collect()]
    assert sorted(rows) == [(k, n, name, parts) for k, p in enumerate(PAGES) for n, (name, parts) in enumerate(markup.html_sections(p or ""))]


def test_few_pages_are_objects_at_a_time():
    """Of a batch of 10,000 pages no more than a step's are alive as strings."""
    seen = []
    f = sections._each(lambda s: seen.append(s) or len(s), sections.T.LongType())
    pages = pa.array(["y" * 1000] * 10_000)
    steps = list(sections.px.steps(iter([pa.RecordBatch.from_arrays([pages], ["0"])]), "0", sections.STEP))
    assert len(steps) > 5 and max(s["0"].nbytes for s in steps) < 2 * sections.STEP
    assert f.func(pages).to_pylist() == [1000] * 10_000 and len(seen) == 10_000
