import pytest
from pyspark.sql import functions as F

from folioscope import engine
from folioscope.sources import container

APPLE = "<html><body><h1>Apple</h1><p>An apple is the fruit of trees.</p><h2>History</h2><p>From Kazakhstan.</p></body></html>"
ROWS = [
    ("a.zim", "C", "Apple", "Apple", "text/html", APPLE.encode(), None, None),
    ("a.zim", "C", "Banana", "Banana", "text/html", b"<html><body><p>A banana and an apple.</p></body></html>", None, None),
    ("a.zim", "C", "Apple_fruit", None, None, None, "C", "Apple"),
    ("a.zim", "C", "Category:Fruits", "Fruits", "text/html", b'<html><body class="x ns-14"><p>List of fruits</p></body></html>', None, None),
    ("a.zim", "C", "Stub", "Stub", "text/html", b'<html><body><p><a href="Apple">Apple</a></p></body></html>', None, None),
    ("a.zim", "C", "Bad", "Bad", "text/html", b"\xff\xfe", None, None),
    ("a.zim", "M", "Language", None, "text/plain", b"fra,eng", None, None),
    ("a.zim", "X", "inner", None, "text/plain", b"1", None, None),
    ("b.zim", "C", "Cherry", "Cherry", "text/html", b"<html><body><p>A cherry.</p></body></html>", None, None),
]


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("zim")
    for name in ("a.zim", "b.zim"):
        rows = [(*r[1:6], (r[6], r[7]) if r[7] else None) for r in ROWS if r[0] == name]
        (folder / name).write_bytes(container.pack(rows))
    container.register(spark)
    return engine.Library(spark.read.format("zim").load(f"{folder}/a.zim,{folder}/b.zim"))


def test_get_and_sections(library):
    found = library.get("./a.zim", "Apple fruit")
    assert found["path"] == "C/Apple" and found["content"].startswith("# Apple\n\nAn apple") and found["mime_type"] == "text/markdown"
    assert library.get("a.zim", "C/Apple", raw=True)["content"] == APPLE
    assert library.get_section("a.zim", "Apple", "history")["content"] == "From Kazakhstan."
    with pytest.raises(engine.SectionNotFound):
        library.get_section("a.zim", "Apple", "Trivia")
    with pytest.raises(engine.InvalidArgument):
        library.get("a.zim", "X/inner")
    for name in ("nope.zim", "../a.zim", "/etc/a.zim"):
        with pytest.raises(engine.NotFound, match="a.zim, b.zim"):
            library.get(name, "Apple")
    with pytest.raises(engine.NotFound):
        library.get("a.zim", "Nothing")


def test_search(library):
    tables = {name: table.cache() for name, table in library.convert().items()}
    hits = [r["path"] for r in library.search("apple", tables=tables).collect()]
    assert hits == ["C/Apple", "C/Banana"]
    first = library.search("Apple fruit", tables=tables).first()
    assert first["path"] == "C/Apple" and first["preview"] == "An apple is the fruit of trees."
    third = library.search("kazakhstan", tables=tables).first()
    assert third["tier"] == 3 and third["sections"] is None  # one of two regions is over two fifths
    assert library.search("zzzz", tables=tables).count() == 0
    assert [r["zim"] for r in library.search("cherry", "b.zim", tables=tables).collect()] == ["b.zim"]
    with pytest.raises(engine.InvalidArgument):
        library.search("  ")


def test_convert(library):
    made = {k: v.collect() for k, v in library.convert(redirect_titles=True).items()}
    assert {r["path"] for r in made["articles"]} == {"C/Apple", "C/Banana", "C/Cherry", "C/Category:Fruits", "C/Stub"}
    assert {r["path"] for r in made["full_text"]} == {"C/Apple", "C/Banana", "C/Cherry"}
    assert ("C/Apple_fruit", "C/Apple") in {(r["path"], r["target_path"]) for r in made["titles"]}
    assert {(r["archive"], r["counter"]) for r in made["counter"]} == {("a.zim", "text/markdown=4"), ("b.zim", "text/markdown=1")}
    assert ("b.zim", "Language", "eng") in {tuple(r) for r in made["metadata"]} and ("a.zim", "Language", "fra,eng") in {tuple(r) for r in made["metadata"]}
    assert made["summary"][0]["failures"] == 1 and made["summary"][0]["categories"] == 1
    plain = library.convert(exclude_categories=True)
    assert {r["path"] for r in plain["titles"].collect()} == {"C/Apple", "C/Banana", "C/Cherry"}


def test_weighting_schemes(spark):
    import pytest

    from folioscope.operators import ranking as rx

    filler = lambda a, n: " ".join(f"f{i}" for i in range(a, a + n))
    texts = ["zebra", "zebra zebra zebra zebra " + filler(0, 36), "zebra " + filler(36, 14), filler(50, 20), filler(70, 8)]
    docs = spark.createDataFrame([("x", i + 1, t) for i, t in enumerate(texts)], "archive string, doc_id long, text string")
    found = lambda s: [(r["doc_id"], r["score"]) for r in rx.search(docs, ["zebra"], weigh=s).orderBy(F.desc("score"), "doc_id").collect()]
    bm25, trad, bool_ = found(rx.scheme("BM25")), found(rx.scheme("trad", [1.0])), found(rx.scheme("bool", []))
    assert [d for d, _ in bm25] == [2, 1, 3] and all(abs(s - e) < 1e-3 for (_, s), e in zip(bm25, (0.4293, 0.3490, 0.3138), strict=True))
    assert [d for d, _ in trad] == [1, 2, 3] and abs(trad[0][1] - 0.5765) < 1e-3
    assert bool_ == [(1, 0.0), (2, 0.0), (3, 0.0)] and found(rx.scheme("bm25", [1, 0, 1, 0.5, 0.5])) == bm25
    for name, parameters in (("trad", []), ("trad", [1.0, 0.5]), ("bm25", [1.0]), ("bool", [1.0]), ("tfidf", None)):
        with pytest.raises(ValueError, match="parameters|weighting"):
            rx.scheme(name, parameters)


def test_scalar_rules(spark):
    from folioscope.functions import text as fx

    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(fx.preview(F.col("t"))).first()[0]
    assert cut("lorem ipsum " * 29 + "wordthatislong! now more text").endswith("ipsum") and cut("x" * 400) == "x" * 360
    assert cut("a" * 350 + " \n\n" + "b" * 90) == "a" * 350
    mimes = {"text": True, "image/svg+xml; charset=utf-8": True, "application/ld+json": True, "image/png": False, "application/json": True, "application/json; x": False}
    got = spark.createDataFrame([(k,) for k in mimes], "m string").select("m", fx.compressible(F.col("m")).alias("c")).collect()
    assert {r["m"]: r["c"] for r in got} == mimes
