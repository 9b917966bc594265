"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import os
import random
import weakref
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import common, decontaminate, extract, fingerprint, jaccard, language, mixing, shuffle, toxicity, warc, wavelet

ROWS = [
    (1, "The cat sat on the mat.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "The cat sat on the mat.", "en", "b"),
    (None, "Sans   identité\n \n deux\tmots ici", "fr", "b"),
    (5, "word " * 20_000, "en", "a"),
    (6, " \t\n ", "de", None),
    (7, "日本語 und Ümläute 🙂 don't <|endoftext|> x y  z", "de", "a"),
    (7, "日本語 und Ümläute 🙂 don't <|endoftext|> x y  z", "de", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.char_length("text").cast("long")).repartition(3)


# --- token ids ------------------------------------------------------------------------------------


def test_tokens_round_trip(docs):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = [r.asDict() for r in wavelet.tokens(docs.withColumn("ids", F.lit(1)).withColumn("start", F.lit("clash"))).collect()]
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(ROWS)
    start = 0
    for r, (key, text, *_) in zip(sorted(got, key=lambda r: r["start"]), ordered, strict=True):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (key, start, len(ids))
        assert np.frombuffer(r["ids"], "<u2").tolist() == ids
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_tokens_of_nothing(docs):
    assert wavelet.tokens(docs.limit(0)).count() == 0


def test_pieces_equal_whole_texts():
    code, rng = wavelet.Encoder(public_tokenizers.path("byte_bpe_50k.json"), memory=50), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["ab", "É", " ", "  ", "\n", ".", ",", "'s", "'", "7", "x.", "\t", "日", " ", "🙂", "_", "ß", "\x1c"]) for _ in range(rng.randrange(12)))
        assert code.encode(text) == code.direct(text), repr(text)


def test_encoder_keeps_few_pieces_and_those_that_come_up_again():
    code, asked = wavelet.Encoder(public_tokenizers.path("byte_bpe_50k.json"), memory=1000), []
    texts = [f"Often often {' '.join(f'rare{i}x, odd{i}' for i in range(at, at + 100))} often" for at in range(0, 3000, 100)]
    texts += [" ".join(f"long{i}" for i in range(20_000)), *[f"Single{i}" for i in range(2000)]]
    for text in texts:
        assert code.encode(text) == code.direct(text)
        ages = [code.inner, code.first]
        for p in ages:
            ages += [p.older] if getattr(p, "older", None) else []
        assert sum(map(len, ages)) <= code.memory + 3 * 4096
        asked.append(any("often" in p for p in ages))
    assert all(asked[:30])  # no run of rare pieces drives it out


@pytest.mark.parametrize("n", [1, 7, 511, 512, 513, 5000])
def test_wavelet_matrix_answers(n):
    rng = np.random.default_rng(n)
    values = rng.choice([0, 1, 2, 300, 50256, 65535], n).astype(np.uint16)
    _, _, m = wavelet.unpack(wavelet.pack([None], np.array([n]), values))
    assert (m.decode() == values).all()
    for at in rng.integers(0, n, 20).tolist():
        assert m.access(at) == values[at]
    for v in (0, 2, 300, 65535, 9):
        places = np.flatnonzero(values == v)
        assert m.rank(v, n) == len(places) and m.rank(v, n // 2) == (places < n // 2).sum()
        assert [m.select(v, j) for j in range(min(5, len(places)))] == places[:5].tolist()
        assert m.select(v, len(places)) == -1


def test_long_document_has_a_file_of_its_own(spark, docs):
    uri = common.scratch(spark, "files")
    manifest = wavelet.write(docs, public_tokenizers.path("byte_bpe_50k.json"), uri, file_tokens=64)
    assert manifest.agg(F.sum("documents")).first()[0] == len(ROWS)
    assert manifest.where("documents = 1 and tokens > 64").count() == 1
    assert wavelet.documents(manifest, uri).agg(F.sum("n_tokens")).first()[0] == manifest.agg(F.sum("tokens")).first()[0]


def test_a_task_lets_go_what_another_operator_keeps():
    path = public_tokenizers.path("byte_bpe_50k.json")
    wavelet.encoder(path).encode("some words")
    held = weakref.ref(wavelet.encoder(path))
    list(common.light(iter)(iter([])))
    assert held() is None
    held = weakref.ref(wavelet.encoder(path))
    list(common.light(iter, "wavelet")(iter([])))
    assert held() is wavelet.encoder(path)


# --- shuffle --------------------------------------------------------------------------------------


def test_shuffle_sizes_and_slots(docs):
    got = shuffle.shuffle(docs.withColumn("shard", F.lit("clash")), ["doc_id", "text"], shards=4).toPandas()
    assert len(got) == len(ROWS) and sorted(got.shard.value_counts()) == [2, 2, 2, 3]
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert shuffle.shuffle(docs.limit(0), ["doc_id"]).count() == 0


def test_shuffle_is_uniform(spark):
    many, hits = spark.range(0, 400).withColumnRenamed("id", "doc_id"), Counter()
    for seed in range(6):
        got = shuffle.shuffle(many, ["doc_id"], shards=4, seed=seed).where("doc_id < 200").groupBy("shard").count().collect()
        hits.update({r["shard"]: r["count"] for r in got})
    assert all(240 <= hits[s] <= 360 for s in range(4))


def test_matrix_margins_and_large_draws():
    sizes = [0, 5, 17, 1000, 3]
    m = np.array(shuffle.matrix(sizes, 8, 3))
    assert m.sum(1).tolist() == sizes and max(m.sum(0)) - min(m.sum(0)) <= 1
    rng = np.random.default_rng(0)
    drawn = [shuffle.hypergeometric(rng, 4_000_000_000, 12_000_000_000, 20_000) for _ in range(300)]
    assert abs(np.mean(drawn) - 5000) < 20 and 45 < np.std(drawn) < 80
    assert shuffle.hypergeometric(rng, 5, 2_000_000_000, 0) == 0


def test_shuffle_keeps_columns_of_any_name(spark, docs):
    odd = docs
    for c in ("_h", "h", "row", "block", "piece", "cuts", "before", "r", "slot"):
        odd = odd.withColumn(c, F.lit(c))
    got = shuffle.shuffle(odd, ["doc_id", "text"], shards=4)
    assert got.columns == [*[c for c in odd.columns if c != "slot"], "shard", "slot"]
    assert got.where("r = 'r' and block = 'block' and row = 'row' and _h = '_h'").count() == len(ROWS)


def test_shuffle_query_by_hand(spark, data):
    texts = {r["doc_id"]: r["text"] or "" for r in common.read(spark, data, "documents").collect()}
    rows = shuffle.op4_shuffle(spark, data).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows} == {k: (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) for k, t in texts.items()}
    held = Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) and max(held.values()) - min(held.values()) <= 1 and set(held) == set(range(8))
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in held.items())


def test_shuffle_moves_texts_twice(spark):
    rng, sc = random.Random(4), spark.sparkContext
    docs = common.table(spark.createDataFrame([(i, rng.randbytes(10_000).hex()) for i in range(300)], "doc_id long, text string"), "t")
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    written = lambda: sum(stages().apply(i).shuffleWriteBytes() for i in range(stages().size()))
    once = written()
    docs.repartition(3).write.format("noop").mode("overwrite").save()
    before = written()
    once = before - once
    shuffle.shuffle(docs, ["doc_id", "text"], shards=4).write.format("noop").mode("overwrite").save()
    assert 1.9 * once < written() - before < 2.3 * once


# --- mixing ---------------------------------------------------------------------------------------


def test_mixing_gives_all_and_meets_the_limit(spark, docs):
    got = mixing.mix(docs, max_repeats=2.0, block_tokens=1000)
    assert set(docs.columns) < set(got.columns)
    counts = Counter(r["doc_id"] for r in got.collect())
    assert set(counts) == {r[0] for r in ROWS}
    assert max(counts.values()) <= 4  # doc 7 is there twice
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.withColumn("epoch", F.lit("clash"))).schema["epoch"].dataType.simpleString() == "int"


def test_mixing_keeps_columns_of_any_name(spark, docs):
    odd = docs
    for c in ("tokens", "blocks", "full", "rest", "_row", "_mark", "_key", "_range", "_sid", "_source", "give"):
        odd = odd.withColumn(c, F.lit(c))
    got = mixing.mix(odd)
    assert got.columns == [*odd.columns, "n_tokens", "epoch", "block", "mix_key"]
    assert got.where("tokens = 'tokens' and rest = 'rest' and _row = '_row'").count() == got.count() == mixing.mix(docs).count()


def test_mixing_of_odd_rows_equals_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    got = mixing.mix(docs).select("doc_id", "source", "n_tokens", "epoch", "block", "mix_key").collect()
    assert Counter(map(tuple, got)) == Counter(con.sql(mixing.OP6_SQL).fetchall())


def test_mixing_entropy(spark):
    rows = [(i, "w " * 10, "en", "big" if i < 90 else "small") for i in range(100)]
    frame = spark.createDataFrame(rows, SCHEMA)
    totals = frame.groupBy("source").agg(F.sum(mixing.n_tokens()).alias("tokens"))
    a = mixing.exponent(totals, None, 0.6, None)
    p = np.array([0.9, 0.1]) ** a
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - 0.6) < 1e-6
    taken = mixing.mix(frame, entropy=0.6, budget=500).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()
    assert all(abs(r["t"] - 500 * p[0 if r["source"] == "big" else 1]) <= 10 for r in taken)


# --- fingerprints ---------------------------------------------------------------------------------


def test_fingerprints(spark):
    rng, words = random.Random(2), [f"w{i}" for i in range(1000)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [(0, None), (1, ""), (2, "a b"), (3, "a b"), (4, "a c")] + [(10 + k, " ".join(base[: 400 - 40 * k] + [rng.choice(words) for _ in range(40 * k)])) for k in range(6)]
    got = fingerprint.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), "text", "f")
    f = {r["doc_id"]: r["f"] for r in got.collect()}
    assert f[0] == f[1] == "" and f[2] == f[3] != f[4] and all(len(x) == fingerprint.BINS for k, x in f.items() if k > 1)
    a, b = got.select(F.col("f").alias("a")).where("doc_id = 10"), got.select("doc_id", F.col("f").alias("b"))
    near = {r["doc_id"]: r["s"] for r in b.crossJoin(a).select("doc_id", fingerprint.likeness("a", "b").alias("s")).collect()}
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    for key, text in rows[5:]:
        x, y = shingles(rows[5][1]), shingles(text)
        assert abs(near[key] - len(x & y) / len(x | y)) < 0.15
    assert near[10] == 1.0 and near[0] == 0.0


def _by_hand(text):
    """The fingerprint of a text's shingle hashes, bin by bin; hashes come from Spark."""
    orders, bins = fingerprint._orders(fingerprint.BINS), {}
    for h in text:
        b = (h % 2**64) >> fingerprint._SHIFT
        bins[b] = min(h, bins.get(b, h))
    return bins, orders


def test_fingerprint_by_hand(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (1, 4, 5, 6, 40, 300, 2000)]
    rows = [*enumerate(texts), (50, texts[4]), (51, None), (52, " \t ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_helper_0", F.lit("clash")).withColumn("_full", F.lit("clash")).withColumn("f", F.lit("clash"))
    got = fingerprint.fingerprint(frame, "text", "f")
    assert set(got.columns) == {"doc_id", "text", "_helper_0", "_full", "f"}
    found = {r["doc_id"]: r["f"] for r in got.collect()}
    assert found[50] == found[4] and found[51] == found[52] == ""
    for key, text in enumerate(texts):
        w = text.split()
        pieces = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
        frame = spark.createDataFrame([tuple([*p, *[None] * (5 - len(p))]) for p in pieces], "a string, b string, c string, d string, e string")
        bins, orders = _by_hand([r[0] for r in frame.select(F.xxhash64("a", "b", "c", "d", "e")).collect()])
        digits = []
        for b in range(fingerprint.BINS):
            if b in bins:
                value = bins[b]
            else:
                own = next(bins[x] for x in orders[b] if x in bins)
                value = spark.range(1).select(F.xxhash64(F.lit(own), F.lit(b))).first()[0] if key < 3 else None
            digits.append(None if value is None else f"{value & 15:x}")
        assert len(found[key]) == fingerprint.BINS
        assert all(d is None or d == f for d, f in zip(digits, found[key], strict=True))
    assert fingerprint.fingerprint(frame.limit(0), "a", "f").count() == 0


def test_fingerprint_query_by_hand(spark, data):
    texts = sorted(((r["doc_id"], r["text"] or "") for r in common.read(spark, data, "documents").collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.op10_fingerprint(spark, data).collect()}
    assert len(got) == len(texts)
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set()
    off = []
    for at, (key, text) in enumerate(texts):
        follows, half = texts[(at + 1) % len(texts)][1], len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        assert (got[key]["n_chars"], got[key]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[key]["near_edited"] <= 1 and 0 <= got[key]["near_next"] <= 1
        a, b = sets(text), sets(edited)
        if a and b:
            off.append(abs(got[key]["near_edited"] - len(a & b) / len(a | b)))
    assert np.mean(off) < 0.05


def test_next_document_wraps(spark):
    rows = [(5, "five"), (9, "nine"), (1, "one"), (None, "null"), (7, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.with_next(frame, lambda x: x, ["text"], 40_000).collect()
    assert {r["doc_id"]: r["next"]["text"] for r in got} == {9: "", 7: "five", 5: "one", 1: "null", None: "nine"}


# --- WARC -----------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "dup"), (2, None, "dup"), (3, "u", None), (4, "u", ""), (5, "u", "ü" * 30_000), (None, "u", "dup"), (6, "u", "x\r\n\r\ny")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    uri = common.scratch(spark, "warc")
    manifest = warc.write(pages, uri, roll_bytes=300)
    assert manifest.count() > 1
    got = {r["page_id"]: r for r in warc.read(manifest, uri).collect()}
    assert len(got) == len(rows)
    for key, _, html in rows:
        r, data = got[key], (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), warc.digest(data))
        assert r["html"] == ((html or "") if r["record_type"] == "response" else None)
    assert {k: r["refers_to"] for k, r in got.items()} == {1: 2, 2: None, 3: 4, 4: None, 5: None, None: 2, 6: None}
    again = warc.write(pages.repartition(3), common.scratch(spark, "warc"), roll_bytes=300)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, manifest.collect()))
    assert warc.read(warc.write(pages.limit(0), uri + "e"), uri + "e").count() == 0


def test_warc_equals_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{data}/pages.parquet' union all select 900000 + page_id, url, html from '{data}/pages.parquet' where page_id % 3 = 0 union all select 1900000, null, null")
    rows = con.sql("select page_id, url, html from pages").fetchall()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    uri = common.scratch(spark, "warc")
    got = warc.read(warc.write(pages, uri), uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").orderBy("page_id").collect()
    assert list(map(tuple, got)) == con.sql(warc.OP3_SQL + " ORDER BY page_id").fetchall()


def test_warc_reader_is_linear_and_whole():
    data = b"".join(warc.record(i, "u", f"page {i} ".encode() * (1 + i % 7 * 4000), None) for i in range(60))
    assert [int(f["X-Page-ID"]) for f, _ in warc.records(data)] == list(range(60))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(data[:-20]))


# --- decontamination ------------------------------------------------------------------------------


def test_suffix_array_order():
    rng = np.random.default_rng(4)
    ids = rng.integers(1, 4, 300).astype(np.uint32)
    order = decontaminate.SuffixArray(ids, 300).order
    assert order.tolist() == sorted(range(300), key=lambda i: ids[i:].tolist())


def test_decontamination_equals_sql(spark, data):
    con = duckdb.connect()
    item = con.sql(f"select text from '{data}/benchmark.parquet' order by item_id limit 1").fetchall()[0][0]
    rows = [(1, None), (2, ""), (3, "x " + item.upper() + " y"), (4, item + " " + item), (5, "short one here"), (6, "a short one, here it is"), (7, item[: len(item) // 2])]
    items = [(0, item), (1, "Short ONE"), (2, None), (3, "!!"), (4, item)]
    documents, benchmark = pd.DataFrame(rows, columns=["doc_id", "text"]), pd.DataFrame(items, columns=["item_id", "text"])  # noqa: F841
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    expected = con.sql(decontaminate.OP5_SQL + " ORDER BY doc_id").fetchall()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit("clash"))
    found = decontaminate.scan(frame, spark.createDataFrame(items, "item_id long, text string"))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), len(r["items"]) >= 2) for r in found.orderBy("doc_id").collect()]
    assert got == expected
    assert decontaminate.scan(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.scan(frame, spark.createDataFrame([], "item_id long, text string")).where("size(items) > 0").count() == 0


def test_blocks_of_the_benchmark_agree(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"alpha{i} beta gamma delta eps zeta eta theta iota{i % 3}") for i in range(9)], "item_id long, text string")
    frame = spark.createDataFrame([(1, " ".join(f"alpha{i} beta gamma delta eps zeta eta theta iota{i % 3}" for i in range(0, 9, 2)))], "doc_id long, text string")
    whole = decontaminate.scan(frame, items).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    assert decontaminate.scan(frame, items).collect() == whole and whole[0]["items"] == [str(i) for i in range(9)]


def test_common_passages_stay_bounded(monkeypatch):
    line = b"one common line of exactly eight words here".split()
    held = [(str(i), [*line, b"tail%d" % i, *line]) for i in range(40)]
    block = decontaminate.Block.load(decontaminate.Block.of(held).dump())
    texts = [b" ".join([*line, b"x", *line, b"tail3"]) for _ in range(30)] + [None, b"none of it"]
    whole = decontaminate.search(texts, lambda: iter([block]))
    assert all(n_hit == 17 and len(items) == 40 and len(matches) == 40 for _, n_hit, items, matches in whole[:30])
    assert ("3", 9, 0, 9) in whole[0][3] and ("4", 0, 0, 8) in whole[0][3] and whole[30][1:3] == (0, [])
    monkeypatch.setattr(decontaminate, "PAIRS", 7)
    assert decontaminate.search(texts, lambda: iter([block])) == whole


def test_longest_matches_equal_brute_force():
    rng = random.Random(3)
    held = [(str(i), [b"ab"[k : k + 1] for k in (rng.randrange(2) for _ in range(rng.choice([3, 9, 14])))]) for i in range(8)]
    texts = [b" ".join(b"ab"[k : k + 1] for k in (rng.randrange(2) for _ in range(n))) for n in (0, 5, 30, 60)]
    found = decontaminate.search(texts, lambda: iter([decontaminate.Block.of(held)]))
    for text, (_, _, _, matches) in zip(texts, found, strict=True):
        w, wanted = text.split(), []
        for item, own in held:
            least, best = min(len(own), decontaminate.WINDOW), None
            for p in range(len(w)):
                for j in range(len(own)):
                    n = 0
                    while p + n < len(w) and j + n < len(own) and w[p + n] == own[j + n]:
                        n += 1
                    if n >= least and (best is None or n > best[2]):
                        best = (p, j, n)
            if best:
                wanted.append((item, *best))
        assert matches == sorted(wanted)


# --- near duplicates ------------------------------------------------------------------------------


def classes_by_hand(texts, percent, size):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            common_ = len(a & sets[j])
            if a and sets[j] and 100 * common_ >= percent * (len(a) + len(sets[j]) - common_):
                x, y = label[i], label[j]
                label = [min(x, y) if k in (x, y) else k for k in label]
    return label, [len(s) for s in sets]


@pytest.mark.parametrize(("percent", "size", "block"), [(90, 3, 2048), (80, 5, 12)])
def test_classes_equal_brute_force(spark, monkeypatch, percent, size, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rng, words = random.Random(percent), [f"w{i}" for i in range(200)]
    texts = [None, "", "one", "one", "two words", "ONE"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 9, 12, 30, 90, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 3])):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randrange(9)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    label, sizes = classes_by_hand(texts, percent, size)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(frame, percent, size).collect()}
    assert got == {i: (sizes[i], label[i]) for i in range(len(texts))}


def test_classes_of_odd_rows(spark, docs):
    got = Counter(tuple(r) for r in jaccard.classes(docs).collect())
    assert got[(4, 4, 1)] == 1 and got[(7, 4, 7)] == 2 or sum(got.values()) == len(ROWS)
    assert jaccard.classes(docs.limit(0)).count() == 0


def test_classes_of_null_and_repeated_ids(spark):
    # a, b and c: texts that link with nothing else
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a), (5, a), (9, a), (3, b), (4, c), (7, b), (7, c), (8, c + " more"), (7, c), (None, "z z z"), (None, "z z z"), (2, None), (2, None), (6, "alone")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard.classes(frame, 80, 5).collect())
    assert got == {(None, 5): 1, (5, 5): 1, (9, 5): 1, (3, 3): 1, (7, 3): 1, (4, 4): 1, (7, 4): 2, (8, 4): 1, (None, None): 2, (2, 2): 2, (6, 6): 1}
    left = Counter(tuple(r) for r in jaccard.unique(frame, 80, 5).collect())
    assert left == {(5, a): 1, (3, b): 1, (4, c): 1, (None, "z z z"): 1, (2, None): 2, (6, "alone"): 1}
    assert jaccard.unique(frame.limit(0), 80, 5).count() == 0


def test_shared_passages_tie_no_texts(spark, monkeypatch):
    # every passage is in two texts, so no order puts a text's own shingles first; no two texts link
    rng, held, table = random.Random(2), {}, common.table

    def kept(df, label, *more):
        held.setdefault(label, []).append(table(df, label, *more))
        return held[label][-1]

    monkeypatch.setattr(common, "table", kept)
    ends = [e for _ in range(5) for e in rng.sample(range(200), 200)]
    texts = [[] for _ in range(200)]
    for k in range(0, len(ends), 2):
        for e in ends[k : k + 2]:
            texts[e] += [f"p{k}w{i}" for i in range(24)]
    frame = spark.createDataFrame([*enumerate(map(" ".join, texts)), (200, " ".join(texts[0][:-2]))], "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in jaccard.unique(frame, 80, 5).collect()} == set(range(200))
    assert {r["id"] for r in held["jaccard-may-all"][0].collect()} == {0, 200}
    # what is read no more is gone: signatures and the texts that were compared
    folders = [f.removeprefix("file:") for label in ("jaccard-sets", "jaccard-texts") for df in held[label] for f in df.inputFiles()]
    assert folders and not any(os.path.exists(f) for f in folders)


def test_sized_ties_connect_what_may_link():
    rng = np.random.default_rng(3)
    for percent, spread in ((80, 40), (80, 400), (90, 40)):
        sizes = rng.integers(100, 100 + spread, 900)
        signs = rng.integers(0, 12 if spread == 400 else 60, 900).astype(np.uint64)
        steps, nodes = np.array([jaccard._size_step(int(n)) for n in sizes], np.uint8), rng.permutation(900).astype(np.int64)
        edges = []
        parts = [jaccard._thinned(signs[k::2], steps[k::2], nodes[k::2]) for k in range(2)]
        edges += [(a, b) for *_, x, y in parts for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        ties, pairs = jaccard._sized(*(np.concatenate([p[i] for p in parts]) for i in range(3)), percent)
        label = list(range(900))

        def root(x, label=label):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in edges + ties.tolist():
            label[root(a)] = root(b)
        pairs = set(map(tuple, pairs.tolist()))
        for i in range(900):
            for j in range(i):
                if signs[i] == signs[j] and 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]):
                    a, b = int(nodes[i]), int(nodes[j])
                    assert (max(a, b), min(a, b)) in pairs or root(a) == root(b)
        assert len(pairs) + len(ties) < 900 * jaccard.PAIRED / 2


def test_parities_lose_no_link():
    rng = np.random.default_rng(4)
    linked = dropped = 0
    for _ in range(800):
        percent, n = int(rng.choice([80, 90])), int(rng.integers(1, 700))
        tokens = rng.permutation(np.unique(rng.integers(1, 2**63, 3 * n + 9).astype(np.uint64)))
        a, b = np.sort(tokens[:n]), np.sort(tokens[int(rng.integers(0, n // 4 + 1)) : n + int(rng.integers(0, n // 6 + 1))])
        may = lambda x, y, p=percent: jaccard.may_link(len(x), jaccard.parity(x), len(y), jaccard.parity(y), p)
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            linked += 1
            assert may(a, b) and may(b, a)
        dropped += n >= 50 and not may(a, np.sort(tokens[n // 2 : n // 2 + n]))
    assert linked > 50 and dropped > 600


def test_every_linked_pair_shares_a_prefix_shingle():
    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 5, jaccard.CELLS).astype(np.uint8)
    linked = 0
    for _ in range(600):
        percent, n = int(rng.choice([80, 90])), int(rng.integers(1, 120))
        tokens = np.unique(rng.integers(1, 2**63, 2 * n).astype(np.uint64))
        a, b = tokens[:n], tokens[int(rng.integers(0, n // 4 + 1)) : n + int(rng.integers(0, n // 6 + 1))]
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            linked += 1
            assert len(np.intersect1d(jaccard.prefix(a, sketch, percent), jaccard.prefix(b, sketch, percent)))
    assert linked > 50


def test_every_linked_pair_shares_a_signature():
    rng, levels = np.random.default_rng(1), {90: jaccard.Levels(90), 80: jaccard.Levels(80)}
    for _ in range(400):
        percent, n = int(rng.choice([80, 90])), int(rng.integers(4, 120))
        tokens = np.unique(rng.integers(1, 2**63, 2 * n).astype(np.uint64))
        a, b = tokens[:n], tokens[int(rng.integers(0, n // 4 + 1)) : n + int(rng.integers(0, n // 6 + 1))]
        both = len(np.intersect1d(a, b))
        if not np.array_equal(a, b) and 100 * both >= percent * (len(a) + len(b) - both):
            assert len(np.intersect1d(jaccard.signatures(a, levels[percent]), jaccard.signatures(b, levels[percent])))


def test_count_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(3)
    points = rng.poisson(4, (500, jaccard.GROUPS))
    points[100:200] = points[0] + rng.integers(0, 2, (100, jaccard.GROUPS)) * (rng.random((100, jaccard.GROUPS)) < 0.1)
    sizes = points.sum(1)
    tree = jaccard.CountTree(points, sizes, 90)
    for i in range(0, 500, 25):
        fits = np.flatnonzero(np.minimum(points, points[i]).sum(1) * 190 >= 90 * (sizes + sizes[i]))
        assert sorted(tree.search(points[i], int(sizes[i])).tolist()) == fits.tolist()


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10} | {100 + i: 100 for i in range(41)}


# --- language -------------------------------------------------------------------------------------


def test_language_spans(spark, docs):
    rows = [("the cat and the dog were in the house with that", "en"), ("der hund und die katze waren in dem haus mit", "de"), ("кот и собака были в доме", "ru")] * 3
    model = language.learn(rows)
    mixed = spark.createDataFrame([(1, "the dog was in the house and the cat was there und die katze und der hund waren in dem haus"), (2, "собака the"), (3, None), (4, "12 !?")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.label(mixed, model).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "de"] and sum(s["n_words"] for s in got[1]["spans"]) == 21
    assert got[2]["lang_pred"] == "ru" and got[3]["lang_pred"] == got[4]["lang_pred"] == "und"
    assert language.label(docs, model).count() == len(ROWS) and language.label(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in language.label(docs, language.learn([])).collect()} == {"und"}


def test_scripts_that_a_language_lacks_are_closed_to_it(spark):
    model = language.learn([("the cat and the dog were in the house with that", "en"), ("кот и собака были в доме", "ru")] * 3)
    rows = [(1, "the the собака доме the"), (2, "½ ² Ⅷ ①"), (3, "½the²"), (4, "日本 the")]
    got = {r["doc_id"]: r for r in language.label(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")), model).collect()}
    assert [(s["lang"], s["n_words"]) for s in got[1]["spans"]] == [("en", 2), ("ru", 2), ("en", 1)] and got[1]["lang_pred"] == "ru"
    assert got[2]["lang_pred"] == "und" and got[3]["lang_pred"] == got[4]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_beyond_a_byte():
    scores = np.full((3, 300), -5.0, np.float32)
    scores[:, 299] = 0
    assert language.viterbi(scores, [3]).tolist() == [299] * 3


def test_chunks_of_long_texts_agree(spark, monkeypatch):
    model = language.learn([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 3)
    frame = spark.createDataFrame([(i, "the dog " * (50 * i) + "der hund und " * 20) for i in range(6)], "doc_id long, text string")
    whole = sorted(language.label(frame, model).collect())
    monkeypatch.setattr(language, "CHUNK_WORDS", 90)
    batch = __import__("pyarrow").RecordBatch.from_pydict({"doc_id": [r[0] for r in whole], "text": [r["text"] for r in frame.orderBy("doc_id").collect()]})
    found = [x for _, texts in language._chunks(batch) for x in language._label(texts, model, language._table(model))]
    assert [x[0] for x in found] == [r["lang_pred"] for r in whole] and [x[2] for x in found] == [[s.asDict() for s in r["spans"]] for r in whole]


def test_language_scores_by_hand():
    model = language.learn([("aba", "x"), ("bab", "y")])
    marked, logs = "\x02abb\x03", []
    for k in range(2):
        total = 0.0
        for n in language.ORDERS:
            for i in range(len(marked) - n + 1):
                h, _ = language.grams(["abb"], (n,))
                total += model.weights[int(h[i] % np.uint64(language.BUCKETS)), k]
        logs.append(total)
    logs = np.array(logs) - max(logs)
    share = np.log(np.exp(logs) / np.exp(logs).sum())
    assert np.allclose(model.scores(["abb"])[0], np.maximum(share, language.FLOOR), atol=1e-4)


def test_language_training_sample_is_whole_and_even(spark):
    rows = [(i, "une phrase " + "mot " * 30_000 if i % 10 == 0 else "the cat sat", "fr" if i % 10 == 0 else "en") for i in range(200)]
    model = language.train(spark.createDataFrame([*rows, (None, None, None), (1, "x", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr"]
    assert language.train(spark.createDataFrame([], "doc_id long, text string, lang string")).languages == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    lengths = [3, 0, 5, 1]
    scores = rng.normal(size=(sum(lengths), 3)).astype(np.float32)
    got, at = language.viterbi(scores, lengths, 0.7), 0
    for n in lengths:
        part, best = scores[at : at + n], -1e9
        for path in np.ndindex(*[3] * n):
            best = max(best, sum(part[t, p] for t, p in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:], strict=False)))
        own = got[at : at + n]
        assert abs(sum(part[t, p] for t, p in enumerate(own)) - 0.7 * (own[1:] != own[:-1]).sum() - best) < 1e-4
        at += n


def test_language_held_out_accuracy(spark, data):
    got = language.op7_language_spans(spark, data).where("held_out").join(common.read(spark, data, "documents"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()


# --- toxicity -------------------------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.learn([("a b", 0), ("c d", 1)])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask, y = rng.normal(size=(3, 5, toxicity.INPUTS)), np.arange(5) < np.array([[5], [3], [1]]), np.array([1, 0, 1])
    loss = lambda: np.logaddexp(0, np.where(y, -1, 1) * net.forward(x, mask)).mean()
    grad, d_x = net.gradients(x, mask, y)
    grad["x"], net.w["x"] = d_x * mask[..., None], x
    for key, g in grad.items():
        for at in [tuple(rng.integers(0, s) for s in g.shape) for _ in range(4)]:
            old = net.w[key][at]
            net.w[key][at] = old + 1e-3
            up = loss()
            net.w[key][at] = old - 1e-3
            down = loss()
            net.w[key][at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3


def test_windows_cover_all_words():
    text, first, size = toxicity.windows([0, 1, 64, 65, 200])
    covered = Counter()
    for t, f, n in zip(text, first, size, strict=True):
        covered[t] = max(covered[t], f + n)
    assert dict(covered) == {1: 1, 2: 64, 3: 65, 4: 200} and (size <= toxicity.WINDOW).all()


def test_toxicity_learns(spark, docs):
    rng, words = random.Random(0), [f"w{chr(97 + i % 26)}{i}" for i in range(300)]
    rows = []
    for i in range(500):
        t = [rng.choice(words) for _ in range(rng.choice([20, 90, 200]))]
        if i % 5 == 0:
            t[rng.randrange(len(t))] = f"vile{rng.choice(words)}"
        rows.append((" ".join(t), int(i % 5 == 0)))
    net = toxicity.learn(rows[:400])
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows[400:])], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, net).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, (_, y) in enumerate(rows[400:])]) > 0.9
    odd = {(r["doc_id"], r["score"]) for r in toxicity.score(docs.withColumn("score", F.lit("clash")), net).collect()}
    assert (2, 0.0) in odd and (3, 0.0) in odd and all(0 <= s <= 1 for _, s in odd)
    assert toxicity.score(docs.limit(0), net).count() == 0


def test_toxicity_trains_on_the_cluster(spark):
    rng, plain = random.Random(1), [f"w{i}" for i in range(200)]
    texts = [(i, " ".join(rng.choice(plain) for _ in range(30)) + (" vile" if i % 4 == 0 else "")) for i in range(240)]
    docs = spark.createDataFrame([*texts, (900, None), (None, "vile")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(900, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels)
    kept = sorted((i for i, _ in texts if zlib.crc32(str(i).encode()) % 5), key=lambda i: (spark.range(1).select(F.xxhash64(F.lit(i).cast("long"))).first()[0], i))
    by_hand = toxicity.learn([(texts[i][1], int(i % 4 == 0)) for i in kept])
    assert np.allclose(net.odds, by_hand.odds) and all(np.allclose(net.w[k], by_hand.w[k]) for k in net.w) and np.allclose(net.scale, by_hand.scale)
    again = toxicity.Network.load(net.dump())
    assert (again.vectors == net.vectors).all() and again.scale == net.scale
    assert toxicity.train(docs.limit(0), labels).scale[0] == 0.0


def test_score_is_that_of_the_loudest_window(spark):
    rng, plain = random.Random(2), [f"w{i}" for i in range(80)]
    net = toxicity.learn([(" ".join(rng.choice(plain) for _ in range(20)) + (" vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)])
    text = [rng.choice(plain) for _ in range(300)]
    text[217] = "vile"
    got = toxicity.score(spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string"), net).first()
    x = net.features(text)
    each = [float(net.forward(x[None, at : at + toxicity.WINDOW], None)[0]) for at in range(0, 300 - toxicity.WINDOW + toxicity.STRIDE, toxicity.STRIDE)]
    assert abs(got["score"] - 1 / (1 + np.exp(-(net.scale[0] * max(each) + net.scale[1])))) < 1e-4
    assert got["at"] == toxicity.STRIDE * int(np.argmax(each))


def test_scoring_holds_few_words_at_a_time(spark):
    sizes = [0, 5, toxicity.HELD_BYTES, 3, 2 * toxicity.HELD_BYTES, *[1] * (toxicity.HELD_TEXTS + 1), 7]
    runs = list(toxicity.slices(sizes))
    assert [a for a, _ in runs] == [0, *[b for _, b in runs[:-1]]] and runs[-1][1] == len(sizes)
    assert all(b - a == 1 or b - a <= toxicity.HELD_TEXTS and sum(sizes[a:b]) <= toxicity.HELD_BYTES for a, b in runs) and list(toxicity.slices([])) == []
    rng, plain = random.Random(3), [f"word{i}" for i in range(80)]
    net = toxicity.learn([(" ".join(rng.choice(plain) for _ in range(20)) + (" vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)])
    texts = [" ".join(rng.choice(plain) for _ in range(n)) + end for n, end in [(90_000, " vile"), (50, ""), (90_000, ""), (0, "vile")]] + [None]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), net).collect()
    alone = [toxicity.score(spark.createDataFrame([(i, t)], "doc_id long, text string"), net).first() for i, t in enumerate(texts)]
    assert [(r["doc_id"], r["text"], r["at"]) for r in got] == [(r["doc_id"], r["text"], r["at"]) for r in alone]
    assert np.allclose([r["score"] for r in got], [r["score"] for r in alone], atol=1e-5)


# --- extraction -----------------------------------------------------------------------------------


def test_extraction_of_shared_templates():
    page = '<!DOCTYPE html><html><head><title>{0}</title><script>var a="</p>";</script></head><body><nav><a href="/{0}">{0}</a></nav><div class="ad">buy {0}</div><div id="c"><h2>T {0}</h2><p>one {0}<br>&amp; two &#x41;<p>three   {0}</div><div class="comments"><p>me {0}</p></div><footer>&copy; {0}</footer>'
    got = extract.extract_block([page.format(f"w{i} x{i}") for i in range(6)])
    assert got == [f"T w{i} x{i}\none w{i} x{i} & two A\nthree w{i} x{i}" for i in range(6)]


def test_template_classes():
    template = extract.deduce([extract.parse(f"<div><b>Price</b> <i>{i}</i> EUR</div>" + "<p>x</p>" * (i + 1)) for i in range(4)])
    assert [v for k, v, _ in template.outer if k == "t"] == ["Price", "EUR"]
    assert any({("<", "p", "/p"), (">", "p", "/p")} <= c for c in template.nested)


def test_extraction_by_classes():
    # the site's words go, also those of rows that repeat; a class name says nothing here; the article holds too little
    row = "<li><b>User</b> {0}{1} <i>wrote</i></li>"
    pages = ["<div class=widget><h1>Notes of <u>n{0}</u></h1><ul>{1}</ul><h6>Page end</h6></div><article>small</article>".format(i, "".join(row.format(i, j) for j in range(1 + i % 4))) for i in range(12)]
    assert extract.extract_block(pages) == ["\n".join([f"n{i}", *[f"{i}{j}" for j in range(1 + i % 4)]]) for i in range(12)]


def test_nested_classes_keep_order_and_gap():
    pages = [extract.parse("<h1>a</h1>" + "<p><b>x</b><i>y</i></p>" * (1 + i % 3) + "<h2>b</h2>" + "<ol><li>l</ol>" * (1 + i % 2) + "<h3>c</h3>" + "<ol><li>l</ol>" * (1 + i % 2)) for i in range(12)]
    found = extract.deduce(pages)
    assert len(found.nested) == len(found.gaps) == 1 and ("t", "x", "/p/b") in found.nested[0]
    assert found.outer[found.gaps[0]] == ("<", "h2", "/h2")  # the lists stand in two gaps
    swapped = [extract.parse("<h1>a</h1>" + ("<b>x</b><i>y</i>" if i % 2 else "<i>y</i><b>x</b>") * (1 + i % 3)) for i in range(12)]
    assert extract.deduce(swapped).nested == []
    assert extract._kept(list("abcd"), list("bcda")) == list("bcd")  # one token astray costs no other


def test_equal_pages_count_once():
    page = "<html><body><nav>Menu of the site</nav><div><h1>Title</h1><p>Body text here</p><p>Inner</p></div></body></html>"
    assert extract.extract_block([page] * 40) == ["Title\nBody text here\nInner"] * 40 == extract.extract_block([page]) * 40
    other = [page.replace("Title", f"T{i}").replace("Body", f"B{i}").replace("Inner", f"In{i} own words") for i in range(20)]
    both = extract.extract_block([*other, *[page] * 300])
    assert both[:20] == extract.extract_block([*other, page])[:20] and len(set(both[20:])) == 1


def test_tags_left_open_and_headers_of_articles():
    assert extract.extract_block(['A0 <a href="x>bad']) == ["A0 bad"]
    assert extract.extract_block(["A0 <a href='x <b>bold</b> end"]) == ["A0 bold end"]
    page = '<body><header>Site</header><article><div class="entry-header"><h1>Headline</h1></div><p>Text</p><div class="share-links">Tell all</div></article></body>'
    assert extract.extract_block([page]) == ["Headline\nText"]


@pytest.mark.parametrize("tag", ["div", "b", "ul><li"])
def test_pages_nested_without_end(tag):
    deep = f"<{tag}>" * 50_000
    began = __import__("time").perf_counter()
    assert extract.extract_block([f"top <p>one</p>{deep}inmost" + "<div>x</div></i>" * 20_000])[0].count("\nx") == 20_000
    assert __import__("time").perf_counter() - began < 20


def test_very_long_pages_stay_whole(spark):
    body = "".join(f"<p>line {i} of it</p>" for i in range(30_000))
    rows = [(i, "http://h/", f"<body><div class='menu'>home</div><article>{body if i == 0 else f'<p>short {i}</p>'}</article></body>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].split("\n") == [f"line {i} of it" for i in range(30_000)] and got[1] == "short 1"


def test_extraction_of_odd_pages(spark):
    rows = [(1, None, None), (2, "http://x/", "plain <b>a</b> & b"), (3, "HTTP://X/", "<p>yes <p>z<script>x"), (3, "HTTP://X/", "<p>yes <p>z<script>x"), (None, "zz", "<ul><li>a<li>b</ul></x>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = [(r["page_id"], r["text"]) for r in extract.extract(pages).collect()]
    assert sorted(got, key=repr) == sorted([(1, ""), (2, "plain a & b"), (3, "yes\nz"), (3, "yes\nz"), (None, "a\nb")], key=repr)
    assert extract.extract(pages.limit(0)).count() == 0
