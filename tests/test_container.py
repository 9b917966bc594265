import hashlib

import pytest

from folioscope.sources import container as z

ROWS = [
    ("C", "Apple", "Apple pie", "text/html", b"<p>apple</p>", None),
    ("C", "Bytes", None, None, b"\xff\x00", None),
    ("C", "Alias", "An alias", None, None, ("C", "Apple")),
    ("C", "Chain", None, None, None, ("C", "Alias")),
    ("C", "Lost", None, None, None, ("C", "Nowhere")),
    ("C", "Loop", None, None, None, ("C", "Loop")),
    ("M", "Language", None, "text/plain", b"fra", None),
]


@pytest.fixture
def file(tmp_path):
    (tmp_path / "a.zim").write_bytes(z.pack(ROWS, ("C", "Apple")))
    return tmp_path / "a.zim"


def test_round_trip(spark, file):
    z.register(spark)
    got = {r["full_path"]: r for r in spark.read.format("zim").load(str(file)).collect()}
    assert list(got) == ["C/Alias", "C/Apple", "C/Bytes", "C/Chain", "M/Language"]
    assert bytes(got["C/Apple"]["content"]) == b"<p>apple</p>" and got["C/Apple"]["title"] == "Apple pie"
    assert got["C/Bytes"]["mime_type"] == "application/octet-stream" and got["C/Bytes"]["title"] == "C/Bytes"
    assert got["C/Chain"]["redirect_idx"] == 0 and got["C/Alias"]["redirect_idx"] == 1 and got["C/Alias"]["kind"] == "redirect"
    data = file.read_bytes()
    assert data[-16:] == hashlib.md5(data[:-16]).digest() and z.Container(str(file)).header.main_page == 1


def test_split_files_and_codecs(spark, file, tmp_path):
    data = file.read_bytes()
    for k, name in enumerate(("b.zimaa", "b.zimab", "b.zimac")):
        (tmp_path / name).write_bytes(data[k * 200 : (k + 1) * 200] if k < 2 else data[400:])
    z.register(spark)
    whole = spark.read.format("zim").load(str(file)).drop("archive").collect()
    assert spark.read.format("zim").load(str(tmp_path / "b.zimaa")).drop("archive").collect() == whole


def test_content_option_and_bad_file(spark, file, tmp_path):
    (tmp_path / "bad.zim").write_bytes(b"not one")
    z.register(spark)
    both = f"{file},{tmp_path / 'bad.zim'}"
    assert spark.read.format("zim").option("content", "false").load(str(file)).where("content is not null").count() == 0
    with pytest.raises(z.ContainerError):
        z._Reader({"path": both}).partitions()


def test_errors():
    with pytest.raises(ValueError, match="two entries"):
        z.pack([ROWS[0], ROWS[0]])
    with pytest.raises(z.ContainerError):
        z.Header.parse(b"\0" * 80)
    with pytest.raises(z.ContainerError):
        z.Header.parse(b"short")


def test_sink(spark, tmp_path):
    rows = [("x.zim", *r[:5], *(r[5] or (None, None))) for r in ROWS] + [("y.zim", "C", "One", None, "text/plain", b"1", None, None)]
    frame = spark.createDataFrame(rows, "archive string, namespace string, url string, title string, mime_type string, content binary, target_namespace string, target_url string")
    made = {r["file"]: r["entries"] for r in z.write(frame, f"file://{tmp_path}/out").collect()}
    assert made == {"x.zim": 5, "y.zim": 1}
    z.register(spark)
    assert spark.read.format("zim").load(f"file://{tmp_path}/out/y.zim").first()["url"] == "One"
