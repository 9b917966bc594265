"""WARC archives: a deterministic sharded writer, and the reader that checks them.

Pages are dealt by ranges of page_id and sorted, and each range is written as files that roll when
their compressed size reaches a limit. A record is a gzip member of its own, with the headers and
digests regenerated from the payload. Of pages with equal payloads the one with the largest page_id
is a response record, the others are revisit records that refer to it. Files appear under their
names only when complete, and the manifest lists those that count; the same rows give the same
bytes, so a repeated task replaces its files by equal ones.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import common, files

ROLL_BYTES = 32 << 20
LEVEL = 5
#: Bytes of a file that the reader decompresses at a time.
CHUNK = 16 << 10
#: The capture date that all records carry, as the tables have none.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'folioscope:{kind}:{key}')}>"


def member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record, as a gzip member whose bytes depend on the record alone."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + press.flush()


def _line(text: str) -> str:
    """A header's value must stay on its line."""
    return " ".join(text.split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http, found = HTTP % len(payload), digest(payload)
    block = http if refers_to is not None else http + payload
    return member(
        [
            ("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", record_id("page", page_id)),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", _line(url or "") or None),
            ("WARC-Payload-Digest", f"sha1:{found}"),
            ("WARC-Block-Digest", f"sha1:{digest(block)}"),
            ("WARC-Profile", PROFILE if refers_to is not None else None),
            ("WARC-Refers-To", record_id("page", refers_to) if refers_to is not None else None),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", len(block)),
            ("X-Page-ID", page_id),
            ("X-Refers-To-Page-ID", refers_to),
        ],
        block,
    )


def with_roles(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with refers_to: the page of an equal payload that a page revisits, or null.

    Null html counts as empty. Rows that repeat a response's page_id and payload are responses too. A null
    page_id counts as the smallest.
    """
    lowest = F.lit(-(2**63))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = keyed.withColumn("_sha", F.sha1(F.col("html").cast("binary")))
    equal = keyed.groupBy("_sha").agg(F.max(F.coalesce("page_id", lowest)).alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    equal = common.table(equal.select("_sha", "_last"), "warc-equal")
    joined = keyed.join(common.small(equal, 200_000), "_sha", "left")
    return joined.withColumn("refers_to", F.when(F.coalesce("page_id", lowest) < F.col("_last"), F.col("_last"))).select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, uri: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives to ``uri`` and returns the manifest: file, shard, part, records, bytes, sha1."""
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("page_id").asc_nulls_first()
    ranged = with_roles(pages).repartitionByRange(n, order).sortWithinPartitions(order, "url", "html")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, part = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal part, size
            name = f"shard-{number:06d}-{part:06d}.warc.gz"
            note = b"software: folioscope\r\nformat: WARC File Format 1.1\r\n"
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("file", name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(note))]
            data = b"".join([member(info, note), *held])
            files.put(uri, name, data)
            row = {"file": [name], "shard": pa.array([number], pa.int32()), "part": pa.array([part], pa.int32()), "records": [len(held)], "bytes": [len(data)], "sha1": [digest(data)]}
            part, size = part + 1, 0
            held.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            ids, urls, pages_, refers = batch.columns
            for page_id, url, payload, to in zip(ids.to_pylist(), urls.to_pylist(), pages_.cast(pa.binary()).to_pylist(), refers.to_pylist(), strict=True):
                held.append(record(page_id, url, payload, to))
                size += len(held[-1])
                if size >= roll_bytes:
                    yield close()
        if held:
            yield close()

    return common.table(ranged.mapInArrow(common.light(shard), "file string, shard int, part int, records long, bytes long, sha1 string"), "warc-manifest")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and blocks of an archive's records, member by member; a chunk of the file at a time is fed."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpress, parts = zlib.decompressobj(31), []
        while not unpress.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            chunk = view[at : at + CHUNK]
            parts.append(unpress.decompress(chunk))
            at += len(chunk) - len(unpress.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC record: {version[:40]}")
        fields = dict(line.split(": ", 1) for line in lines)
        block = rest[: int(fields["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('WARC-Record-ID')} doesn't end as its length says")
        yield fields, block


def read(manifest: DataFrame, uri: str) -> DataFrame:
    """The pages of a manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html.

    Each file's, block's and payload's digest is computed again and compared. A revisit holds no
    payload: its html is null, its length comes from the HTTP header that it repeats.
    """
    columns = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for name, sha1 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, rows = files.get(uri, name), []
                if digest(data) != sha1:
                    raise ValueError(f"{name} isn't the file of the manifest")
                for fields, block in records(data):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}" or kind == "response" and (digest(payload) != stated or len(payload) != length):
                        raise ValueError(f"{name}: record {fields['WARC-Record-ID']} has another digest")
                    key, to = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                    rows.append((int(key) if key else None, fields.get("WARC-Target-URI"), length, stated, kind, int(to) if to else None, payload.decode() if kind == "response" else None))
                    if len(rows) == 512:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "sha1").repartition(n, "file").mapInArrow(common.light(parse), columns)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = common.scratch(spark, "warc")
    manifest = write(common.read(spark, sf_dir, "pages"), uri)
    return read(manifest, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
m AS (SELECT s, max(page_id) AS last FROM p GROUP BY s)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('{_LETTERS}', CAST((CAST('0x' || substr(s, j // 4 * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (j % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p JOIN m USING (s)
"""
