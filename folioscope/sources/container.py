"""ZIM containers as a Spark data source, and as a sink: one file an archive.

The source splits a file into ranges of entries and decodes the clusters that a range needs. Columns: see
``SCHEMA``. Path-sorted entries, redirects, metadata and indexes all come as rows. The format is the
public one: an 80-byte header, the MIME list, pointer lists, entries, clusters, an MD5 of all that.
"""

from __future__ import annotations

import hashlib
import lzma
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, entry_idx long, namespace string, url string, full_path string, title string, mime_type string, kind string, redirect_idx long, content binary"

# Fixed values of the format.
MAGIC = 0x044D495A
HEADER = struct.Struct("<IHH16sIIQQQQIIQ")
REDIRECT, LINK_TARGET, DELETED = 0xFFFF, 0xFFFE, 0xFFFD
NONE_32 = 0xFFFFFFFF
PLAIN, LZMA, ZSTD, EXTENDED = (0, 1), 4, 5, 0x10
CLUSTER_BYTES = 2 << 20
ENTRIES_A_PARTITION = 8192


class ContainerError(ValueError):
    """The file isn't a container that can be read."""


@dataclass
class Header:
    major: int
    minor: int
    uuid: bytes
    entries: int
    clusters: int
    url_list: int
    title_list: int
    cluster_list: int
    mime_list: int
    main_page: int | None
    checksum: int

    @classmethod
    def parse(cls, data: bytes) -> Header:
        if len(data) < HEADER.size:
            raise ContainerError("the file is shorter than a header")
        magic, major, minor, uid, entries, clusters, urls, titles, cluster_list, mimes, main, _, checksum = HEADER.unpack_from(data)
        if magic != MAGIC or major not in (5, 6):
            raise ContainerError(f"not a container of version 5 or 6: {data[:6].hex()}")
        if mimes != HEADER.size:
            raise ContainerError(f"the MIME list is at {mimes}, not after the header")
        return cls(major, minor, uid, entries, clusters, urls, titles, cluster_list, mimes, None if main == NONE_32 else main, checksum)


class Parts:
    """A file, or its parts (.zimaa, .zimab, ...) as one address space."""

    def __init__(self, path: str):
        store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        names = [inner]
        if inner.endswith(".zimaa"):
            folder, _, name = inner.rpartition("/")
            found = store.get_file_info(fs.FileSelector(folder or "."))
            names = sorted(f.path for f in found if f.base_name[:-2] == name[:-2] and f.base_name[-2:].isalpha())
        self.files = [store.open_input_file(n) for n in names]
        self.ends, total = [], 0
        for f in self.files:
            total += f.size()
            self.ends.append(total)
        self.size = total

    def read(self, at: int, n: int) -> bytes:
        out, start = [], 0
        for f, end in zip(self.files, self.ends, strict=True):
            if n and at < end:
                part = f.read_at(min(n, end - at), at - start)
                out.append(part)
                at, n = at + len(part), n - len(part)
            start = end
        return b"".join(out)


class Container:
    def __init__(self, path: str, clusters_kept: int = 4):
        self.parts = Parts(path)
        self.header = Header.parse(self.parts.read(0, HEADER.size))
        h = self.header
        for name, at in (("entry", h.url_list + 8 * h.entries), ("cluster", h.cluster_list + 8 * h.clusters)):
            if at > self.parts.size:
                raise ContainerError(f"the {name} list runs past the end of the file")
        self.kept: OrderedDict[int, list[bytes]] = OrderedDict()
        self.clusters_kept = clusters_kept

    @cached_property
    def mimes(self) -> list[str]:
        at, data = self.header.mime_list, b""
        while b"\0\0" not in data and not data.startswith(b"\0"):
            part = self.parts.read(at + len(data), 1024)
            if not part:
                raise ContainerError("the MIME list has no end")
            data += part
        return [] if data.startswith(b"\0") else data[: data.index(b"\0\0")].decode().split("\0")

    def entry(self, index: int) -> tuple[int, str, str, str, int, int]:
        """MIME number, namespace, url, title, and two numbers: cluster and blob, or the redirect's target."""
        at = struct.unpack("<Q", self.parts.read(self.header.url_list + 8 * index, 8))[0]
        size = 512
        while True:
            data = self.parts.read(at, size)
            mime = struct.unpack_from("<H", data)[0]
            start = {REDIRECT: 12, LINK_TARGET: 8, DELETED: 8}.get(mime, 16)
            strings = data[start:].split(b"\0", 2)
            if len(strings) == 3:
                break
            if len(data) < size:
                raise ContainerError(f"entry {index} has no end")
            size *= 8
        a, b = struct.unpack_from("<II", data, 8) if start == 16 else (struct.unpack_from("<I", data, 8)[0], 0) if start == 12 else (0, 0)
        url, title = strings[0].decode(), strings[1].decode()
        return mime, chr(data[3]), url, title, a, b

    def cluster(self, index: int) -> list[bytes]:
        if index in self.kept:
            self.kept.move_to_end(index)
            return self.kept[index]
        h = self.header
        if index >= h.clusters:
            raise ContainerError(f"there is no cluster {index}")
        ends = self.parts.read(h.cluster_list + 8 * index, 16 if index + 1 < h.clusters else 8)
        start = struct.unpack_from("<Q", ends)[0]
        end = struct.unpack_from("<Q", ends, 8)[0] if len(ends) == 16 else h.checksum
        data = self.parts.read(start, (end if end > start else self.parts.size) - start)
        kind, data = data[0], data[1:]
        if kind & 0xF == LZMA:
            data = lzma.LZMADecompressor().decompress(data)
        elif kind & 0xF == ZSTD:
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif kind & 0xF not in PLAIN:
            raise ContainerError(f"cluster {index} is packed by method {kind & 0xF}")
        width, code = (8, "Q") if kind & EXTENDED else (4, "I")
        first = struct.unpack_from(f"<{code}", data)[0]
        offsets = struct.unpack_from(f"<{first // width}{code}", data)
        self.kept[index] = [data[x:y] for x, y in zip(offsets, offsets[1:], strict=False)]
        if len(self.kept) > self.clusters_kept:
            self.kept.popitem(last=False)
        return self.kept[index]

    def row(self, archive: str, index: int, with_content: bool = True) -> tuple:
        mime, space, url, title, a, b = self.entry(index)
        path = url if url.startswith(f"{space}/") else f"{space}/{url}"
        shown = title or path
        if mime == REDIRECT:
            return archive, index, space, url, path, shown, None, "redirect", a, None
        if mime in (LINK_TARGET, DELETED):
            return archive, index, space, url, path, shown, None, "none", None, None
        name = self.mimes[mime] if mime < len(self.mimes) else f"unknown/{mime}"
        return archive, index, space, url, path, shown, name, "item", None, self.cluster(a)[b] if with_content else None


@dataclass
class Range(InputPartition):
    path: str
    archive: str
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.with_content = str(options.get("content", "true")).lower() != "false"

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            n = Container(path).header.entries
            out += [Range(path, path.rpartition("/")[2], k, min(n, k + ENTRIES_A_PARTITION)) for k in range(0, n, ENTRIES_A_PARTITION)]
        return out or [Range("", "", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.path:
            container = Container(partition.path)
            for index in range(partition.start, partition.stop):
                yield container.row(partition.archive, index, self.with_content)


class ContainerSource(DataSource):
    """``spark.read.format("zim").load(path)``; several paths are joined by commas; option content=false skips blobs."""

    @classmethod
    def name(cls) -> str:
        return "zim"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)


def is_compressible(mime: str) -> bool:
    return mime.startswith("text") or mime.endswith(("+xml", "+json")) or mime in ("application/javascript", "application/json")


def pack(rows: list[tuple[str, str, str | None, str | None, bytes | None, tuple[str, str] | None]], main: tuple[str, str] | None = None) -> bytes:
    """The file of rows (namespace, url, title, mime, content, target); a row with a target redirects to it.

    Redirects whose chain never reaches content are left out. Two rows of one place are an error.
    """
    by_place = {}
    for row in rows:
        if (row[0], row[1]) in by_place:
            raise ValueError(f"two entries are {row[0]}/{row[1]}")
        by_place[row[0], row[1]] = row

    def lives(row: tuple) -> bool:
        seen = set()
        while row is not None and row[5] is not None:
            if (row[0], row[1]) in seen:
                return False
            seen.add((row[0], row[1]))
            row = by_place.get(row[5])
        return row is not None

    kept = sorted((r for r in rows if lives(r)), key=lambda r: (r[0].encode(), r[1].encode()))
    place = {(r[0], r[1]): i for i, r in enumerate(kept)}
    mimes = sorted({r[3] or "application/octet-stream" for r in kept if r[5] is None})
    clusters: list[tuple[int, list[bytes]]] = []
    open_: dict[int, int] = {}
    spots = {}
    for i, (_, _, _, mime, content, target) in enumerate(kept):
        if target is None:
            kind, blob = ZSTD if is_compressible(mime or "") else 1, content or b""
            at = open_.get(kind)
            if at is None or clusters[at][1] and sum(map(len, clusters[at][1])) + len(blob) >= CLUSTER_BYTES:
                at = open_[kind] = len(clusters)
                clusters.append((kind, []))
            clusters[at][1].append(blob)
            spots[i] = (at, len(clusters[at][1]) - 1)
    entries = []
    for i, (space, url, title, mime, _, target) in enumerate(kept):
        names = url.encode() + b"\0" + (b"" if title in (None, url) else title.encode()) + b"\0"
        if target is not None:
            entries.append(struct.pack("<HBcII", REDIRECT, 0, space.encode(), 0, place[target]) + names)
        else:
            entries.append(struct.pack("<HBcIII", mimes.index(mime or "application/octet-stream"), 0, space.encode(), 0, *spots[i]) + names)
    blobs = []
    for kind, held in clusters:
        offsets = [4 * (len(held) + 1)]
        for b in held:
            offsets.append(offsets[-1] + len(b))
        data = struct.pack(f"<{len(offsets)}I", *offsets) + b"".join(held)
        blobs.append(bytes([kind]) + (zstandard.ZstdCompressor(level=9).compress(data) if kind == ZSTD else data))
    mime_list = b"".join(m.encode() + b"\0" for m in mimes) + b"\0" if mimes else b"\0\0"
    urls_at = HEADER.size + len(mime_list)
    titles_at = urls_at + 8 * len(entries)
    at = titles_at + 4 * len(entries)
    url_list = []
    for e in entries:
        url_list.append(at)
        at += len(e)
    clusters_at = at
    at += 8 * len(blobs)
    cluster_list = []
    for b in blobs:
        cluster_list.append(at)
        at += len(b)
    by_title = sorted(range(len(kept)), key=lambda i: (kept[i][0].encode(), (kept[i][2] or kept[i][1]).encode(), kept[i][1].encode()))
    uid = uuid.uuid5(uuid.NAMESPACE_URL, hashlib.md5(b"".join(entries)).hexdigest()).bytes
    first = place.get(main, NONE_32) if main else NONE_32
    head = HEADER.pack(MAGIC, 6, 1, uid, len(entries), len(blobs), urls_at, titles_at, clusters_at, HEADER.size, first, NONE_32, at)
    body = b"".join([head, mime_list, struct.pack(f"<{len(entries)}Q", *url_list), struct.pack(f"<{len(entries)}I", *by_title), *entries, struct.pack(f"<{len(blobs)}Q", *cluster_list), *blobs])
    return body + hashlib.md5(body).digest()


def write(entries: DataFrame, uri: str) -> DataFrame:
    """Writes a file for each archive below ``uri``: entries has archive, namespace, url, title, mime_type, content,
    target_namespace and target_url. A file is made by one task, as its pointers span it; archives are spread
    over tasks. Returns (file, entries, bytes, md5)."""
    columns = ["archive", "namespace", "url", "title", "mime_type", "content", "target_namespace", "target_url"]

    def make(table: pa.Table) -> pa.Table:
        rows = [(r["namespace"], r["url"], r["title"], r["mime_type"], r["content"], (r["target_namespace"], r["target_url"]) if r["target_url"] is not None else None) for r in table.to_pylist()]
        data, name = pack(rows), table["archive"][0].as_py()
        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
        temporary = f"{folder}/_temporary.{uuid.uuid4().hex}"
        with store.open_output_stream(temporary, compression=None) as f:
            f.write(data)
        store.move(temporary, f"{folder}/{name}")
        return pa.table({"file": [name], "entries": pa.array([Header.parse(data).entries], pa.int64()), "bytes": pa.array([len(data)], pa.int64()), "md5": [data[-16:].hex()]})

    return entries.select(*[F.col(c) for c in columns]).groupBy("archive").applyInArrow(make, "file string, entries long, bytes long, md5 string")
