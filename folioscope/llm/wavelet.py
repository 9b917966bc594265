"""Token ids as wavelet matrices: succinct bit planes with rank and select, one file a shard.

A file holds the ids of a run of documents, in ascending doc_id order, as one wavelet matrix of
``BITS`` planes. Plane by plane, from the highest bit, the ids are stably parted by the bit; the
plane keeps the bits, and the zeros' number tells where the ones begin below. Rank counts stand
at every ``BLOCK`` bits. From the file alone: ``access`` (the id at a position), ``rank`` (how often
an id occurs before a position), ``select`` (where its k-th occurrence is), ``decode`` (all ids).

File: magic, then a little-endian uint32 length of a JSON header, the header (counts, plane
sizes), the documents' ids (int64, with a null mask) and end offsets (uint32), and the planes,
each compressed by zstd with its rank counts.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm import common, files

MAGIC = b"WMTX0001"
BITS, BLOCK = 16, 512
#: A shard file is closed at this many ids; one longer document has a file of its own.
FILE_TOKENS = 1 << 21
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"


class WaveletMatrix:
    """Bit planes of uint16 values, highest bit first."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], counts: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.counts = n, zeros, planes, counts

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        a, zeros, planes, counts = values.astype(np.uint16, copy=False), [], [], []
        for bit in range(BITS - 1, -1, -1):
            ones = (a & np.uint16(1 << bit)) != 0
            packed = np.packbits(ones, bitorder="little")
            padded = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[: len(packed)] = packed
            words = np.bitwise_count(padded.view("<u8")).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            planes.append(padded)
            counts.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(words, dtype=np.uint32)]))
            low, high = np.flatnonzero(~ones), np.flatnonzero(ones)
            zeros.append(len(low))
            a = np.concatenate([a.take(low), a.take(high)])
        return cls(len(values), zeros, planes, counts)

    def _ones(self, k: int, at: int) -> int:
        """Ones of plane k before position ``at``."""
        block = at // BLOCK
        part = self.planes[k][block * BLOCK // 8 : -(-at // 8)]
        rest = int(np.bitwise_count(part).sum()) if len(part) else 0
        if at % 8 and len(part):
            rest -= (int(part[-1]) >> (at % 8)).bit_count()
        return int(self.counts[k][block]) + rest

    def access(self, at: int) -> int:
        value = 0
        for k in range(BITS):
            one = (int(self.planes[k][at >> 3]) >> (at & 7)) & 1
            value = value << 1 | one
            at = self.zeros[k] + self._ones(k, at) if one else at - self._ones(k, at)
        return value

    def _span(self, value: int, end: int) -> tuple[int, int]:
        start = 0
        for k in range(BITS):
            if value >> (BITS - 1 - k) & 1:
                start, end = (self.zeros[k] + self._ones(k, x) for x in (start, end))
            else:
                start, end = (x - self._ones(k, x) for x in (start, end))
        return start, end

    def rank(self, value: int, end: int) -> int:
        """Occurrences of ``value`` before ``end``."""
        start, stop = self._span(value, end)
        return stop - start

    def _find(self, k: int, one: int, j: int) -> int:
        """The position in plane k of the j-th (from 0) bit that equals ``one``."""
        before = self.counts[k].astype(np.int64)
        if not one:
            before = np.arange(len(before), dtype=np.int64) * BLOCK - before
        block = int(np.searchsorted(before, j, side="right")) - 1
        bits = np.unpackbits(self.planes[k][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[j - int(before[block])])

    def select(self, value: int, j: int) -> int:
        """The position of the j-th (from 0) occurrence of ``value``; -1 if there are fewer."""
        start, stop = self._span(value, self.n)
        if not 0 <= j < stop - start:
            return -1
        at = start + j
        for k in range(BITS - 1, -1, -1):
            one = value >> (BITS - 1 - k) & 1
            at = self._find(k, one, at - self.zeros[k] if one else at)
        return at

    def decode(self) -> np.ndarray:
        """All values in order: the partings are undone from the lowest plane up."""
        a = np.zeros(self.n, np.uint16)
        for k in range(BITS - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(a)
            up[np.flatnonzero(~ones)] = a[: self.zeros[k]]
            up[np.flatnonzero(ones)] = a[self.zeros[k] :] | np.uint16(1 << (BITS - 1 - k))
            a = up
        return a


def pack(ids: list[int | None], ends: np.ndarray, values: np.ndarray) -> bytes:
    m, press = WaveletMatrix.build(values), zstandard.ZstdCompressor(level=1)
    parts = [press.compress(p.tobytes() + c.tobytes()) for p, c in zip(m.planes, m.counts, strict=True)]
    header = {"n": m.n, "documents": len(ids), "zeros": m.zeros, "planes": [len(p) for p in parts], "nulls": [i for i, x in enumerate(ids) if x is None]}
    head = json.dumps(header).encode()
    keys = np.array([x or 0 for x in ids], "<i8").tobytes()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, keys, ends.astype("<u4").tobytes(), *parts])


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    at = 12 + int.from_bytes(data[8:12], "little")
    header = json.loads(data[12:at])
    n, rows = header["n"], header["documents"]
    ids: list[int | None] = np.frombuffer(data, "<i8", rows, at).tolist()
    for i in header["nulls"]:
        ids[i] = None
    ends = np.frombuffer(data, "<u4", rows, at + 8 * rows)
    at += 12 * rows
    width = -(-(-(-n // 8)) // (BLOCK // 8)) * (BLOCK // 8)
    planes, counts, press = [], [], zstandard.ZstdDecompressor()
    for size in header["planes"]:
        raw = press.decompress(data[at : at + size])
        planes.append(np.frombuffer(raw, np.uint8, width))
        counts.append(np.frombuffer(raw, "<u4", offset=width))
        at += size
    return ids, ends, WaveletMatrix(n, header["zeros"], planes, counts)


def _packed(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """The tokenizer's ids of whole texts, as little-endian uint16 bytes.

    The vocabulary's splitting pattern never joins what a space begins with what stands before
    it, so a text's ids are those of its space-led pieces in a row, and pieces repeat. The ids of
    ``memory`` pieces are kept, and those of two runs of ``RUN``, in two ages: when half as many are new, the older
    ones go, but for those that came up again since. Texts that hold one of the vocabulary's added tokens, white space
    beside a space, or white space beyond space and line feed go through the tokenizer whole.
    """

    RUN = 4096

    def __init__(self, path: str, memory: int = 500_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.memory = memory
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(sorted(added, key=len, reverse=True)) or r"(?!)")
        self.odd = re.compile(r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")
        self.inner, self.first = _Pieces(self, " "), _Pieces(self, "")

    def direct(self, text: str) -> bytes:
        return _packed(self.whole.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or "\n " in text or " \n" in text or self.odd.search(text) or self.added.search(text) or text[0] == " " or text[-1] == " ":
            return self.direct(text)
        pieces = text.split(" ")
        self.forget()
        coded = [self.first[pieces[0]]]
        for at in range(1, len(pieces), self.RUN):
            self.forget()
            coded.append(b"".join(map(self.inner.__getitem__, pieces[at : at + self.RUN])))
        return b"".join(coded)

    def forget(self) -> None:
        """Where half of ``memory`` is taken by new pieces, they become the older ones."""
        if len(self.inner) + len(self.first) > self.memory // 2:
            self.inner, self.first = self.inner.aged(), self.first.aged()


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Pieces(dict):
    LETTERS = {i: x for i, x in enumerate(_byte_letters())}
    #: Ids as little-endian bytes.
    CODES = [i.to_bytes(2, "little") for i in range(1 << 16)]

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead
        self.model = encoder.whole.model.tokenize
        self.spelled_lead = lead.translate(self.LETTERS)
        self.older: dict[str, bytes] = {}

    def aged(self) -> _Pieces:
        """Pieces without any of their own yet, and these as the older ones."""
        new = _Pieces(self.encoder, self.lead)
        new.older, self.older = self, {}
        return new

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is not None:
            self[piece] = ids
            return ids
        before, feed, after = piece.partition("\n")
        if feed and before and after and after[0] != "\n":
            return self[before] + self.encoder.first["\n"] + self.encoder.first[after]
        if piece.isalpha():  # one unit of the splitting pattern, so the merges alone are left
            # ASCII letters are written as themselves
            spelled = self.spelled_lead + (piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.LETTERS))
            ids = b"".join([self.CODES[t.id] for t in self.model(spelled)])
        elif len(piece) > 1 and piece[-1] in ".," and piece[-2].isalpha():
            ids = self[piece[:-1]] + self.encoder.first[piece[-1]]
        else:
            ids = self.encoder.direct(self.lead + piece)
        self[piece] = ids
        return ids


def encoder(path: str) -> Encoder:
    """One a process, for all its tasks."""
    encoders = common.kept("wavelet")
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def write(docs: DataFrame, vocabulary: str, uri: str, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes the shard files to ``uri``; returns their manifest.

    Rows are dealt by ranges of doc_id and sorted, nulls first, ties by a hash of the text, so files follow
    doc_id order; a range is encoded as a stream, and a file is closed at ``file_tokens``. Null text
    counts as empty: its document holds the end id alone. No rows: no files, an empty manifest.
    Manifest: file, shard int, part int, documents long, tokens long.
    """
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]  # a sample of it goes to the driver, so texts are no part of it
    ordered = ordered.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).drop("tie")
    end = np.array([end_id], "<u2").tobytes()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, part = TaskContext.get().partitionId(), 0
        code = encoder(vocabulary).encode
        ids: list[int | None] = []
        ends: list[int] = []
        held: list[bytes] = []
        total = 0

        def close() -> pa.RecordBatch:
            nonlocal part, total
            name = f"shard-{number:06d}-{part:06d}.wm"
            files.put(uri, name, pack(ids, np.array(ends, np.uint32), np.frombuffer(b"".join(held), "<u2")))
            row = pa.RecordBatch.from_pydict({"file": [name], "shard": pa.array([number], pa.int32()), "part": pa.array([part], pa.int32()), "documents": [len(ids)], "tokens": [total]})
            part, total = part + 1, 0
            for x in (ids, ends, held):
                x.clear()
            return row

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # one text at a time leaves Arrow's memory
                coded = code(text.as_py()) + end
                if ids and total + len(coded) // 2 > file_tokens:
                    yield close()
                total += len(coded) // 2
                ids.append(key)
                ends.append(total)
                held.append(coded)
        if ids:
            yield close()

    manifest = ordered.mapInArrow(common.light(shard, "wavelet"), "file string, shard int, part int, documents long, tokens long")
    return common.table(manifest, "wavelet-manifest")


def documents(manifest: DataFrame, uri: str) -> DataFrame:
    """Reads the shard files of a manifest back, a file a task at a time.

    Returns doc_id, start, n_tokens, ids_crc32 and ids, the ids themselves as little-endian uint16.
    """
    by_shard = manifest.groupBy("shard").agg(F.sum("tokens").alias("held"))
    before = by_shard.select("shard", (F.sum("held").over(Window.orderBy("shard")) - F.col("held")).alias("base"))
    within = F.sum("tokens").over(Window.partitionBy("shard").orderBy("part")) - F.col("tokens")
    placed = manifest.select("*", within.alias("inside")).join(before, "shard").select("file", (F.col("base") + F.col("inside")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, ends, matrix = unpack(files.get(uri, name))
                values, bounds = matrix.decode(), [0, *ends.tolist()]
                wide = values.astype("<u4")
                for at in range(0, len(ids), 1024):
                    keys, cuts = ids[at : at + 1024], bounds[at : at + 1025]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(keys, pa.int64()),
                            "start": pa.array([start + a for a in cuts[:-1]], pa.int64()),
                            "n_tokens": pa.array([b - a for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(wide[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                            "ids": pa.array([values[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                        }
                    )

    dealt = placed.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return dealt.mapInArrow(common.light(read, "wavelet"), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes ``docs`` as wavelet matrix shards in the shared folder and reads them back: see ``documents``."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    spark: SparkSession = docs.sparkSession
    uri = common.scratch(spark, "wavelet")
    return documents(write(docs, vocabulary, uri), uri)


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(common.read(spark, sf_dir, "documents")).drop("ids")
