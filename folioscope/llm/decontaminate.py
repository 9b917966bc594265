"""Benchmark decontamination by suffix arrays over the training documents.

A task gathers whole documents into a shard of up to ``SHARD_WORDS`` words and sorts all its word
positions by the words that follow: the shard's suffix array. Every suffix of every benchmark item
is binary-searched in it, all at once, for the stretch of positions that begin with its first
``WINDOW`` words. The positions tell which document words a benchmark item covers; positions that follow
each other in both texts merge into verbatim matches, of which each item's longest in a document is kept.

Words: A-Z is lower-cased; a word is a run of letters a-z, digits and characters from U+0080 on. An
item of fewer words than a window, but not none, is one window itself.
"""

from __future__ import annotations

import io
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm import common, files

WINDOW = 8
SHARD_WORDS = 1 << 21
#: Benchmark text that tasks hold at a time, and pairs of places in texts and items that are joined at a time, about.
BLOCK_BYTES, PAIRS = 8 << 20, 1 << 21
#: Word numbers of a shard below this many bits pack three to a sort key, others two; 0 parts documents.
WORD_BITS = 21
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class SuffixArray:
    """Positions of ``ids`` in the order of the words that follow, told apart to ``depth`` words."""

    def __init__(self, ids: np.ndarray, depth: int):
        n = len(ids)
        self.ids = ids
        wide = np.concatenate([ids.astype(np.uint64), np.zeros(2, np.uint64)])
        if n == 0 or int(ids.max()) < 1 << WORD_BITS:
            known = 3
            key = wide[:n] << np.uint64(2 * WORD_BITS) | wide[1 : n + 1] << np.uint64(WORD_BITS) | wide[2 : n + 2]
        else:
            known = 2
            key = wide[:n] << np.uint64(32) | wide[1 : n + 1]
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
        rank = np.zeros(n + 1, np.int64)
        self._number(rank, np.arange(n), first)
        while known < depth:
            same = ~first
            same[:-1] |= ~first[1:]
            slots = np.flatnonzero(same)
            if not len(slots):
                break
            at = self.order[slots]
            pair = rank[at] << 32 | rank[np.minimum(at + known, n)]
            by = np.argsort(pair, kind="stable")
            self.order[slots] = at[by]
            pair = pair[by]
            first[slots] = np.concatenate([[True], pair[1:] != pair[:-1]])
            self._number(rank, slots, first)
            known *= 2

    def _number(self, rank: np.ndarray, slots: np.ndarray, first: np.ndarray) -> None:
        """rank[position] = 1 + the first slot of the equal ones; the end of the text ranks 0."""
        if len(slots):
            starts = np.maximum.accumulate(np.where(first[slots], slots, 0))
            rank[self.order[slots]] = starts + 1

    def stretch(self, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``queries``, the slots [low, high) of suffixes that begin with its first ``lengths`` words."""
        width = queries.shape[1]
        text = np.concatenate([self.ids, np.zeros(width, self.ids.dtype)])
        used = np.arange(width)[None, :] < lengths[:, None]

        def bound(past: bool) -> np.ndarray:
            low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.order), np.int64)
            while (open_ := low < high).any():
                q = np.flatnonzero(open_)
                mid = (low[q] + high[q]) >> 1
                seen = text[self.order[mid][:, None] + np.arange(width)]
                unlike = (seen != queries[q]) & used[q]
                at = unlike.argmax(1)
                differs = unlike[np.arange(len(q)), at]
                less = differs & (seen[np.arange(len(q)), at] < queries[q, at])
                right = less | (past & ~differs)
                low[q[right]] = mid[right] + 1
                high[q[~right]] = mid[~right]
            return low

        return bound(False), bound(True)


def benchmark_blocks(benchmark: DataFrame, uri: str) -> list[str]:
    """Tasks write the items' windows in blocks of bounded size to the shared folder; returns the files' names."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, part = TaskContext.get().partitionId(), 0
        held: list[tuple[str, list[bytes]]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal part, size
            name = f"benchmark-{number:06d}-{part:06d}.npz"
            files.put(uri, name, Block.of(held).dump())
            held.clear()
            part, size = part + 1, 0
            return pa.RecordBatch.from_pydict({"file": [name]})

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if size > BLOCK_BYTES:
                    yield close()
                found = words(text)
                if found:
                    held.append((item, found))
                    size += len(text)
        if held:
            yield close()

    dealt = items.repartition(1 + size // BLOCK_BYTES, F.xxhash64("item_id", "text")).sortWithinPartitions("item_id", "text")
    return sorted(r["file"] for r in dealt.mapInArrow(common.light(run), "file string").collect())  # a name for 8 MB of items


class Block:
    """The distinct windows of a block of items, as rows of word numbers, and where they stand in items."""

    def __init__(self, items: np.ndarray, vocabulary: bytes, windows: np.ndarray, starts: np.ndarray, item: np.ndarray, at: np.ndarray):
        self.items, self.vocabulary, self.windows = items, vocabulary, windows  # -1 fills rows of short items
        self.starts, self.item, self.at = starts, item, at  # places of window k: starts[k] to starts[k + 1]
        self.lengths = (windows >= 0).sum(1)

    @classmethod
    def of(cls, held: list[tuple[str, list[bytes]]]) -> Block:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        windows, item, at = [], [], []
        for i, (_, found) in enumerate(held):
            ids = np.fromiter(map(number.__getitem__, found), np.int32, len(found))
            if len(ids) < WINDOW:
                ids = np.concatenate([ids, np.full(WINDOW - len(ids), -1, np.int32)])
            own = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
            windows.append(own)
            item.append(np.full(len(own), i))
            at.append(np.arange(len(own)))
        rows, which = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        starts = np.searchsorted(which[order], np.arange(len(rows) + 1))
        return cls(np.array([i for i, _ in held], "U"), b"\n".join(number), rows, starts, np.concatenate(item)[order], np.concatenate(at)[order])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, items=self.items, vocabulary=np.frombuffer(self.vocabulary, np.uint8), windows=self.windows, starts=self.starts, item=self.item.astype(np.int32), at=self.at.astype(np.int32))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Block:
        with np.load(io.BytesIO(data)) as z:
            return cls(z["items"], z["vocabulary"].tobytes(), *(z[k] for k in ("windows", "starts", "item", "at")))

    def queries(self, vocabulary: dict[bytes, int]) -> np.ndarray:
        """The windows in another vocabulary's numbers; words that it hasn't are the largest number."""
        none = np.uint32(2**32 - 1)
        own = np.fromiter((vocabulary.get(w, none) for w in self.vocabulary.split(b"\n")), np.uint32)
        return np.append(own, none)[self.windows]


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the ranges, and all numbers of the ranges [low, high), in a row."""
    n = high - low
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def search(texts: list[bytes | None], blocks: Callable[[], Iterator[Block]]) -> list[tuple[int, int, list[str], list[tuple[str, int, int, int]]]]:
    """For each text: words, words covered, items that occur, longest verbatim matches (item, word in text, word in item, words)."""
    vocabulary: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    parts, sizes = [], []
    for text in texts:
        found = words(text)
        parts.append(np.fromiter(map(vocabulary.__getitem__, found), np.uint32, len(found)))
        parts.append(np.zeros(1, np.uint32))
        sizes.append(len(found))
    starts = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    del parts
    vocabulary.default_factory = None
    array, cover = None, np.zeros(len(ids) + 1, np.int32)
    items: list[list[str]] = [[] for _ in texts]
    matches: list[list[tuple[str, int, int, int]]] = [[] for _ in texts]
    for block in blocks():
        depth = int(block.lengths.max())
        if array is None or array.depth < depth:
            array = SuffixArray(ids, depth)
            array.depth = depth
        low, high = array.stretch(block.queries(vocabulary), block.lengths)
        window, slots = _spread(low, high)
        if not len(window):
            continue
        place = array.order[slots]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + block.lengths[window], -1)
        for d, i, p, j, n in _longest(block, window, place, starts):
            items[d].append(str(block.items[i]))
            matches[d].append((str(block.items[i]), p, j, n))
    covered = np.cumsum(cover[:-1]) > 0
    before = np.concatenate([[0], np.cumsum(covered)])
    n_hit = before[starts[1:]] - before[starts[:-1]]
    return [(sizes[d], int(n_hit[d]), sorted(set(items[d])), sorted(matches[d])) for d in range(len(texts))]


def _longest(block: Block, window: np.ndarray, place: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """Document, item, word in both and length of each item's longest match in a document, the first of those alike.

    Windows at places of the texts meet their places in items for some texts at a time, so that no more than about
    PAIRS are held, one text's at least.
    """
    doc = np.searchsorted(starts, place, side="right") - 1
    order = np.argsort(place, kind="stable")
    window, place, doc = window[order], place[order], doc[order]
    ends = np.cumsum(block.starts[window + 1] - block.starts[window])
    at = 0
    while at < len(place):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right"))
        if stop < len(doc):  # texts stay whole
            stop = int(np.searchsorted(doc, doc[stop]))
            if stop <= at:
                stop = int(np.searchsorted(doc, doc[at], side="right"))
        part = slice(at, stop)
        at = stop
        hit, where = _spread(block.starts[window[part]], block.starts[window[part] + 1])
        p, d, n, i, j = place[part][hit], doc[part][hit], block.lengths[window[part]][hit], block.item[where], block.at[where]
        by = np.lexsort((p, p - j, i, d))  # along the diagonals of each text and item
        p, d, n, i, j = p[by], d[by], n[by], i[by], j[by]
        new = np.ones(len(p), bool)
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (p[1:] != p[:-1] + 1) | (j[1:] != j[:-1] + 1)
        head = np.flatnonzero(new)
        run = np.diff(np.append(head, len(p))) + n[head] - 1
        best = np.lexsort((j[head], p[head], -run, i[head], d[head]))
        pair = np.stack([d[head][best], i[head][best]])
        first = best[np.concatenate([[True], (pair[:, 1:] != pair[:, :-1]).any(0)])]
        at_head = head[first]
        yield from zip(d[at_head].tolist(), i[at_head].tolist(), (p[at_head] - starts[d[at_head]]).tolist(), j[at_head].tolist(), run[first].tolist(), strict=True)


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_hit, items (array<string>, sorted) and matches (array of item_id, doc_word, item_word, n_words:
    of each row of the benchmark that occurs, its longest verbatim match).

    Every row is kept, also ones that equal each other; null and empty texts have no words and no items. Null
    items or items without words match nothing; an empty benchmark matches nothing. Columns of those
    names are replaced. Needs no shuffle: a row's result follows from it and the benchmark alone.
    """
    spark = docs.sparkSession
    uri = common.scratch(spark, "benchmark")
    names = benchmark_blocks(benchmark, uri)
    added = ("n_words", "n_hit", "items", "matches")
    kept = [c for c in docs.columns if c not in added]
    extra = "n_words long, n_hit long, items array<string>, matches array<struct<item_id: string, doc_word: long, item_word: long, n_words: long>>"
    out = docs.select(*[f"`{c}`" for c in kept])
    schema = T.StructType([*out.schema.fields, *T.StructType.fromDDL(extra).fields])
    place = kept.index("text")

    def search_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = [Block.load(files.get(uri, names[0]))] if len(names) == 1 else None

        def blocks() -> Iterator[Block]:
            yield from one if one is not None else (Block.load(files.get(uri, name)) for name in names)

        kind = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))
        for batch in shards(batches, place):
            found = search(batch.column(place).cast(pa.binary()).to_pylist(), blocks)
            columns = [
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.int64()),
                pa.array([f[2] for f in found], pa.list_(pa.string())),
                pa.array([[dict(zip(("item_id", "doc_word", "item_word", "n_words"), m, strict=True)) for m in f[3]] for f in found], kind),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, *added])

    return out.mapInArrow(common.light(search_all), schema)


def shards(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """Joins and cuts batches so that each has text of at most about SHARD_WORDS words, one row at least."""
    most = SHARD_WORDS * 5
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for row, n in enumerate(lengths.tolist()):
            if size and size + n > most:
                held.append(batch.slice(start, row - start))
                yield _joined(held)
                held, size, start = [], 0, row
            size += n
        held.append(batch.slice(start))
    if size or any(len(b) for b in held):
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    return table.to_batches()[0] if len(table) else held[0]


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.read(spark, sf_dir, "documents").select("doc_id", "text"), common.read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, coalesce({_SQL_WORDS}, []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[i : i + least({WINDOW}, len(w)) - 1] AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(g) AS n FROM bw),
dw AS (SELECT doc_id, i, n, w[i : i + n - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
