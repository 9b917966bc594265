"""N-gram Jaccard self-join by a count-vector R-tree: near-duplicate classes of documents.

A document is the set of its distinct shingles of ``SHINGLE`` words; two link when their Jaccard
likeness is ``PERCENT`` / 100 or more. The join is exact (up to 64-bit hashes of shingles):

1. Equal sets collapse into one, by a 128-bit digest.
2. Routing. From the likeness ``GROUPED_FROM`` / 100 on, by groups: linked sets differ in at most D
   shingles, where D follows from their sizes. At a level of sizes the shingles are hashed into D + 1 + E
   groups, so 1 + E groups are the same in both sets, and in a set with at most E empty groups one of
   them isn't empty; the content of each filled group is a signature. Sets with more empty groups also
   give the shingles of their prefix filter. Below that likeness, groups hold too few shingles to tell
   texts apart, and sets are routed by a prefix filter: in any one order of all shingles, linked sets share one among the
   first n - ceil(t n) + 1 of their n shingles. The order is by frequency, the rarest first, so a passage
   that many documents repeat ties them only if it is nearly all they have. Frequencies come
   from a sketch of ``CELLS`` counters over all shingles of the corpus; its chance hits cost vain comparisons, never a
   link, as any order is exact. Sets that share a signature may link. By groups, each is tied to
   the least one of that signature: first within a task, which passes a signature on once, then within
   a range of hashes, so a signature of very many sets costs each task a row. A shingle of a prefix says
   less, the less the fuller the sketch, so its sets are parted where the sizes leave a gap that no link
   crosses. Up to ``PAIRED`` of them give pairs, and a pair is a tie unless its parities, a bit for each
   cell that holds an odd number of a set's shingles, differ in more cells than linked sets differ in
   shingles. More of them are tied to the least one, so a group's pairs never grow with its square; of
   more than that of about one size, a task passes on ``PAIRED`` + 1. The ties' components
   bound what can link. Components of more sets than a block holds are
   tied anew, with the frequencies among their own sets, where a sketch of the same size is
   sharper, as long as that makes them smaller.
3. In a component, cut into blocks of bounded size, the sets' shingles are counted by ``GROUPS``
   hash groups, and the counts are points in an R-tree. The summed coordinate minima of two points, or
   of a point and a box's upper corner, bound the overlap; a search gets the points whose bound
   allows a link, and comparing shingles verifies them. Sets that are already connected are skipped, so
   a group of n near copies costs about n verifications, not n squared.
4. Components of more than a block: the blocks' classes are first joined by one set of each, and then
   only the sets outside the component's largest class meet all the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import common

SHINGLE, PERCENT = 3, 90
#: Coordinates of a point, and entries of a tree's node.
GROUPS, FANOUT = 64, 32
#: A block's sets and shingles, about.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 4_000_000
#: Signature levels: sizes grow by this ratio from one to the next. From this likeness on, groups hold enough shingles to route by.
RATIO, GROUPED_FROM = 1.25, 85
#: Counters of the frequency sketch, whatever the corpus, and slices that are summed apart.
CELLS, SLICES = 1 << 24, 64
#: Signatures that a task gathers before it passes them on.
SIGNATURES_HELD = 4_000_000
#: Bytes of a signature that travel, beside its range: chance hits cost a vain comparison, no more.
SIGN_BYTES = 5
#: Sets of a prefix's shingle, of sizes that may link, up to which all pairs are looked at; steps of sizes for that, which fit a byte.
PAIRED, STEP = 32, 1.05
#: Distinct words whose hashes a task keeps.
WORDS_KEPT = 400_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hash_of = _WordHash()


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, sorted. A-Z is lower-cased, words part at ASCII white space."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mix(total, k + size) + h[k : k + n]
    return np.unique(mix(total))


def need(total: int, percent: int = PERCENT) -> int:
    """The least overlap of linked sets whose sizes sum to ``total``: 100 i >= p (total - i)."""
    return -(-percent * total // (100 + percent))


def may_differ(total: int, percent: int) -> int:
    return max(s - 2 * need(s, percent) for s in (total, total - 1))


class Levels:
    """Levels of set sizes; a pair meets at the level of its larger set."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.starts, self.groups, self.spare = [1], [], []

    def _reach(self, n: int) -> None:
        while self.starts[-1] <= n:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * RATIO)))
            differ = max(0, may_differ(2 * (self.starts[-1] - 1), self.percent))
            self.groups.append(differ + 1 + self._spare(differ, self.starts[-2] * self.percent / 100) if differ else 1)
            self.spare.append(self.groups[-1] - differ - 1)

    @staticmethod
    def _spare(differ: int, least: float) -> int:
        """E: as many empty groups as the smallest sets of a level have by chance, but for one set in a thousand."""
        for e in range(differ + 2):
            empty = (differ + 1 + e) * np.exp(-least / (differ + 1 + e))
            if empty + 3 * np.sqrt(empty) <= e:
                return e
        return differ + 1

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(level, groups, E) at which a set of n shingles gives signatures: its own, and the next ones with sizes that may link."""
        self._reach(int(n * 100 / self.percent) + 2)
        own = int(np.searchsorted(self.starts, n, side="right")) - 1
        out = []
        while own < len(self.groups) and self.starts[own] * self.percent <= n * 100:
            out.append((own, self.groups[own], self.spare[own]))
            own += 1
        return out


def signatures(found: np.ndarray, levels: Levels) -> np.ndarray:
    """64-bit signatures of a set: linked sets share one, if they differ."""
    out = []
    spread, weight = mix(found, 11) >> np.uint64(8), mix(found, 12)
    for level, groups, spare in levels.of(len(found)):
        if groups == 1:
            continue  # no sets of these sizes link but equal ones
        group = spread % np.uint64(groups)
        held = np.zeros(groups, np.uint64)
        np.add.at(held, group, weight)
        filled = np.flatnonzero(np.bincount(group.astype(np.int64), minlength=groups))
        out.append(mix(held[filled] + mix(filled.astype(np.uint64), 1000 + level)))
        if groups - len(filled) > spare:
            prefix = len(found) - need_of_one(len(found), levels.percent) + 1
            out.append(mix(found[:prefix], 5000 + level))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def need_of_one(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that it links to."""
    return -(-percent * n // 100)


def prefix(found: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which sets that link share one: the rarest by the sketch, ties by hash."""
    n = len(found)
    first = n - need_of_one(n, percent) + 1
    return found[np.lexsort((found, sketch[(found % np.uint64(CELLS)).astype(np.int64)]))[:first]] if n else found


def frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """For each cell of the sketch how many sets have a shingle in it, in eighths of powers of two: CELLS bytes."""
    cells = CELLS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                np.add.at(seen, (shingles(text, size) % np.uint64(CELLS)).astype(np.int64), np.uint32(1))
        _hash_of.clear()  # the worker lives on for later stages
        press = zstandard.ZstdCompressor(level=1)
        parts = [(k, press.compress(seen[k * cells : (k + 1) * cells].tobytes())) for k in range(SLICES) if seen[k * cells : (k + 1) * cells].any()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k for k, _ in parts], pa.int32()), "counts": pa.array([c for _, c in parts], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                totals.setdefault(k, np.zeros(cells, np.uint64))
                totals[k] += np.frombuffer(unpress.decompress(data), np.uint32)
        scaled = {k: np.minimum(255, np.log2(t + 1.0) * 8).astype(np.uint8).tobytes() for k, t in totals.items()}
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(scaled), pa.int32()), "counts": pa.array(list(scaled.values()), pa.binary())})

    made = docs.select("text").mapInArrow(common.light(count), "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(common.light(add), "slice int, counts binary")
    out = np.zeros(CELLS, np.uint8)
    for row in common.table(made, "jaccard-frequencies").collect():
        out[row["slice"] * cells : (row["slice"] + 1) * cells] = np.frombuffer(row["counts"], np.uint8)
    return out


def _stars(signs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each signature once, with its least node; and ties (a, b) of its other nodes to that one, each once."""
    order = np.lexsort((nodes, signs))
    signs, nodes = signs[order], nodes[order]
    new = np.ones(len(signs), bool)
    new[1:] = signs[1:] != signs[:-1]
    heads = np.flatnonzero(new)
    least = np.repeat(nodes[heads], np.diff(np.append(heads, len(signs))))
    tied = nodes != least
    pairs = np.unique(np.column_stack([nodes[tied], least[tied]]), axis=0)
    return signs[heads], nodes[heads], pairs[:, 0], pairs[:, 1]


def _size_step(n: int) -> int:
    """Sizes by steps of STEP, the last one open: of linked sets they are at most ``_steps_apart`` apart."""
    return min(255, int(np.log(n) / np.log(STEP)))


def _steps_apart(percent: int) -> int:
    return int(np.log(100 / percent) / np.log(STEP)) + 1


def _thinned(signs: np.ndarray, steps: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a task passes on: of each signature and size step the least PAIRED + 1 nodes; and ties (a, b) of the others to the least one."""
    order = np.lexsort((nodes, steps, signs))
    signs, steps, nodes = signs[order], steps[order], nodes[order]
    new = np.ones(len(signs), bool)
    new[1:] = (signs[1:] != signs[:-1]) | (steps[1:] != steps[:-1])
    heads = np.flatnonzero(new)
    first = np.repeat(heads, np.diff(np.append(heads, len(signs))))
    kept = np.arange(len(signs)) - first <= PAIRED
    pairs = np.unique(np.column_stack([nodes[~kept], nodes[first[~kept]]]), axis=0)
    return signs[kept], steps[kept], nodes[kept], pairs[:, 0], pairs[:, 1]


def _sized(signs: np.ndarray, steps: np.ndarray, nodes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of signatures with size steps and nodes: ties (rows a, b) where many sets share one, and pairs (rows a, b) that may link where few do."""
    order = np.lexsort((nodes, steps, signs))
    signs, steps, nodes = signs[order], steps[order].astype(np.int64), nodes[order]
    apart = _steps_apart(percent)
    new = np.ones(len(signs), bool)
    new[1:] = (signs[1:] != signs[:-1]) | (steps[1:] - steps[:-1] > apart)
    heads = np.flatnonzero(new)
    held = np.diff(np.append(heads, len(signs)))
    first, held = np.repeat(heads, held), np.repeat(held, held)
    many = held > PAIRED
    least = np.minimum.reduceat(nodes, heads)[np.cumsum(new) - 1] if len(nodes) else nodes
    ties = np.unique(np.column_stack([nodes[many], least[many]]), axis=0)
    pairs, at = [np.zeros((0, 2), np.int64)], np.flatnonzero(~many & (held > 1))
    for d in range(1, PAIRED):
        at = at[at + d < first[at] + held[at]]
        if not len(at):
            break
        near = at[steps[at + d] - steps[at] <= apart]
        a, b = nodes[near], nodes[near + d]
        pairs.append(np.unique(np.column_stack([np.maximum(a, b), np.minimum(a, b)]), axis=0))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    return ties[ties[:, 0] != ties[:, 1]], pairs[pairs[:, 0] != pairs[:, 1]]


def parity(found: np.ndarray) -> bytes:
    """A bit for each of 64 or more cells, as many as the set has shingles or up to twice that: whether the cell holds an odd number of them."""
    cells = max(64, 1 << (len(found) - 1).bit_length())
    odd = np.bincount((mix(found, 13) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """Whether sets of n and m shingles with the parities x and y may link. Cells that differ hold a shingle each that one set has alone."""
    if len(x) > len(y):
        x, y = y, x
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    if len(a) < len(b):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum()) <= n + m - 2 * need(n + m, percent)


def _planes(values: np.ndarray, width: int | None = None) -> bytes:
    """The lowest bytes of numbers, all first ones, then all second ones: the widest one says how many."""
    width = width or max(1, (int(values.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(data: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return wide.reshape(-1).view("<u8")


_DESCRIBED = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("range", pa.int32()), ("low", pa.int64()), ("signs", pa.binary()), ("nodes", pa.binary()), ("steps", pa.binary()), ("parity", pa.binary()), ("tie_a", pa.int64()), ("tie_b", pa.int64())])


def _described(**columns: object) -> pa.RecordBatch:
    """Rows of which only some columns are filled."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _DESCRIBED], schema=_DESCRIBED)


class CountTree:
    """An R-tree over points of group counts, packed by set size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.points, self.sizes, self.percent = points, sizes, percent
        order = np.lexsort((*points.T[::-1], sizes))
        self.levels = []
        upper, least, most = points[order], sizes[order], sizes[order]
        self.order = order
        while len(upper) > FANOUT:
            starts = np.arange(0, len(upper), FANOUT)
            upper = np.maximum.reduceat(upper, starts)
            least, most = np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)
            self.levels.append((upper, least, most))

    def _may(self, point: np.ndarray, size: int, upper: np.ndarray, least: np.ndarray) -> np.ndarray:
        bound = np.minimum(upper, point).sum(1)
        return bound * (100 + self.percent) >= self.percent * (size + least)

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Indices of the points whose overlap with ``point`` may reach what a link needs."""
        nodes = None
        for upper, least, most in reversed(self.levels):
            nodes = np.arange(len(upper)) if nodes is None else nodes[nodes < len(upper)]
            fits = self._may(point, size, upper[nodes], least[nodes]) & (most[nodes] * 100 >= self.percent * size)
            nodes = (nodes[fits][:, None] * FANOUT + np.arange(FANOUT)).ravel()
        at = self.order if nodes is None else self.order[nodes[nodes < len(self.order)]]
        return at[self._may(point, size, self.points[at], self.sizes[at])]


def links(texts: list[bytes], labels: list[int], probes: list[bool], percent: int = PERCENT, size: int = SHINGLE) -> list[tuple[int, int]]:
    """Indices of linked texts, enough of them to connect what links: texts of one label count as connected.

    Only pairs with a probe in them are compared.
    """
    sets = [shingles(t, size) for t in texts]
    sizes = np.array([len(s) for s in sets], np.int64)
    points = np.stack([np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=GROUPS) for s in sets]).astype(np.int32) if sets else np.zeros((0, GROUPS), np.int32)
    tree = CountTree(points, sizes, percent)
    dense = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    tokens = [dense[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    marked = np.zeros(int(dense.max()) + 1 if len(dense) else 0, bool)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, probe in enumerate(probes):
        if not probe or not len(sets[i]):
            continue
        marked[tokens[i]] = True
        for j in tree.search(points[i], int(sizes[i])).tolist():
            a, b = root(labels[i]), root(labels[j])
            if a != b and int(np.count_nonzero(marked[tokens[j]])) >= need(int(sizes[i] + sizes[j]), percent):
                parent[a] = b
                out.append((i, j))
        marked[tokens[i]] = False
    return out


def _verified(rows: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) among the rows of each task: rows have task (string), node, label, probe and text."""

    def run(held: list[tuple]) -> list[tuple[int, int]]:
        found = links([r[4] for r in held], [r[2] for r in held], [r[3] for r in held], percent, size)
        return [(held[i][1], held[j][1]) for i, j in found]

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, out = None, [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

        for got in batches:
            columns = [c.cast(pa.binary()).to_pylist() if k == 4 else c.to_pylist() for k, c in enumerate(got.columns)]
            for row in zip(*columns, strict=True):
                if row[0] != task:
                    out += run(held)
                    task, held = row[0], []
                held.append(row)
        out += run(held)
        _hash_of.clear()
        yield batch()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("task", "node", "label", "probe", "text").repartition(n, "task").sortWithinPartitions("task", "node")
    return dealt.mapInArrow(common.light(by_task), "a long, b long")


def _described_sets(ids: DataFrame, percent: int, size: int, grouped: bool) -> DataFrame:
    """A table of three kinds of rows: sets (node, n and a digest; by prefix also the parity), packed signatures of a range, and ties within a task."""
    spark = ids.sparkSession
    ranges, shift, cut = _ranges(spark)
    sketch = None if grouped else spark.sparkContext.broadcast(frequencies(ids, size))  # CELLS bytes

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, levels = None if grouped else sketch.value, Levels(percent)
        signs: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        steps: list[np.ndarray] = []
        held = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            if grouped:
                sign, node, a, b = _stars(np.concatenate(signs), np.concatenate(nodes))
            else:
                sign, step, node, a, b = _thinned(np.concatenate(signs), np.concatenate(steps), np.concatenate(nodes))
            yield _described(tie_a=a, tie_b=b)
            cuts = [*np.searchsorted(sign >> shift, np.arange(0, ranges, dtype=np.uint64)).tolist(), len(sign)]
            for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if x < y:
                    low = int(node[x:y].min())
                    sized = {} if grouped else {"steps": [step[x:y].tobytes()]}
                    yield _described(range=[k], low=[low], signs=[_planes(sign[x:y] >> cut, SIGN_BYTES)], nodes=[_planes((node[x:y] - low).astype(np.uint64))], **sized)

        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                keys, n, d1, d2, odd = part.column(0).to_pylist(), [], [], [], []
                for key, text in zip(keys, part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    found = shingles(text, size)
                    n.append(len(found))
                    d1.append(mix(found, 1).sum(dtype=np.uint64).astype(np.int64))
                    d2.append(mix(found, 2).sum(dtype=np.uint64).astype(np.int64))
                    signs.append(signatures(found, levels) if grouped else mix(prefix(found, order, percent), 7))
                    nodes.append(np.full(len(signs[-1]), key, np.int64))
                    held += len(signs[-1])
                    if not grouped:
                        steps.append(np.full(len(signs[-1]), _size_step(max(1, len(found))), np.uint8))
                        odd.append(parity(found))
                yield _described(node=keys, n=n, d1=d1, d2=d2, **({} if grouped else {"parity": odd}))
                if held >= SIGNATURES_HELD:
                    yield from passed_on()
                    signs, nodes, steps, held = [], [], [], 0
        _hash_of.clear()
        if held:
            yield from passed_on()

    shape = "node long, n long, d1 long, d2 long, range int, low long, signs binary, nodes binary, steps binary, parity binary, tie_a long, tie_b long"
    made = common.table(ids.mapInArrow(common.light(describe), shape), "jaccard-sets")
    if sketch is not None:
        sketch.destroy()
    return made


def _ranges(spark: SparkSession) -> tuple[int, np.uint64, np.uint64]:
    """How many ranges of signatures there are, and the shifts that give a signature's range and what travels of it.

    A range is that of the signatures' highest bits; of the others the next SIGN_BYTES are kept.
    """
    bits = (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    return 1 << bits, np.uint64(64 - bits), np.uint64(64 - bits - 8 * SIGN_BYTES)


def _ties(made: DataFrame, copies: DataFrame, percent: int, grouped: bool) -> DataFrame:
    """Pairs (a, b) of sets, enough to connect all sets that share a signature and may link; of equal sets the least one stands for all."""

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, signs, nodes, steps = None, [], [], []
        ties = pairs = np.zeros((0, 2), np.int64)  # each once a task, however many signatures tie them

        def closed() -> tuple[np.ndarray, np.ndarray]:
            if grouped:
                _, _, a, b = _stars(np.concatenate(signs), np.concatenate(nodes))
                more = np.column_stack([a, b]), pairs
            else:
                more = _sized(np.concatenate(signs), np.concatenate(steps), np.concatenate(nodes), percent)
            return tuple(np.unique(np.concatenate(x), axis=0) for x in zip((ties, pairs), more, strict=True))

        for batch in batches:
            for k, low, x, y, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now and signs:
                    ties, pairs = closed()
                    signs, nodes, steps = [], [], []
                now = k
                signs.append(_unplaned(x, len(x) // SIGN_BYTES))
                nodes.append(_unplaned(y, len(signs[-1])).astype(np.int64) + low)
                steps.append(np.frombuffer(z or b"", np.uint8))
        if signs:
            ties, pairs = closed()
        for found, open_ in ((ties, False), (pairs, True)):
            yield pa.RecordBatch.from_pydict({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1]), "open": pa.array(np.full(len(found), open_))})

    n = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = made.where("range is not null").select("range", "low", "signs", "nodes", "steps").repartition(n, "range").sortWithinPartitions("range")
    ties = ranged.mapInArrow(common.light(tied), "a long, b long, open boolean")
    ties = ties.union(made.where("tie_a is not null").select(F.col("tie_a").alias("a"), F.col("tie_b").alias("b"), F.lit(False).alias("open"))).distinct()
    for end in ("a", "b"):
        least = common.small(copies.select(F.col("a").alias(end), F.col("b").alias("_least")))
        ties = ties.join(least, end, "left").withColumn(end, F.coalesce("_least", end)).drop("_least")
    if grouped:
        return ties.select("a", "b")
    found = common.table(ties.where("a <> b"), "jaccard-pairs")
    return found.where("not open").select("a", "b").union(_near(found.where("open").select("a", "b").distinct(), made, percent))


def _near(pairs: DataFrame, made: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and parities allow a link."""
    sets = made.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.max("parity").alias("parity"))  # rows that share a node are equal
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("parity").alias(f"parity_{end}")), end)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            yield batch.select([0, 1]).filter(pa.array([may_link(*row, percent) for row in rows], pa.bool_()))

    sizes = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sizes.select("a", "b", "n_a", "parity_a", "n_b", "parity_b").mapInArrow(common.light(kept), "a long, b long")


def _refined(may: DataFrame, ids: DataFrame, copies: DataFrame, percent: int, size: int) -> DataFrame:
    """The components ``may`` (id, component), of which large ones are tied anew among their own sets.

    Any order of shingles is exact within a component, as nothing links out of it. It ends when no component
    is larger than a block, or when the large ones keep over nine tenths of their sets.
    """
    before = None
    while True:
        large = may.groupBy("component").agg(F.count("*").alias("sets")).where(F.col("sets") > BLOCK_SETS)
        inside = common.table(may.join(common.small(large), "component").select("id"), "jaccard-large")
        held = inside.count()
        if not held or before is not None and held > 0.9 * before:
            return may
        before = held
        texts = common.table(ids.join(common.small(inside.select(F.col("id").alias("node"))), "node"), "jaccard-large-texts")
        made = _described_sets(texts, percent, size, False)
        again = common.components(_ties(made, copies, percent, False), "jaccard-again")
        rest = may.join(common.small(inside), "id", "left_anti")
        was, may = may, common.table(rest.unionByName(again), "jaccard-may-all")
        for read in (was, inside, texts, made):
            common.delete(may.sparkSession, read)


def _noded(docs: DataFrame, name: str = "node") -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a number of each document, its node, as ``name``, and of the nodes that aren't their doc_id (node, doc_id), if any are.

    A row with an id of its own has that id as its node. One whose id is null or repeated is told from others by a 64-bit hash
    of id and text, so that rows with both equal share a node.
    """
    key = F.col("doc_id").cast("long")
    odd = docs.select(key.alias("_odd")).groupBy("_odd").agg(F.count("*").alias("_rows")).where("_rows > 1 or _odd is null")
    odd = common.table(odd, "jaccard-odd-ids")
    if odd.isEmpty():
        return docs.withColumn(name, key), None
    joined = docs.join(common.small(odd), key.eqNullSafe(F.col("_odd")), "left")
    made = joined.withColumn(name, F.when(F.col("_rows").isNull(), key).otherwise(F.xxhash64(key, "text")))
    names = made.where("_rows is not null").select(F.col(name).alias("node"), F.col("_odd").alias("doc_id")).distinct()
    return made.drop("_odd", "_rows"), common.table(names, "jaccard-odd-nodes")


def _named(nodes: DataFrame, names: DataFrame | None) -> DataFrame:
    """``nodes`` (node, ...) with doc_id."""
    if names is None:
        return nodes.withColumn("doc_id", F.col("node"))
    own = common.small(names.select(F.col("node").alias("_node"), F.col("doc_id").alias("_named")))
    joined = nodes.join(own, F.col("node") == F.col("_node"), "left")
    return joined.withColumn("doc_id", F.when(F.col("_node").isNull(), F.col("node")).otherwise(F.col("_named"))).drop("_node", "_named")


def classes(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the least doc_id reachable by links.

    Null and empty texts have no shingles and link with nothing. Each row is a document of its own, whether
    its doc_id is null, repeated or neither; component_id is null only if all of a class have null ids.
    Equal sets link. Empty tables give no rows; other columns are ignored.
    """
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    noded, names = _noded(docs.select("doc_id", "text"))
    described, ends = _linked(noded.select("node", "text"), percent, size)
    ends = _named(ends, names)
    least = ends.groupBy("component").agg(F.min("doc_id").alias("least")) if names is not None else None
    if least is not None:
        ends = common.table(ends.join(common.small(least), "component").select("node", "least"), "jaccard-least")
    else:
        ends = ends.select("node", F.col("component").alias("least"))
    ends = ends.select(F.col("node").alias("id"), "least", F.lit(True).alias("linked"))
    out = _named(described.select("node", "n"), names).join(common.small(ends), F.col("node") == F.col("id"), "left")
    component = F.when(F.col("linked"), F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).repartition(n_parts)


def unique(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row of each class of ``docs``, the one with the least doc_id that isn't null; rows without shingles all stay."""
    noded, names = _noded(docs, "_node")
    described, ends = _linked(noded.select(F.col("_node").alias("node"), "text"), percent, size)
    if names is None:
        others = common.table(ends.where("component <> node").select("node"), "jaccard-others")
        return noded.join(common.small(others.toDF("_node")), "_node", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    named = _named(ends, names)
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node"))["node"].alias("first"))
    others = common.table(named.join(first, "component").where("node <> first").select("node"), "jaccard-others")
    # rows that share a node have the same id and text: one stays
    same = described.where("n > 0").groupBy("node").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("node").alias("_node"), F.lit(True).alias("_same"))
    same = common.table(same, "jaccard-same")
    left = noded.join(common.small(others.toDF("_node")), "_node", "left_anti").join(common.small(same), "_node", "left")
    columns = [f"`{c}`" for c in docs.columns]
    one = left.where("_same").groupBy("_node").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row"))
    return left.where("_same is null").select(*columns).union(one.select("_row.*"))


def _linked(ids: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Of ``ids`` (node, text): the sets (node, n, ...), a row each, and of nodes that link (node, component), the least node."""
    grouped = percent >= GROUPED_FROM
    made = _described_sets(ids, percent, size, grouped)
    described = made.where("n is not null").select("node", "n", "d1", "d2")
    full = described.where("n > 0")
    equal = full.groupBy("n", "d1", "d2").agg(F.min("node").alias("least"), F.count("*").alias("copies"))
    equal = common.table(equal.where("copies > 1").drop("copies"), "jaccard-equal")
    # ties of rows to the least row of their set; only sets of several rows are joined
    copies = full.join(common.small(equal), ["n", "d1", "d2"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    copies = common.table(copies, "jaccard-copies")
    may = common.table(common.components(_ties(made, copies, percent, grouped), "jaccard-may"), "jaccard-may-all")
    # the signatures are read; the sets go on
    described = common.table(described.select("node", "n"), "jaccard-described")
    full = described.where("n > 0")
    common.delete(made.sparkSession, made)
    may = _refined(may, ids, copies, percent, size)
    sizes = full.select("node", "n").groupBy("node").agg(F.max("n").alias("n"))
    may = common.table(may.join(sizes, may["id"] == sizes["node"]).select("node", "n", F.col("component").alias("within")), "jaccard-may-link")
    weight = may.groupBy("within").agg(F.expr(f"cast(ceil(greatest(count(*) / {BLOCK_SETS}, sum(n) / {BLOCK_SHINGLES})) as int)").alias("blocks"))
    blocked = may.join(weight, "within").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    blocked = common.table(blocked.select("node", "within", "blocks", "block"), "jaccard-blocks")
    texts = common.table(ids.join(common.small(blocked), "node"), "jaccard-texts")
    each = texts.select(F.concat_ws(":", "within", "block").alias("task"), "node", F.col("node").alias("label"), F.lit(True).alias("probe"), "text")
    edges = common.table(_verified(each, percent, size), "jaccard-links")
    if not blocked.where("blocks > 1").isEmpty():
        edges = edges.union(_across(texts.where("blocks > 1"), edges, percent, size))
    ends = common.components(edges.union(copies), "jaccard-classes").withColumnRenamed("id", "node")
    ends = common.table(ends, "jaccard-labels")
    common.delete(texts.sparkSession, texts)
    return described, ends


def _across(texts: DataFrame, edges: DataFrame, percent: int, size: int) -> DataFrame:
    """Links between the blocks of components that have several."""

    def labelled(so_far: DataFrame) -> DataFrame:
        ends = common.table(common.components(so_far, "jaccard-across"), "jaccard-across-labels")
        joined = texts.join(common.small(ends), texts["node"] == ends["id"], "left")
        return joined.withColumn("label", F.coalesce("component", "node")).drop("id", "component")

    # one set of each class of a block: its least one is the class's label
    roots = common.table(labelled(edges).where("node = label"), "jaccard-block-classes")
    cuts = roots.groupBy("within").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("cuts"))
    roots = roots.join(cuts, "within").withColumn("task", F.concat_ws(":", F.lit("r"), "within", F.pmod(F.xxhash64("node", F.lit(1)), F.col("cuts"))))
    roots = roots.withColumn("probe", F.lit(True))
    joined = common.table(_verified(roots, percent, size), "jaccard-roots")
    now = common.table(labelled(edges.union(joined)), "jaccard-now")
    by = now.groupBy("within", "label").agg(F.count("*").alias("held"))
    main = by.groupBy("within").agg(F.max_by("label", F.struct("held", "label")).alias("main"), F.count("*").alias("labels"), F.sum("held").alias("sets"), F.max("held").alias("most"))
    main = main.where("labels > 1").select("within", "main", F.ceil((F.col("sets") - F.col("most")) / BLOCK_SETS).cast("int").alias("cuts"))
    open_ = now.join(common.small(main), "within")
    rest = open_.where("label <> main").withColumn("cut", F.pmod(F.xxhash64("node", F.lit(2)), F.col("cuts")))
    probes = rest.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("probe", F.lit(True))
    base = open_.withColumn("cut", F.explode(F.expr("sequence(0, cuts - 1)"))).withColumn("probe", F.lit(False))
    shape = [F.concat_ws(":", F.lit("x"), "within", F.col("block").cast("int"), F.col("cut").cast("int")).alias("task"), "node", "label", "probe", "text"]
    last = common.table(_verified(probes.select(*shape).union(base.select(*shape)), percent, size), "jaccard-cross")
    return joined.union(last)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.read(spark, sf_dir, "documents"))


OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i : i + {SHINGLE - 1}] AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(r.b) FROM r WHERE r.a = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
