"""Language of texts and of their parts: script ranges, word scores, and Viterbi with a switching penalty.

A model is learned from labelled texts: which scripts a language uses, and how often it uses each
character n-gram. The script of a word narrows its candidates to the languages that use it; its n-grams
give each candidate a log probability. Viterbi over a text's words finds the labelling with the best sum
of word scores less ``PENALTY`` for each change, so stretches of mixed-language texts get labels of their
own. Training is one task of the cluster; the driver gets the finished model alone.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm import common
from folioscope.llm.words import WordTable, grams

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: The model learns from at most so many texts, as many of each language as there are, in the order of a hash of their
#: id and text, and from no further ones once they hold so many characters. Each is taken whole.
TRAIN_DOCS, TRAIN_TEXT = 4000, 32_000_000
#: Cost of a change of language between two words, the least score of a candidate, and that of a language which
#: doesn't use the word's script, in nats.
PENALTY, FLOOR, EXCLUDED = 6.0, -4.0, -1e4
#: Words of texts that are labelled at once, about; one longer text is labelled alone.
CHUNK_WORDS = 500_000
#: A language uses a script if it has at least this share of the language's letters.
SCRIPT_SHARE = 0.002
#: First code points of ranges of scripts, ascending; a range ends where the next begins.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "other"), (0x20000, "han"),
]
_WORD = re.compile(r"[^\W\d_]+")
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def words(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L), in lower case."""
    found = _WORD.findall(text.lower()) if text else []
    if not found or "".join(found).isalpha():
        return found
    # numbers such as ½ or Ⅷ count as letters in patterns
    return [part for w in found for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def scripts(found: list[str]) -> np.ndarray:
    """The script number of each word: that of its last letter, where inflections show."""
    last = np.array([ord(w[-1]) for w in found], np.int64)
    return _SCRIPT[np.searchsorted(_STARTS, last, side="right") - 1]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages: log probabilities of n-grams
    allowed: np.ndarray  # scripts x languages

    def scores(self, found: list[str]) -> np.ndarray:
        """Log of each candidate's share in the words' probability, FLOOR or more; EXCLUDED for languages that don't use the script."""
        h, owner = grams(found, ORDERS)
        bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
        total = np.column_stack([np.bincount(owner, self.weights[bucket, k], len(found)) for k in range(len(self.languages))])
        candidate = self.allowed[scripts(found)]
        total = np.where(candidate, total, -1e9)
        total -= total.max(1, keepdims=True)
        total -= np.log(np.exp(total).sum(1, keepdims=True))
        return np.where(candidate, np.maximum(total, FLOOR), EXCLUDED).astype(np.float32)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, languages=np.array(self.languages, "U"), weights=self.weights, allowed=self.allowed)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as z:
            return cls(z["languages"].tolist(), z["weights"], z["allowed"])


def learn(rows: list[tuple[str, str]]) -> Model:
    """A model from (text, language) rows; languages of no letters are left out."""
    counts: dict[str, Counter] = {}
    for text, lang in rows:
        counts.setdefault(lang, Counter()).update(words(text))
    languages = sorted(x for x, c in counts.items() if c)
    held = np.full((BUCKETS, len(languages)), 0.5)
    used = np.zeros((len(_NAMES), len(languages)))
    for k, lang in enumerate(languages):
        found, times = list(counts[lang]), np.array(list(counts[lang].values()), np.float64)
        h, owner = grams(found, ORDERS)
        # a word that a text repeats says less each time
        held[:, k] += np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), np.sqrt(times)[owner], BUCKETS)
        used[:, k] = np.bincount(scripts(found), times, len(_NAMES))
    weights = np.log(held / held.sum(0)) if languages else held
    allowed = used >= SCRIPT_SHARE * np.maximum(1, used.sum(0))
    allowed[~allowed.any(1)] = True  # a script that no language uses narrows nothing
    return Model(languages, weights.astype(np.float32), allowed)


def viterbi(scores: np.ndarray, lengths: list[int], penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word. ``scores``: the words of all texts in a row; all texts advance together."""
    n = np.array(lengths, np.int64)
    labels = np.zeros(len(scores), np.int32)
    order = np.argsort(-n, kind="stable")
    starts = (np.cumsum(n) - n)[order]
    n = n[order]
    active = np.searchsorted(-n, -np.arange(1, (int(n[0]) if len(n) else 0) + 1), side="right")
    best, came = None, []
    for t, k in enumerate(active.tolist()):
        emitted = scores[starts[:k] + t]
        if t == 0:
            best = emitted.copy()
            continue
        before = best[:k]
        top = before.argmax(1)
        jump = before[np.arange(k), top] - penalty
        stays = before >= jump[:, None]
        came.append((stays, top.astype(np.int32)))
        best[:k] = np.where(stays, before, jump[:, None]) + emitted
    state = best.argmax(1) if best is not None else np.zeros(0, np.int64)
    for t in range(len(active) - 1, -1, -1):
        k = int(active[t])
        labels[starts[:k] + t] = state[:k]
        if t:
            stays, top = came[t - 1]
            at = state[:k]
            state[:k] = np.where(stays[np.arange(k), at], at, top)
    return labels


def train(docs: DataFrame) -> Model:
    """Learns from a bounded sample of ``docs`` (doc_id, text, lang) outside the held-out fold."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.crc_fold() != 0))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("h"), F.col("lang").cast("string").alias("lang"), "text")
    counts = common.table(rows.groupBy("lang").agg(F.count("*").alias("n")), "language-counts", 1)
    languages = counts.count()
    if not languages:
        return learn([])
    quota = max(1, TRAIN_DOCS // languages)
    # by their hashes some three times the quota of a language come near; of those the quota is taken exactly
    near = F.pmod("h", F.lit(1 << 32)) < F.lit(3.0 * quota * (1 << 32)) / F.col("n")
    drawn = rows.join(common.small(counts, 100_000), "lang").where(near).groupBy("lang", "h").agg(F.min("text").alias("text"))
    taken = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= quota)
    taken = taken.select("h", "text", "lang").repartition(1).sortWithinPartitions("h", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, held = [], 0
        for batch in batches:
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held < TRAIN_TEXT:
                    sample.append((text, lang))
                    held += len(text)
        yield pa.RecordBatch.from_pydict({"model": pa.array([learn(sample).dump()], pa.binary())})

    found = taken.mapInArrow(common.light(run), "model binary").collect()
    return Model.load(bytes(found[0]["model"])) if found else learn([])


def label(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text's lang_pred, score and spans for each row of ``docs`` (doc_id, text).

    spans: array of (first_word, n_words, lang), whole texts. lang_pred: the language of the most letters
    in the spans, ``und`` without letters (null and empty texts; any text if nothing was learned); ties: the
    first by name. score: the mean share of lang_pred in the probability of the words of its spans, times
    those spans' share of letters. Rows are kept as they are, repeated ones too.
    """
    span = "array<struct<first_word: long, n_words: long, lang: string>>"
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages numbers, whatever the corpus
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = _table(m)
        for batch in batches:
            for ids, texts in _chunks(batch):
                found = _label(texts if m.languages else [[] for _ in texts], m, table)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.float64(), kind), strict=True))], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.light(run), f"doc_id long, lang_pred string, score double, spans {span}")


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[list[str]]]]:
    """Runs of a batch's rows (doc_id, text): their ids, and the words of their texts, about CHUNK_WORDS at most."""
    start, held, total = 0, [], 0
    for row in range(len(batch)):
        own = words(batch.column(1)[row].as_py())
        if held and total + len(own) > CHUNK_WORDS:
            yield batch.column(0).slice(start, row - start), held
            start, held, total = row, [], 0
        held.append(own)
        total += len(own)
    if held:
        yield batch.column(0).slice(start), held


def _label(texts: list[list[str]], model: Model, table: WordTable) -> list[tuple[str, float, list[dict]]]:
    """lang_pred, score and spans of texts given as words."""
    rows, languages = table.look_up(texts), model.languages
    lengths = [len(r) for r in rows]
    flat = np.concatenate(rows)
    known = table.table[flat] if len(flat) else np.zeros((0, len(languages) + 1), np.float32)
    scores, letters = known[:, :-1], known[:, -1]
    labels = viterbi(scores, lengths)
    out, end = [], 0
    for size in lengths:
        at, end = end, end + size
        own = labels[at:end]
        if not size:
            out.append(("und", 0.0, []))
            continue
        weight = np.bincount(own, letters[at:end], len(languages))
        best = int(weight.argmax())
        share = np.exp(scores[at:end, best][own == best], dtype=np.float64).mean() * weight[best] / weight.sum()
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        spans = [{"first_word": int(h), "n_words": int(n), "lang": languages[own[h]]} for h, n in zip(heads, np.diff(np.append(heads, size)), strict=True)]
        out.append((languages[best], float(min(1.0, max(0.0, share))), spans))
    return out


def _table(model: Model) -> WordTable:
    def features(found: list[str]) -> np.ndarray:
        return np.column_stack([model.scores(found), [len(w) for w in found]])

    return WordTable(features)


def op7_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    found = label(docs, train(docs))
    return found.select("doc_id", (common.crc_fold() == 0).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
