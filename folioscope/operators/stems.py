"""Postings by stems: words are counted and stemmed where their document is read, so no row of them is exchanged."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.functions import stem
from folioscope.operators import postings as px

#: Stems that a worker remembers before it begins anew.
REMEMBERED = 200_000
_stems: dict[tuple[str | None, str], str] = {}


def remembered(lang: str | None, word: str) -> str:
    found = _stems.get((lang, word))
    if found is None:
        if len(_stems) >= REMEMBERED:
            _stems.clear()
        found = _stems[lang, word] = stem.stem(lang, word)
    return found


def recount(rows: np.ndarray, codes: np.ndarray, wdf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (row, code) added up; codes are below ``n``."""
    keys, inverse = np.unique(rows * n + codes, return_inverse=True)
    return *np.divmod(keys, n), np.bincount(inverse, wdf, len(keys)).astype(np.int64)


def _rows(only: Sequence[str] | None) -> Callable:
    wanted = None if only is None else frozenset(only)
    first = tuple(sorted(set("".join(map(stem.first_letters, only or ())))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in px.steps(batches, "w"):
            rows, codes, wdf, words = px.count(step["w"])
            if wanted is not None and "" not in wanted:  # other words have none of these stems
                may = np.array([w.startswith(first) for w in words.to_pylist()], bool)[codes]
                rows, codes, wdf = rows[may], codes[may], wdf[may]
            archives = step["archive"].dictionary_encode(null_encoding="encode")
            pairs, which = np.unique(archives.indices.to_numpy()[rows].astype(np.int64) * max(len(words), 1) + codes, return_inverse=True)
            names = archives.dictionary.to_pylist()
            of, word = np.divmod(pairs, max(len(words), 1))
            forms = words.take(pa.array(word)).to_pylist()
            roots = pa.array([remembered(names[k], w) for k, w in zip(of.tolist(), forms, strict=True)], pa.string()).dictionary_encode()
            codes = roots.indices.to_numpy()[which]
            if wanted is not None:
                kept = np.array([r in wanted for r in roots.dictionary.to_pylist()], bool)[codes]
                rows, codes, wdf = rows[kept], codes[kept], wdf[kept]
            rows, codes, wdf = recount(rows, codes, wdf, max(len(roots.dictionary), 1))
            archive, doc = (step[k].take(pa.array(rows)) for k in px.KEYS)
            yield pa.RecordBatch.from_arrays([archive, roots.dictionary.take(pa.array(codes)), doc, pa.array(wdf)], ["archive", "term", "doc_id", "wdf"])

    return run


def postings(docs: DataFrame, text: str = "text", only: Sequence[str] | None = None) -> DataFrame:
    """archive, term, doc_id, wdf by the stems of each archive's language; with ``only`` those of these stems."""
    return px.by_word(docs, _rows(only), text)
