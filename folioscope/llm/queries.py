"""The queries of this package, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from folioscope.llm import decontaminate, extract, fingerprint, jaccard, language, mixing, shuffle, toxicity, warc, wavelet

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_wavelet_tokens": wavelet.op2_wavelet_tokens,
    "op3_warc": warc.op3_warc,
    "op4_shuffle": shuffle.op4_shuffle,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_mixing": mixing.op6_mixing,
    "op7_language_spans": language.op7_language_spans,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_extract": extract.op9_extract,
    "op10_fingerprint": fingerprint.op10_fingerprint,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": warc.OP3_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op8_jaccard_join": jaccard.OP8_SQL,
}
