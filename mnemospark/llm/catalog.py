"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, fingerprints, html_extract, language_id, lm_score, minhash, mixing, repeats, warc


def queries():
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_html_text": html_extract.op3_html_text,
        "op4_warc": warc.op4_warc,
        "op5_lm_score": lm_score.op5_lm_score,
        "op6_mixing": mixing.op6_mixing,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_language_id": language_id.op8_language_id,
        "op9_minhash": minhash.op9_minhash,
        "op10_repeats": repeats.op10_repeats,
    }


def oracle_sql():
    return {
        "op2_exact_dedup": exact_dedup.ORACLE,
        "op4_warc": warc.ORACLE,
    }
