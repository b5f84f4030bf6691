"""Queries of the training-data operators, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from tidewater.llm import bpe, interpolation, jaccard, lengths, mixing, perplexity, substrings, urls, vectors, warc


def queries() -> dict:
    return {
        "op1_url_filter": urls.op1_url_filter,
        "op2_warc": warc.op2_warc,
        "op3_nearest": vectors.op3_nearest,
        "op4_quality": perplexity.op4_quality,
        "op5_substrings": substrings.op5_substrings,
        "op6_length_histogram": lengths.op6_length_histogram,
        "op7_bpe": bpe.op7_bpe,
        "op8_interpolation": interpolation.op8_interpolation,
        "op9_jaccard": jaccard.op9_jaccard,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return urls.ORACLE_SQL | warc.ORACLE_SQL | substrings.ORACLE_SQL | jaccard.ORACLE_SQL | mixing.ORACLE_SQL
