"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from lodestone.llm import decontam, katz, mixing, neardup, oracles, quality, sentences, sharding, suffixes, toxicity, warc


def queries() -> dict:
    return {
        "op1_sampled_splitter_shards": sharding.op1_query,
        "op2_sentence_spans": sentences.op2_query,
        "op3_warc_salvage": warc.op3_query,
        "op4_template_decontamination": decontam.op4_query,
        "op5_suffix_sort": suffixes.op5_query,
        "op6_tensored_minhash": neardup.op6_query,
        "op7_mix_sources": mixing.op7_query,
        "op8_ftrl_toxicity": toxicity.op8_query,
        "op9_katz_backoff": katz.op9_query,
        "op10_line_frequency": quality.op10_query,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
