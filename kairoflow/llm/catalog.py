"""The registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from kairoflow.llm import bpe, decontamination, exact_dedup, quality, simhash, suffix_array, token_files, toxicity, url_filter, warc

QUERIES = {
    "op1_suffix_dedup": suffix_array.op1_suffix_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_simhash": simhash.op6_simhash,
    "op7_token_files": token_files.op7_token_files,
    "op8_warc": warc.op8_warc,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_quality": quality.op10_quality,
}
ORACLES = url_filter.ORACLE | warc.ORACLE | exact_dedup.ORACLE
