"""Registered corpus queries and their SQL."""

from __future__ import annotations

from ledgerline.llm import (chat, cube_mix, decontaminate, filter_audit, minmax_hash, prefix_parse, quality, secret_scan, simhash,
                            source_audit, substring, url_filter, warc)

LLM_QUERIES = {
    "op1_cube_mix": cube_mix.op1_cube_mix,
    "op2_chat_examples": chat.op2_chat_examples,
    "op3_simhash_groups": simhash.op3_simhash_groups,
    "op4_secret_findings": secret_scan.op4_secret_findings,
    "op5_repeated_bytes": prefix_parse.op5_repeated_bytes,
    "op6_benchmark_leaks": decontaminate.op6_benchmark_leaks,
    "op7_warc_index": warc.op7_warc_index,
    "op8_url_vocabulary": url_filter.op8_url_vocabulary,
    "op9_quality_divergence": quality.op9_quality_divergence,
    "op10_repeated_passages": substring.op10_repeated_passages,
    "op11_minmax_groups": minmax_hash.op11_minmax_groups,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_source_divergence": source_audit.op13_source_divergence,
}

LLM_ORACLE = {
    "op2_chat_examples": chat.ORACLE,
    "op6_benchmark_leaks": decontaminate.ORACLE,
    "op7_warc_index": warc.ORACLE,
    "op8_url_vocabulary": url_filter.ORACLE,
    "op11_minmax_groups": minmax_hash.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_source_divergence": source_audit.ORACLE,
}
