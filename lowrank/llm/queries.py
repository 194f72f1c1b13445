"""Registered queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from lowrank.llm import backoff, bpe, chunks, ensemble, fingerprints, merkle, nearup, packing, rules, secrets, template, warc, whiten

QUERIES = {
    "op7_html_text": template.op7_html_text,
    "op9_quality_classifier": ensemble.op9_quality_classifier,
    "op1_substring_dedup": chunks.op1_substring_dedup,
    "op5_near_duplicates": nearup.op5_near_duplicates,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op6_secrets": secrets.op6_secrets,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op10_packing": packing.op10_packing,
    "op3_warc": warc.op3_warc,
    "op4_quality_rules": rules.op4_quality_rules,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_lm_scores": backoff.op12_lm_scores,
    "op13_whitening": whiten.op13_whitening,
}
ORACLE = {
    "op3_warc": warc.ORACLE,
    "op4_quality_rules": rules.oracle(),
    "op11_merkle_manifest": merkle.ORACLE,
}
