"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from rangeweave.llm import op1_chat, op2_licenses, op3_lines, op4_sentencepiece, op5_decontamination, op6_toxicity, op7_simhash, op8_pii, op9_secrets, op10_quality

QUERIES = {
    "op1_chat_collapse": op1_chat.query,
    "op2_license_join": op2_licenses.query,
    "op3_fuzzy_lines": op3_lines.query,
    "op4_sentencepiece_fst": op4_sentencepiece.query,
    "op5_latent_leaks": op5_decontamination.query,
    "op6_toxicity_chain": op6_toxicity.query,
    "op7_golay_simhash": op7_simhash.query,
    "op8_pii_spans": op8_pii.query,
    "op9_assigned_secrets": op9_secrets.query,
    "op10_host_quality": op10_quality.query,
}
SQL = {
    "op1_chat_collapse": op1_chat.SQL,
    "op2_license_join": op2_licenses.SQL,
    "op8_pii_spans": op8_pii.SQL,
    "op10_host_quality": op10_quality.SQL,
}
