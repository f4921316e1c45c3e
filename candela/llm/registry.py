"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import brown, decontaminate, fingerprints, near_duplicates, packing, pages, pii, substrings, toxicity, warc

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_main_text": pages.op2_main_text,
    "op8_warc": warc.op8_warc,
    "op4_brown": brown.op4_brown,
    "op5_pii": pii.op5_pii,
    "op3_toxicity": toxicity.op3_toxicity,
    "op6_near_duplicates": near_duplicates.op6_near_duplicates,
    "op10_packing": packing.op10_packing,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op9_decontamination": decontaminate.op9_decontamination,
}
SQL = {
    "op8_warc": warc.OP8_SQL,
    "op6_near_duplicates": near_duplicates.OP6_SQL,
    "op7_substring_dedup": substrings.OP7_SQL,
    "op9_decontamination": decontaminate.OP9_SQL,
}
