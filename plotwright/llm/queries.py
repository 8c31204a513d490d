"""The corpus queries, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from plotwright.llm import bpe, chat, cotrain, dialogue_repair, fingerprints, licenses, mixing, near_dedup, packing, pii, quality_rules, suffix_dedup, vector_codes

QUERIES = {
    "op1_poisson_mix": mixing.op1_poisson_mix,
    "op2_simhash_tables": fingerprints.op2_simhash_tables,
    "op3_kneser_ney_bands": quality_rules.op3_kneser_ney_bands,
    "op4_anchor_expansion": pii.op4_anchor_expansion,
    "op5_ball_simhash": near_dedup.op5_ball_simhash,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_cotraining": cotrain.op7_cotraining,
    "op8_perspective_rotation": chat.op8_perspective_rotation,
    "op9_set_join": licenses.op9_set_join,
    "op10_cover_suffixes": suffix_dedup.op10_cover_suffixes,
    "op11_dialogue_repair": dialogue_repair.op11_dialogue_repair,
    "op12_filtering_lloyd": vector_codes.op12_filtering_lloyd,
    "op13_hilbert_packing": packing.op13_hilbert_packing,
}

ORACLES = {
    "op1_poisson_mix": mixing.ORACLE,
    "op8_perspective_rotation": chat.ORACLE,
    "op9_set_join": licenses.oracle(),
    "op10_cover_suffixes": suffix_dedup.ORACLE,
    "op11_dialogue_repair": dialogue_repair.ORACLE,
    "op12_filtering_lloyd": vector_codes.oracle(),
}
