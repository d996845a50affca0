"""Queries and oracle SQL of this package, by name."""

from chronofold.llm import chat, decontaminate, langid, linedup, nearest, neardup, oracle, packing, quality, scoring, warc

QUERIES = {
    "op1_bestfit_packing": packing.op1_bestfit_packing,
    "op2_superminhash_neardup": neardup.op2_superminhash_neardup,
    "op3_rule_quality": quality.op3_rule_quality,
    "op4_suffix_line_dedup": linedup.op4_suffix_line_dedup,
    "op5_simhash_decontamination": decontaminate.op5_simhash_decontamination,
    "op6_reply_tree_chat": chat.op6_reply_tree_chat,
    "op7_ppm_scores": scoring.op7_ppm_scores,
    "op8_int8_block_nearest": nearest.op8_int8_block_nearest,
    "op9_warc_roundtrip": warc.op9_warc_roundtrip,
    "op10_marginal_langid": langid.op10_marginal_langid,
}

ORACLE_SQL: dict[str, str] = {
    "op2_superminhash_neardup": oracle.OP2,
    "op4_suffix_line_dedup": linedup.OP4_SQL,
    "op5_simhash_decontamination": oracle.OP5,
    "op6_reply_tree_chat": oracle.OP6,
    "op8_int8_block_nearest": oracle.OP8,
    "op9_warc_roundtrip": oracle.OP9,
}
