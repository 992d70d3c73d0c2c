"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from patchloom.llm import bpe_tree, language_id, line_dedup, log_replay, lsh_search, mixing, near_dedup, sentence_pieces, spot_signatures, suffix_dedup, target_resampling, token_ledger, training_order

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_sentence_pieces": sentence_pieces.op2_sentence_pieces,
    "op3_mixing": mixing.op3_mixing,
    "op4_training_order": training_order.op4_training_order,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_lsh_search": lsh_search.op6_lsh_search,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_token_ledger": token_ledger.op8_token_ledger,
    "op9_language_id": language_id.op9_language_id,
    "op10_spot_signatures": spot_signatures.op10_spot_signatures,
    "op11_log_replay": log_replay.op11_log_replay,
    "op12_target_resampling": target_resampling.op12_target_resampling,
    "op13_bpe_tree": bpe_tree.op13_bpe_tree,
}
ORACLES = {
    "op1_line_dedup": line_dedup.SQL,
    "op3_mixing": mixing.SQL,
    "op7_suffix_dedup": suffix_dedup.SQL,
    "op10_spot_signatures": spot_signatures.SQL,
    "op11_log_replay": log_replay.SQL,
    "op12_target_resampling": target_resampling.SQL,
}
