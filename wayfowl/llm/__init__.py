"""Operators for preparing training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations


def queries() -> dict:
    from . import ann, bpe, conversations, ctw, lexical, mincut, minhash, packing, quality, simhash, topk, toxicity, warc

    return {
        "op1_exact_topk": topk.op1_exact_topk,
        "op2_simhash_near_duplicates": simhash.op2_simhash_near_duplicates,
        "op3_html_min_cut": mincut.op3_html_min_cut,
        "op4_ann": ann.op4_ann,
        "op5_context_tree_scores": ctw.op5_context_tree_scores,
        "op6_sum_of_squares_packing": packing.op6_sum_of_squares_packing,
        "op7_quality": quality.op7_quality,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_warc": warc.op10_warc,
        "op11_lexical_search": lexical.op11_lexical_search,
        "op12_minhash_near_duplicates": minhash.op12_minhash_near_duplicates,
        "op13_conversation_repair": conversations.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    from . import lexical, minhash, topk, warc

    return {"op1_exact_topk": topk.ORACLE_SQL, "op10_warc": warc.ORACLE_SQL, "op11_lexical_search": lexical.ORACLE_SQL, "op12_minhash_near_duplicates": minhash.ORACLE_SQL}
