"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from lodestar.llm import bpe, embedding_dedup, exact_dedup, hard_negatives, importance, jaccard, langid, lines, packing, pii, quality, secrets, toxicity


def queries() -> dict:
    return {
        "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_pii": pii.op3_pii,
        "op4_jaccard": jaccard.op4_jaccard,
        "op5_langid": langid.op5_langid,
        "op6_lines": lines.op6_lines,
        "op7_packing": packing.op7_packing,
        "op8_bpe": bpe.op8_bpe,
        "op9_secrets": secrets.op9_secrets,
        "op10_quality": quality.op10_quality,
        "op11_importance": importance.op11_importance,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict:
    return {
        "op1_embedding_dedup": embedding_dedup.OP1_SQL,
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op4_jaccard": jaccard.OP4_SQL,
        "op6_lines": lines.OP6_SQL,
        "op11_importance": importance.OP11_SQL,
        "op13_hard_negatives": hard_negatives.OP13_SQL,
    }
