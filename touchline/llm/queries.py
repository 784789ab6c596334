"""The subpackage's queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_trie, divergence, fingerprints, importance, minhash_forest, mixing, pii, quality, secrets, token_counts, toxicity, url_filter, vector_forest


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_disclosure_pii": pii.op1_disclosure_pii,
        "op3_weak_supervision": quality.op3_weak_supervision,
        "op2_url_filter": url_filter.op2_url_filter,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_curriculum_mix": mixing.op5_curriculum_mix,
        "op6_ordinal_toxicity": toxicity.op6_ordinal_toxicity,
        "op7_bpe_round_trip": bpe_trie.op7_bpe_round_trip,
        "op8_projection_forest": vector_forest.op8_projection_forest,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_minhash_forest": minhash_forest.op10_minhash_forest,
        "op11_importance_resampling": importance.op11_importance_resampling,
        "op12_rare_feature_digest": fingerprints.op12_rare_feature_digest,
        "op13_divergence_audit": divergence.op13_divergence_audit,
    }


def checks() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.OP2_SQL,
        "op11_importance_resampling": importance.OP11_SQL,
        "op13_divergence_audit": divergence.OP13_SQL,
    }
