"""The queries of the llm operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    centroids,
    codes,
    langid,
    minhash,
    mixing,
    packing,
    qualityrules,
    rankquality,
    spotsigs,
    tokens,
    toxicity,
    vectorjoin,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_minhash_dedup": minhash.op2_minhash_dedup,
    "op3_language_id": langid.op3_language_id,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality_rules": qualityrules.op7_quality_rules,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_quality_classifier": rankquality.op9_quality_classifier,
    "op10_embedding_dedup": vectorjoin.op10_embedding_dedup,
    "op11_centroid_clustering": centroids.op11_centroid_clustering,
    "op12_spot_signatures": spotsigs.op12_spot_signatures,
    "op13_vector_codes": codes.op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE_OP1, "op2_minhash_dedup": minhash.ORACLE_OP2, "op10_embedding_dedup": vectorjoin.ORACLE_OP10,
    "op11_centroid_clustering": centroids.ORACLE_OP11, "op13_vector_codes": codes.ORACLE_OP13,
}
