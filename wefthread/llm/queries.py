"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, jaccard, knn, mixing, passages, pii, quality, secret_scan, simhash, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_voronoi_knn": knn.op1_voronoi_knn,
        "op2_jaccard_join": jaccard.op2_jaccard_join,
        "op3_substring_dedup": passages.op3_substring_dedup,
        "op4_mixing": mixing.op4_mixing,
        "op5_fingerprints": simhash.op5_fingerprints,
        "op6_quality": quality.op6_quality,
        "op7_bpe": bpe.op7_bpe,
        "op8_pii": pii.op8_pii,
        "op9_url_filter": urls.op9_url_filter,
        "url_aliases": urls.url_aliases,
        "op10_secrets": secret_scan.op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_voronoi_knn": knn.ORACLE_SQL, "op9_url_filter": urls.ORACLE_SQL, "url_aliases": urls.ALIAS_SQL}
