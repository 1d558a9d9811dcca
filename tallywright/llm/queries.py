"""The corpus operators as queries over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lexical, licenses, media, mixing, nearest, neardup, packing, pages, pii, quality, resampling, rules, sharding
from .common import read


def vocabulary() -> str:
    """The public byte-level vocabulary's place on the machine where this runs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(read(spark, sf_dir, "pages"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(read(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_OPERATORS = (
    op1_license_scan,
    op2_html_extraction,
    op3_media_columns,
    op4_quality_rules,
    op5_quality_classifier,
    op6_packing,
    op7_sharding,
    op8_mixing,
    op9_pii,
    op10_minhash_near_dedup,
    op11_ranked_lexical_search,
    op12_nearest_neighbours,
    op13_importance_resampling,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES = {"op4_quality_rules": rules.JUDGE_SQL, "op11_ranked_lexical_search": lexical.SEARCH_SQL, "op13_importance_resampling": resampling.RESAMPLE_SQL}
