"""The registered queries of this subpackage, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import licenses, media, mixing, near, packing, ppm, quality, substrings, urls, vectors
from rankloom.llm.shared import spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(documents(spark, sf_dir))


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def op4_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.similar(documents(spark, sf_dir), links_too=False).select("doc_id", "n_shingles", "component_id")


def op7_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_jaccard_join with every document's number of links, which its SQL doesn't have."""
    return near.similar(documents(spark, sf_dir))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return mixing.mix(docs, table(spark, sf_dir, "labels"), with_text=False)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_avi_media, op2_vector_search, op3_substring_dedup, op4_ppm_scores, op5_packing, op6_url_filter, op7_jaccard_join, op8_source_mixing, op9_license_scan, op10_quality)}
MORE: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_jaccard_links": op7_jaccard_links}
ORACLES: dict[str, str] = {"op3_substring_dedup": substrings.ORACLE, "op6_url_filter": urls.oracle(), "op7_jaccard_join": near.ORACLE}
