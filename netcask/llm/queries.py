"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bm25 import search

    return search(_table(spark, sf_dir, "documents"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrappers import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op10_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .units import dedup_units

    return dedup_units(_table(spark, sf_dir, "documents"), passage=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_simhash, op3_pack, op4_url_filter, op5_search, op6_shard, op7_repeats, op8_decontaminate, op9_extract, op10_units)
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after
            FROM pages),
        cut AS (
            SELECT page_id,
                   translate(regexp_extract(after, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path
            FROM parts),
        judged AS (
            SELECT *, CASE
                WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
                WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
                WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
                WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/'
                END AS rule
            FROM cut)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM judged""",
}
