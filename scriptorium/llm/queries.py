"""The queries of this package, by name: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(read(spark, sf_dir, "documents"))


@query
def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_report

    return secret_report(read(spark, sf_dir, "documents"))


@query
def op3_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(read(spark, sf_dir, "documents"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup_report

    return suffix_dedup_report(read(spark, sf_dir, "documents"))


@query
def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_dup_report

    return near_dup_report(read(spark, sf_dir, "documents"))


@query
def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_report

    return license_report(read(spark, sf_dir, "documents"))


@query
def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .matroska import media_report

    return media_report(read(spark, sf_dir, "documents"))


@query
def op9_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_report

    return toxicity_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op7_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_codec import token_file_report

    return token_file_report(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest_report

    return manifest_report(read(spark, sf_dir, "documents"))


@query
def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .main_text import main_text_report

    return main_text_report(read(spark, sf_dir, "pages"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import alignment_report

    return alignment_report(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
