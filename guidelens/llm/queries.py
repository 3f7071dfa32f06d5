"""One query for each operator, over its whole table, as contracts fix them; and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, iblt, langid, media_ts, merkle, mixing, neardup, secrets, spelling, toxicity, urlfilter, vamana
from .common import table


def vocabulary() -> str:
    """The public byte-level vocabulary that op7 is fixed to; installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op3_media_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.digests(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chosen_path_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(table(spark, sf_dir, "documents"), k=3, per_cent=85)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"))


def op9_paragraph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.versions(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scans(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_perspectives,
        op2_source_mixing,
        op3_media_transport_streams,
        op4_language_id,
        op5_toxicity,
        op6_chosen_path_neardup,
        op7_bpe,
        op8_url_filter,
        op9_paragraph_fingerprints,
        op10_secret_scan,
        op11_merkle_manifest,
        op12_spelling_variants,
        op13_graph_neighbours,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_chat_perspectives": chat.PERSPECTIVES_SQL, "op8_url_filter": urlfilter.judged_sql(), "op11_merkle_manifest": merkle.manifest_sql(), "op12_spelling_variants": spelling.variants_sql()}
