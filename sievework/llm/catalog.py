"""Registered queries of the operators for training text, and the SQL that states their answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from ..sources.tables import table
from . import (op1_pieces, op2_substrings, op3_token_counts, op4_secrets, op5_private, op6_quality, op7_template,
               op8_benchmark, op9_jaccard, op10_language, op11_centroids, op12_simhash, op13_divergence, oracles)

def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


@query()
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece identifiers of every text and the digest of what they decode to."""
    return op1_pieces.encoded_digest(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


@query(oracles.SUBSTRINGS)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing 50-word windows that start in a document of smaller id."""
    return op2_substrings.kept_digest(table(spark, sf_dir, "documents"))


@query()
def op3_token_counts_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and byte-pair tokens of every text."""
    return op3_token_counts.count_tokens(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


@query(oracles.SECRETS)
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text, told apart by how many owners carry them."""
    return op4_secrets.scan_digest(table(spark, sf_dir, "documents"))


@query()
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base patterns and what the random field adds."""
    return op5_private.find_digest(table(spark, sf_dir, "documents"))


@query()
def op6_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every text and the verdict of rules and robust outliers."""
    return op6_quality.judged(table(spark, sf_dir, "documents"))


@query()
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the template of its host."""
    return op7_template.extract(table(spark, sf_dir, "pages"))


@query(oracles.CONTAMINATED)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, with the item and the share of its shingles."""
    return op8_benchmark.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(oracles.JACCARD)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles overlap by 85 per cent."""
    return op9_jaccard.similar_groups(table(spark, sf_dir, "documents"), size=4, percent=85)


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by string kernels learned from the rows that are not held out."""
    return op10_language.identify(table(spark, sf_dir, "documents"))


@query(oracles.CENTROIDS)
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector after ten rounds."""
    return op11_centroids.cluster_digest(table(spark, sf_dir, "embeddings"))


@query()
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and components of those within four bits."""
    return op12_simhash.near_groups(table(spark, sf_dir, "documents"))


@query(oracles.DIVERGENCE)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source departs from the other sources of its language, and the terms that tell it apart."""
    return op13_divergence.audit(table(spark, sf_dir, "documents"))
