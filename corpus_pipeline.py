"""Training-corpus pipeline: the stages below, each over what the one before kept.

Documents that the quality rules reject go, one document of each group of near copies stays, documents that hold a
benchmark item go, secrets in the rest are blanked out, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import op1_pieces, op4_secrets, op6_quality, op8_benchmark, op9_jaccard
from sievework.session import materialize, prepare
from sievework.sources.tables import table

#: Word shingles and similarity of near copies and of benchmark items.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
MODEL = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source."""
    return op6_quality.keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies; repeated rows are one, rows without id stay."""
    return op9_jaccard.keep_first(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op8_benchmark.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), SHINGLE_WORDS, SIMILAR_PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets blanked out and n_chars counted again."""
    return op4_secrets.blank_out(docs).withColumn("n_chars", F.length("text").cast("long"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of every text with their number and the digest of what they decode to."""
    import public_tokenizers

    return op1_pieces.encoded_digest(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding", sentencepiece),
]

#: Robust estimates and piece merges are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
