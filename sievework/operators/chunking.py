"""Splitting texts into passages: array expressions, one row in, its passages out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# --- fixed values: passage sizes -----------------------------------------------------------------
WORDS_PER_CHUNK, WORD_OVERLAP = 512, 64
CHARS_PER_CHUNK, CHAR_OVERLAP = 2000, 200
MESSAGE_LIMIT = 4096
# ---------------------------------------------------------------------------------------------------


def word_chunks(text: Column, size: int = WORDS_PER_CHUNK, overlap: int = WORD_OVERLAP) -> Column:
    """Chunks of ``size`` words, each starting ``size - overlap`` words after the one before."""
    split = tx.words(text)

    def cut(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ws), F.lit(size - overlap))
        return F.transform(starts, lambda s: F.array_join(F.slice(ws, s, size), " "))

    # transform over a one-element array binds the words once instead of splitting per chunk
    chunks = F.flatten(F.transform(F.array(split), cut))
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?U)\S"), chunks).otherwise(F.array().cast("array<string>"))


def char_chunks(text: Column, size: int = CHARS_PER_CHUNK, overlap: int = CHAR_OVERLAP) -> Column:
    """Chunks of ``size`` characters sharing ``overlap``; the first to reach the end is the last."""
    last_start = F.greatest(F.length(text) - overlap, F.lit(1))
    starts = F.sequence(F.lit(1), last_start, F.lit(size - overlap))
    return F.transform(starts, lambda s: F.substring(text, s, F.lit(size)))


def message_parts(text: Column, limit: int = MESSAGE_LIMIT) -> Column:
    """Consecutive parts of at most ``limit`` characters; an empty text is one empty part."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(limit))
    return F.transform(starts, lambda s: F.substring(text, s, F.lit(limit)))


def explode_chunks(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """One row per chunk with its number from 1 and the number of chunks of its text."""
    return (df.select(*keep, chunks.alias("__chunks"))
            .select(*keep, F.size("__chunks").cast("bigint").alias("n_chunks"),
                    F.posexplode_outer("__chunks").alias("chunk_no", "chunk"))
            .where("chunk IS NOT NULL").withColumn("chunk_no", (F.col("chunk_no") + 1).cast("bigint")))


def passage_id(source: Column, chunk_no: Column, text: Column) -> Column:
    """Content-derived id, so that ingesting the same text again gives the same id."""
    return F.sha2(F.concat_ws("\u0001", source, chunk_no.cast("string"), text), 256)
