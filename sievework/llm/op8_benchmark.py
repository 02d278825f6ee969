"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are split into partitions by the size of their shingle set.  An item of a partition is represented by its
bottom-k MinHash sketch, k being one more than the number of shingles that a document may lack and
still contain the item at the threshold, for the largest item of the partition.  So one value of the
sketch at least occurs in every document that contains the item, however long, and short items need only a few
values.  Documents are searched for sketch values as they are scanned.  Documents with a value are
then compared shingle by shingle, as text, with the items whose value they have.

Words are runs of letters and digits in lower case, so punctuation around a quoted item does not matter.  Items
of fewer words than a shingle are one shingle of all their words; items without words are ignored.

Null texts and texts without words contain nothing.  Texts under one ``doc_id`` are one document, repeated rows
change nothing.  Rows with a null ``doc_id`` are not searched; :func:`drop_contaminated` keeps them.
Equal items under several identifiers are all reported.  Other columns are ignored; an empty table on
either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .native import hashed_window, let, upto

#: Sketch and shingle hashes up to this number go into the scan as a literal set (8 bytes each); more are joined.
SCAN_SET = 50_000
#: Largest items of the size partitions; sizes above the last double from there.
FIRST_PARTITION = 8


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def item_shingles(items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """item_id, n_shingles, width, and for each shingle its text, hash and whether it is in the sketch."""
    split = items.select(F.col("item_id").cast("long").alias("item_id"), plain_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = split.select("item_id", F.least(F.size("w"), F.lit(size)).alias("width"), F.col("w"))
    by_width = [cut.where(F.col("width") == k).select("item_id", "width", F.array_distinct(F.transform(
        upto(F.size("w") - (k - 1)), lambda i: F.struct(
            hashed_window(F.col("w"), i, k).alias("hash"),
            F.concat_ws(" ", *(F.get(F.col("w"), i + j) for j in range(k))).alias("shingle")))).alias("all"))
        for k in range(1, size + 1)]
    sets = by_width[0]
    for other in by_width[1:]:
        sets = sets.unionByName(other)
    n = F.size("all")
    bound = F.greatest(F.lit(FIRST_PARTITION), F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("int"))
    lacking = bound - F.ceil(bound * percent / 100).cast("int")
    return sets.withColumn("sketch", F.slice(F.sort_array("all"), F.lit(1), lacking + 1)).select(
        "item_id", "width", n.cast("long").alias("n_shingles"), F.col("sketch.hash").alias("values"), F.explode("all").alias("s")).select(
        "item_id", "width", "n_shingles", "s.hash", "s.shingle", F.array_contains("values", F.col("s.hash")).alias("sketched"))


def _hits(docs: DataFrame, hashes: DataFrame, widths: list[int]) -> DataFrame:
    """Distinct (doc_id, hash, shingle): item shingles of the documents that have a sketch value.

    ``hashes`` has hash and sketched.  Up to SCAN_SET of them are looked up while a text is scanned; beyond that the
    shingles of all documents are joined with them.
    """
    known = {r["hash"]: r["sketched"] for r in hashes.collect()} if hashes.count() <= SCAN_SET else None
    out = docs.select("doc_id", F.lit(0).cast("long").alias("hash"), F.lit("").alias("shingle")).limit(0)
    for k in widths:
        def shingles(w: Column) -> Column:
            places = upto(F.size(w) - (k - 1))
            if known is not None:
                places = F.filter(places, lambda i: hashed_window(w, i, k).isin(list(known)))
            return F.transform(places, lambda i: F.struct(
                hashed_window(w, i, k).alias("hash"), F.concat_ws(" ", *(F.get(w, i + j) for j in range(k))).alias("shingle")))

        found = F.array_distinct(let(plain_words(F.col("text")), shingles))
        if known is not None:
            sketch = [h for h, sketched in known.items() if sketched]
            found = let(found, lambda s: F.filter(s, lambda _: F.exists(s, lambda x: x["hash"].isin(sketch))))
        out = out.unionByName(docs.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*"))
    if known is None:
        out = out.join(hashes, "hash")
        out = out.join(out.where("sketched").select("doc_id").distinct(), "doc_id", "left_semi").drop("sketched")
    return out.distinct()


def contaminated(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found and containment of every document that holds an item.

    A document holds an item when at least ``percent`` hundredths of the item's distinct shingles occur in it.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    shingles = materialize(item_shingles(items, size, percent), "items")
    widths = sorted(r[0] for r in shingles.select("width").distinct().collect())      # at most ``size`` numbers
    hits = _hits(texts, shingles.groupBy("hash").agg(F.max("sketched").alias("sketched")), widths)
    counts = (hits.join(shingles, ["hash", "shingle"]).groupBy("doc_id", "item_id", "n_shingles")
              .agg(F.count("*").alias("n_found"), F.max("sketched").alias("candidate")))
    return counts.where("candidate").where(100 * F.col("n_found") >= percent * F.col("n_shingles")).select(
        "doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns."""
    bad = contaminated(docs, items, size, percent).select(F.col("doc_id").alias("bad_doc_")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == F.col("bad_doc_"), "left_anti")
