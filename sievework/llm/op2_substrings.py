"""Substring dedup by level-wise doubling.

Windows repeated at one length alone are extended to twice that length.  The first level is half the
wanted length.  There it is enough to look at the anchors, the half window of smallest hash in each
whole window: two equal whole windows have equal anchors, so nothing is lost and some seven in a hundred
positions are shuffled instead of all.  The second level hashes only whole windows whose anchor
occurs in two documents.  :func:`longer_repeats` goes on doubling until no window survives.

Texts meet these short lists of places at the scan when the lists are small, and by a shuffle otherwise.

Exact copies of a text are one class.  Only its smallest ``doc_id`` enters the search, the other copies
are covered whole.  Classes and windows are compared by 128-bit hashes.

Null texts and texts without words have no window.  Rows with a null ``doc_id`` are neither compared
nor cut.  Repeated rows give the same result twice; one ``doc_id`` with several texts is one document
whose texts do not cover each other.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .sides import narrow
from .words import Words, slices, smallest

_LOW = np.uint64(0xFFFFFFFF)
_KEY = ["doc_id", "tkey"]


def _list(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def _anchor_of(words: Words, window: int) -> np.ndarray:
    """For each whole window: index of the half window with the smallest hash, the leftmost of equals."""
    half = window // 2
    place = (np.arange(len(words.hashes)) - words.first[words.rows()]).astype(np.uint64)
    key = np.where(words.room(half), (words.windows(half) & ~_LOW) | place, np.uint64(2**64 - 1))
    return (smallest(key, window - half + 1) & _LOW).astype(np.int64) + words.first[words.rows()]


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b)):
            words = Words(part.column("text"))
            n_words = np.diff(words.first)
            whole = words.room(window)
            at = np.unique(_anchor_of(words, window)[whole])
            counts = np.bincount(words.rows()[at], minlength=part.num_rows)
            place = (at - words.first[words.rows()[at]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("tkey"), pa.array(n_words),
                 *(pa.array(x.view(np.int64)) for x in words.digests()),
                 _list(words.windows(window // 2)[at].view(np.int64), counts), _list(place, counts)],
                ["doc_id", "tkey", "n_words", "d1", "d2", "hashes", "places"])
    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b)):
            words = Words(part.column("text"))
            places = part.column("places")
            marked = np.zeros(len(words.hashes) + 1, bool)
            rows = np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy())
            marked[places.flatten().to_numpy() + words.first[rows]] = True
            at = np.flatnonzero(words.room(window))
            at = at[marked[_anchor_of(words, window)[at]]]
            rows = words.rows()[at]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(rows)), part.column("tkey").take(pa.array(rows)),
                 pa.array((at - words.first[rows]).astype(np.int32)),
                 pa.array(words.windows(window)[at].view(np.int64)),
                 pa.array(words.windows(window, salt=1)[at].view(np.int64))],
                ["doc_id", "tkey", "place", "h1", "h2"])
    return run


def _spans(window: int):
    """Places of covered windows as ascending pairs: first word, word after the last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            spans = []
            for places in part.column("places"):
                at = np.sort(places.values.to_numpy())
                new = np.flatnonzero(np.diff(at) > window) + 1
                spans.append(np.stack([at[np.concatenate([[0], new])], at[np.concatenate([new - 1, [len(at) - 1]])] + window], 1).ravel())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("tkey"), pa.array(spans, pa.list_(pa.int32()))], ["doc_id", "tkey", "spans"])
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for b in batches for p in slices(b)):
        n_words, n_removed, kept_text = [], [], []
        for text, copy, spans in zip(part.column("text").to_pylist(), part.column("copy").to_pylist(), part.column("spans").to_pylist()):
            words = (text or "").encode().split()      # bytes split at exactly the six separators
            kept = [] if copy else words
            if spans and not copy:
                edges = [0, *spans, len(words)]
                kept = [w for k in range(0, len(edges), 2) for w in words[edges[k]:edges[k + 1]]]
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            kept_text.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(kept_text, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("text").alias("tkey"), F.col("text").cast("string").alias("text"))


def _repeated(windows: DataFrame, by: list[str]) -> DataFrame:
    """Keys found in two documents at least, with the smallest of these.

    They are written, so that a join with them has plain shuffles on both sides and hot keys are split.
    """
    return materialize(windows.groupBy(*by).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
            .where("first_doc < last_doc").select(*by, "first_doc"), "repeated")


def _search(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyed texts, exact copies of smaller documents, and windows whose anchor occurs in two documents."""
    texts = _keyed(docs).where("doc_id IS NOT NULL")
    table = materialize(texts.mapInArrow(
        _anchors(window), "doc_id long, tkey long, n_words long, d1 long, d2 long, hashes array<long>, places array<int>"),
        "anchors").where(F.col("n_words") >= window)
    classes = table.groupBy("d1", "d2", "n_words").agg(F.min("doc_id").alias("doc_id"))
    copies = materialize(table.join(classes, ["d1", "d2", "n_words", "doc_id"], "left_anti").select(*_KEY).distinct(), "copies")
    anchors = table.join(narrow(copies), _KEY, "left_anti").select(
        *_KEY, F.explode(F.arrays_zip("hashes", "places")).alias("a")).select(
        *_KEY, F.col("a.hashes").alias("half"), F.col("a.places").alias("place"))
    survivors = materialize(anchors.join(_repeated(anchors, ["half"]), "half", "left_semi")
                            .groupBy(*_KEY).agg(F.collect_set("place").alias("places")), "survivors")
    windows = texts.join(narrow(survivors, F.size("places")), _KEY).mapInArrow(
        _windows(window), "doc_id long, tkey long, place int, h1 long, h2 long")
    return texts, copies, windows


def cut_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Texts without the words covered by a window that also starts in a document of smaller ``doc_id``.

    Windows are judged on the input.  Returns doc_id, n_words, n_removed and kept_text, the kept words
    joined by one blank, with one row per input row.
    """
    texts, copies, windows = _search(docs, window)
    covered = (windows.join(_repeated(windows, ["h1", "h2"]), ["h1", "h2"]).where("doc_id > first_doc")
               .groupBy(*_KEY).agg(F.collect_set("place").alias("places")))
    spans = covered.mapInArrow(_spans(window), "doc_id long, tkey long, spans array<int>").withColumn("copy", F.lit(False))
    marks = materialize(spans.unionByName(
        copies.select(*_KEY, F.lit(None).cast("array<int>").alias("spans"), F.lit(True).alias("copy"))), "marks")
    return _keyed(docs).join(narrow(marks, F.coalesce(F.size("spans"), F.lit(0))), _KEY, "left").select("doc_id", "text", "spans", "copy").mapInArrow(
        _cut, "doc_id long, n_words long, n_removed long, kept_text string")


def longer_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Windows shared by two documents at ``window`` words, at twice that and so on, until none survives.

    Copies of a text count by their smallest ``doc_id``.  Returns length, doc_id, place and first_doc;
    a window of twice the length is built from two neighbouring survivors, never from the text.
    """
    _, _, windows = _search(docs, window)
    found, length = None, window
    level = windows
    while True:
        level = materialize(level.join(_repeated(level, ["h1", "h2"]), ["h1", "h2"]), f"repeats-{length}")
        if level.isEmpty():
            break
        rows = level.select(F.lit(length).alias("length"), "doc_id", "place", "first_doc")
        found = rows if found is None else found.unionByName(rows)
        right = level.select(*_KEY, (F.col("place") - length).alias("place"), F.col("h1").alias("r1"), F.col("h2").alias("r2"))
        level = level.drop("first_doc").join(right, [*_KEY, "place"]).select(
            *_KEY, "place", F.xxhash64("h1", "r1").alias("h1"), F.xxhash64("r2", "h2").alias("h2"))
        length *= 2
    if found is None:
        found = level.select(F.lit(length).alias("length"), "doc_id", "place", "first_doc")
    return found


def kept_digest(docs: DataFrame, window: int = 50) -> DataFrame:
    """:func:`cut_repeats` with the kept words as a SHA-256 digest."""
    return cut_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
