"""SimHash near duplicates by a segment-popcount embedding and a grid join.

A fingerprint is mapped to the number of set bits in each of its 32 segments of two bits.  The Manhattan distance of two
such points is never above the number of differing bits.  The coordinates stand in eight blocks of four.  Two points within
Manhattan distance ``most`` differ in at most so many blocks, so they share a cell in one of the grids that are as
fine as the counts in ``8 - most`` of the blocks and unbounded in the others; for 4 bits there are 70 grids.  What meets is
verified on the bits.  Cells are exact, not hashed.

Documents of equal fingerprint are one row of the join.  A cell is first known by its number of members and its smallest and
largest one, which settles all cells of two.  In larger cells all members are compared with the smallest one.
Components of these links are found, and only cells that still hold members of several components go on: there members of different
components are compared, in a join whose condition is the verification, so that pairs inside a group of
copies are neither listed nor compared, and a large cell is split by the adaptive skew join.

Null texts and texts without words have fingerprint zero and link like any other.  Texts of fewer than ``size`` words are one
shingle.  Rows with a null ``doc_id`` get their fingerprint, a null component and no part in links.  Repeated rows give
their result each; rows of one ``doc_id`` with several texts are judged each by its own text.  Long texts are read in
pieces.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components
from .sides import narrow
from .words import slices

#: Bytes of text cut into words at a time.
PIECE_BYTES = 1 << 20
SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANK = re.compile(rb"[ \t-\r]")
#: Blocks of four segments.
BLOCKS = 8
#: Every second bit of a half.
_ODD_BITS = 0x55555555


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, some at a time."""
    at = 0
    while at < len(text):
        stop = _BLANK.search(text, at + PIECE_BYTES) if at + PIECE_BYTES < len(text) else None
        end = stop.start() if stop else len(text)
        yield text[at:end].translate(_LOWER).split()
        at = end


def fingerprint(text: bytes, size: int = 4) -> int:
    """Bits set in over half of the shingle hashes; an unsigned number."""
    hashed, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    words: list[bytes] = []
    for more in _word_lists(text):
        words = words[1 - size:] + more if size > 1 else more
        if len(words) < size:
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        stops = ends[size - 1:].tolist()
        values = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts, stops)], "<u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(values)
    if n == 0:
        return hashed(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b)):
            texts = pc.fill_null(part.column("text"), "").cast(pa.large_binary())
            marks = np.array([fingerprint(t.as_py(), size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(marks)], ["doc_id", "mark"])
    return run


def counts(mark: Column) -> list[Column]:
    """The set bits of each segment: eight blocks of four two-bit counts."""
    blocks = []
    for half in (0, 1):
        bits = F.shiftrightunsigned(mark, 32 * half)
        packed = bits.bitwiseAND(F.lit(_ODD_BITS)) + F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(_ODD_BITS))
        blocks += [F.shiftright(packed, 8 * k).bitwiseAND(F.lit(0xFF).cast("long")) for k in range(4)]
    return blocks


def entered(marks: DataFrame, most: int) -> DataFrame:
    """mark and cell, a row for each grid: the counts of the blocks the grid is fine in, and the grid's number."""
    fine = BLOCKS - most
    blocks = marks.select("mark", *(c.alias(f"b{k}") for k, c in enumerate(counts(F.col("mark")))))
    found = []
    for grid, chosen in enumerate(combinations(range(BLOCKS), fine)):
        cell = F.lit(grid if fine < BLOCKS else 0).cast("long")
        for k in chosen:
            cell = F.shiftleft(cell, 8).bitwiseOR(F.col(f"b{k}"))
        found.append(cell)
    return blocks.select("mark", F.explode(F.array(*found)).alias("cell"))


def _near(x: Column, y: Column, most: int) -> Column:
    return F.bit_count(x.bitwiseXOR(y)) <= most


def _labels(marks: DataFrame, most: int) -> DataFrame:
    """(mark, label): label is equal for fingerprints that reach each other by links; those without a link may be left out."""
    rows = entered(marks, most)
    shared = materialize(rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("mark").alias("leader"), F.max("mark").alias("last"))
                         .where("n > 1"), "shared-cells")
    large = materialize(shared.where("n > 2").select("cell", "leader"), "large-cells")
    members = materialize(rows.join(narrow(large), "cell"), "cell-members")
    met = shared.select(F.col("leader").alias("a"), F.col("last").alias("b")).unionByName(
        members.select(F.col("leader").alias("a"), F.col("mark").alias("b")))
    first = materialize(components(met.where(_near(F.col("a"), F.col("b"), most)), "leader-links"), "leader-components")
    known = members.join(narrow(first), members["mark"] == first["node"], "left").select(
        "cell", "mark", F.coalesce("component", "mark").alias("label"))
    known = materialize(known, "labelled-members")
    mixed = materialize(known.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("cell"), "mixed-cells")
    rest = materialize(known.join(narrow(mixed), "cell", "left_semi"), "mixed-members")
    x, y = rest.toDF("cell", "x", "label_x"), rest.toDF("cell", "y", "label_y")
    across = x.join(y, (x["cell"] == y["cell"]) & (x["label_x"] < y["label_y"]) & _near(x["x"], y["y"], most)).select(
        F.col("label_x").alias("a"), F.col("label_y").alias("b"))
    second = materialize(components(across, "label-links"), "label-components").toDF("first_", "second_")
    ends = first.join(narrow(second), F.col("component") == F.col("first_"), "left").select(
        F.col("node").alias("mark"), F.coalesce("second_", "component").alias("label"))
    # fingerprints without a link in the first step are their own label there
    alone = second.join(narrow(first), F.col("first_") == F.col("node"), "left_anti").select(
        F.col("first_").alias("mark"), F.col("second_").alias("label"))
    return materialize(ends.unionByName(alone), "labels")


def near_groups(docs: DataFrame, size: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits and component_id, the smallest doc_id reachable by links, for every row.

    Two documents link when their fingerprints over ``size`` lower-cased words differ in at most ``most`` bits.
    """
    if not 0 <= most < BLOCKS:
        raise ValueError(f"most must be between 0 and {BLOCKS - 1}")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = materialize(texts.mapInArrow(_fingerprints(size), "doc_id long, mark long"), "fingerprints")
    classes = materialize(marked.where("doc_id IS NOT NULL").groupBy("mark").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    labels = _labels(classes.select("mark"), most)
    told = classes.join(narrow(labels), "mark", "left").select("mark", "first", F.coalesce("label", "mark").alias("label"))
    least = told.groupBy("label").agg(F.min("first").alias("component_id"))
    groups = materialize(told.join(least, "label").select("mark", "component_id"), "groups")
    return marked.join(narrow(groups), "mark", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
