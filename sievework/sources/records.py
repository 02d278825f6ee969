"""Records of large CSV files whose quoted cells hold line breaks, read by as many tasks as the files have blocks.

A physical line starts either outside of quotes or inside a quoted cell.  A first pass finds for every block of a file in which
of the two its last line ends, for either start.  Composing these along a file, one row a block, tells where every
block really starts.  A second pass then cuts each block into records and writes them once.  Only what is cut by a block border, at
most two pieces a block, is put together by a shuffle.  Both passes take the lines of a batch as one text, record by record.

A quote counts only at the start of a cell, as for the reader; within quotes two quotes stand for one.  Lines end at a line feed.
Blank lines are no records.  A file whose last quote is never closed ends in one record that holds the rest of it.
Files that cannot be split, like compressed ones, are one block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

WHOLE, HEAD, TAIL = 0, 1, 2
# cells that end in a line started outside of quotes, and what closes a cell in a line started inside
_CELLS = re.compile(r'(?:(?:"(?:[^"]|"")*"(?!")[^,]*|[^",][^,]*|),)*')
_CLOSED = re.compile(r'(?:[^"]|"")*"(?!")[^,]*')
_OPEN = re.compile(r'"(?:[^"]|"")*\Z')
# the same over many lines, each with its line feed: a record, as many as there are, and the rest of one from inside a cell
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,\n]*+|[^",\n][^,\n]*+|)'
_RECORD = re.compile(rf"{_CELL}(?:,{_CELL})*+\n")
_RECORDS = re.compile(rf"(?:{_CELL}(?:,{_CELL})*+\n)*+")
_REST = re.compile(rf'[^"]*+(?:""[^"]*+)*+"[^,\n]*+(?:,{_CELL})*+\n')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that starts inside a quoted cell, or outside, ends inside one."""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        closed = _CLOSED.match(line)
        if not closed:
            return True
        at = closed.end()
        if at == len(line):
            return False
        at += 1      # the comma after the cell
    return _OPEN.match(line, _CELLS.match(line, at).end()) is not None


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch, str]]:
    """Lines that follow each other in a block, as one text: the block, its batch and the lines, each with its line feed."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = (batch.column(c).to_numpy() for c in ("file", "start"))
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            part = batch.slice(at, end - at)
            yield (int(file[at]), int(start[at])), part, "\n".join(part.column("value").to_pylist()) + "\n"


def text_ends_inside(text: str, inside: bool) -> bool:
    """:func:`ends_inside` of lines that follow each other, each with its line feed."""
    if '"' not in text:
        return inside
    at = 0
    if inside:
        closed = _REST.match(text)
        if not closed:
            return True
        at = closed.end()
    return _RECORDS.match(text, at).end() < len(text)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block: where its last line ends, if its first starts outside and if inside."""
    at, ends = None, [False, True]

    def row():
        return pa.RecordBatch.from_pydict({"file": [at[0]], "start": [at[1]], "outside": [ends[0]], "inside": [ends[1]]})
    for block, _, text in _lines(batches):
        if at != block:
            if at:
                yield row()
            at, ends = block, [False, True]
        if ends[0] == ends[1]:      # from here on it does not matter where the block started
            ends = [text_ends_inside(text, ends[0])] * 2
        else:
            ends = [text_ends_inside(text, e) for e in ends]
    if at:
        yield row()


def _entered(blocks: pd.DataFrame) -> pd.DataFrame:
    """Whether each block of a file starts inside a quoted cell."""
    blocks, state, found = blocks.sort_values("start"), False, []
    for outside, inside in zip(blocks["outside"], blocks["inside"]):
        found.append(state)
        state = inside if state else outside
    return pd.DataFrame({"file": blocks["file"], "start": blocks["start"], "entered": found})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of every block, and pieces of those that its borders cut."""
    at, inside, kind, held, first = None, False, WHOLE, [], False      # held is what came before of an open record
    out: list[tuple] = []

    def close(kind: int, whole: bool, text: str) -> None:
        if kind != WHOLE or not whole or text.strip("\r"):
            out.append((at[0], at[1], kind if whole or kind == HEAD else TAIL, first, text))

    for block, part, text in _lines(batches):
        if at != block:
            if held:
                close(kind, False, "".join(held)[:-1])
            at, held, inside = block, [], part.column("entered")[0].as_py()
            kind, first = HEAD if inside else WHOLE, block[1] == 0
        place, size = 0, len(text)
        while place < size:
            found = (_REST if inside else _RECORD).match(text, place)
            if not found:
                held.append(text[place:])
                inside = True
                break
            record = "".join([*held, text[place:found.end() - 1]])
            close(kind, True, record)
            first = first and not record.strip("\r")
            place, kind, held, inside = found.end(), WHOLE, [], False
        if out:
            yield _batch(out)
            out.clear()
    if held:
        close(kind, False, "".join(held)[:-1])
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["file", "start", "kind", "first", "record"])


def records(spark: SparkSession, *paths: str) -> DataFrame:
    """file (a hash of its path), first and record: every record of the files, and whether it is the first of its file."""
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    blocks = lines.mapInArrow(_blocks, "file long, start long, outside boolean, inside boolean")
    entered = blocks.groupBy("file").applyInPandas(_entered, "file long, start long, entered boolean")
    # a row a block, so it is sent to the tasks, which read their blocks in order
    found = materialize(lines.join(F.broadcast(entered), ["file", "start"]).select("file", "start", "entered", "value").mapInArrow(
        _cut, "file long, start long, kind int, first boolean, record string"), "csv-records")
    pieces = found.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", "kind")
    joined = pieces.withColumn("from", F.last(F.when(F.col("kind") == TAIL, F.col("start")), ignorenulls=True).over(order)).groupBy("file", "from").agg(
        F.max("first").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "record"))),
                                                              lambda p: p["record"]), "\n").alias("record"))
    return found.where(F.col("kind") == WHOLE).select("file", "first", "record").unionByName(joined.select("file", "first", "record"))


def largest_file(spark: SparkSession, *paths: str) -> int:
    """Bytes of the largest file, from the listing alone."""
    return spark.read.format("binaryFile").load(list(paths)).agg(F.max("length")).first()[0] or 0
