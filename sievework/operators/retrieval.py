"""Dense and keyword ranking, their fusion, and the similarity graph."""

from __future__ import annotations

import glob
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..functions import text as tx
from ..session import local_path, materialize, shared_dir, work_path

# --- fixed values: ranking constants ---------------------------------------------------------------
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
FUSION_K = 60
MIN_CONFIDENCE = 0.4
GRAPH_NEIGHBOURS, GRAPH_MIN_SIMILARITY = 3, 0.35
ZERO_NORM = 1e-9
# -----------------------------------------------------------------------------------------------------

# Similarities are compared at this many decimals, so equal vectors tie and ids decide, whatever the
# order in which products are added.
RANK_DECIMALS = 6

# A query set at most this large (vector components, or query terms) is sent to every task.
BROADCAST_COMPONENTS = 16_000_000
BROADCAST_TERMS = 1_000_000
POSTINGS_PER_TASK = 500_000  # weighted (query, passage, term) matches that a task adds up, whatever the size of the corpus
QUERY_ROWS = 1_024  # queries multiplied with a block of passages at a time


def unit_vector(v: Column) -> Column:
    """Vector of length one as doubles; a zero vector stays zero."""
    wide = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(wide, lambda x: x / F.when(norm == 0, ZERO_NORM).otherwise(norm))


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group with their rank.

    The limit on the rank is also applied in every task before the shuffle, so a group of any size
    sends at most ``n`` rows per task to the one that ranks it.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n).withColumn(
        rank, F.col(rank).cast("bigint"))


# --- dense -------------------------------------------------------------------------------------------

def _unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype("float64") if len(vectors) else np.zeros((0, 1))
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    norms[norms == 0] = ZERO_NORM
    return m / norms


def _best(scores: np.ndarray, n: int, floor: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the n best scores of each row; among equal scores the first columns win."""
    keep = scores > -np.inf if floor is None else scores >= floor
    if scores.shape[1] > n:
        nth = -np.partition(-scores, n - 1, axis=1)[:, n - 1:n]
        above, level = scores > nth, scores == nth
        room = n - above.sum(axis=1, keepdims=True)
        keep &= above | (level & (np.cumsum(level, axis=1) <= room))
    return np.nonzero(keep)


def dense_top(queries: DataFrame, passages: DataFrame, n: int, floor: float | None = None,
              exclude_self: bool = False, broadcast_components: int = BROADCAST_COMPONENTS) -> DataFrame:
    """Exact n most similar passages per query: (query_id, id, similarity, rank).

    queries: (query_id, embedding); passages: (id, embedding).  Similarity is the cosine, compared at
    RANK_DECIMALS; ties go to the smaller id.  ``floor`` drops pairs below a similarity;
    ``exclude_self`` drops pairs with equal ids.

    A query set of bounded size goes to every task, each scanning its own passages once.  A larger
    one is answered by cells (see :func:`_dense_top_by_cells`).
    """
    size = queries.agg(F.sum(F.size("embedding"))).first()[0] or 0
    if size > broadcast_components:
        candidates = _dense_top_without_copies(queries, passages, n, floor, exclude_self)
    else:
        candidates = _dense_top_by_scan(queries, passages, n, floor, exclude_self)
    return top_n(candidates, ["query_id"], [F.desc("similarity"), F.asc("id")], n)


def _candidate_schema(queries: DataFrame, passages: DataFrame) -> str:
    return (f"query_id {queries.schema['query_id'].dataType.simpleString()}, "
            f"id {passages.schema['id'].dataType.simpleString()}, similarity double")


def _score_block(query_ids: np.ndarray, query_units: np.ndarray, ids: np.ndarray, units: np.ndarray, n: int,
                 floor: float | None, exclude_self: bool) -> pd.DataFrame:
    """The n best passages of a block for every query, smaller ids first among equals."""
    order = np.argsort(ids, kind="stable")
    ids, units = ids[order], units[order]
    found = []
    for start in range(0, len(query_ids), QUERY_ROWS):
        asked = query_ids[start:start + QUERY_ROWS]
        scores = np.round(query_units[start:start + QUERY_ROWS] @ units.T, RANK_DECIMALS)
        if exclude_self:
            scores[asked[:, None] == ids[None, :]] = -np.inf
        rows, cols = _best(scores, n, floor)
        found.append(pd.DataFrame({"query_id": asked[rows], "id": ids[cols], "similarity": scores[rows, cols]}))
    return pd.concat(found)


def _n_best(found: pd.DataFrame, n: int) -> pd.DataFrame:
    ordered = found.sort_values(["query_id", "similarity", "id"], ascending=[True, False, True])
    return ordered.groupby("query_id", sort=False).head(n)


def _dense_top_by_scan(queries: DataFrame, passages: DataFrame, n: int, floor: float | None,
                       exclude_self: bool) -> DataFrame:
    """Each task multiplies its passages with the shared query matrix and sends only its n best per query."""
    sent = queries.select("query_id", "embedding").toPandas()  # bounded by BROADCAST_COMPONENTS
    shared = passages.sparkSession.sparkContext.broadcast(
        (sent["query_id"].to_numpy(), _unit_rows(sent["embedding"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, units = shared.value
        best = None
        for batch in batches:
            if len(batch) and len(query_ids):
                found = _score_block(query_ids, units, batch["id"].to_numpy(), _unit_rows(batch["embedding"]),
                                     n, floor, exclude_self)
                best = _n_best(found if best is None else pd.concat([best, found]), n)
        if best is not None:
            yield best

    return passages.select("id", "embedding").mapInPandas(scan, _candidate_schema(queries, passages))


# --- dense, both sides large ---------------------------------------------------------------------------
# Vectors on the unit sphere are grouped by their nearest pivot.  The angle is a metric, so a passage
# in a cell whose members lie between angles a and b from its pivot is at least max(t - b, a - t) away
# from a query at angle t.  Step one searches each query's own cell and thereby bounds its n-th best
# angle; step two visits only the cells that can still beat the bound.  Nothing is approximated.
#
# Where the shared folder is local or mounted, both sides are written to it once, sorted by cell, and a task holds
# some queries while it reads the passages of the cells that are still open; products are never written.  Any other
# store takes the way through shuffles, which copies a query for each cell it visits.

CELL_ROWS = 4_096  # rows of one side in one block product
MAX_PIVOTS = 256
VISIT_ROWS = 16_384  # visits a task hands on at a time: a batch of queries may have MAX_PIVOTS times as many as rows
ANGLE_SLACK = 1e-6
SCAN_QUERIES = 8_192  # queries that a task holds while it reads the passages
SCAN_BYTES = 1 << 20  # vectors of passages that are read at a time
PAIRS = 32_768  # pairs whose similarity is taken exactly at a time
ROUNDING = 10.0 ** -RANK_DECIMALS  # a similarity may be this much smaller than what it is rounded to


def _dense_top_without_copies(queries: DataFrame, passages: DataFrame, n: int, floor: float | None,
                              exclude_self: bool) -> DataFrame:
    """Answer each distinct query vector once, over at most a few copies of each passage vector.

    Equal passages are equally near to any query, so only the first ids of a group of copies can be
    among the n best; equal queries have equal answers but for themselves.  However many copies a
    vector has, the search sees a bounded number of them, and nothing is lost.
    """
    wanted = n + 1 if exclude_self else n
    few = top_n(passages.select("id", "embedding"), ["embedding"], [F.asc("id")], wanted).drop("rank")
    firsts = queries.groupBy("embedding").agg(F.min("query_id").alias("asked_id"))
    asked = queries.select("query_id", "embedding").join(firsts, "embedding")
    is_first = F.col("query_id") == F.col("asked_id")
    spark = passages.sparkSession
    if local_path(spark, shared_dir(spark)) is None:
        few, asked = materialize(few, "distinct-passages"), materialize(asked, "asked")
        hits = _dense_top_by_cells(asked.where(is_first).select("query_id", "embedding"), few, wanted, floor)
    else:
        asked, hits = _dense_top_by_files(asked.withColumn("is_first", F.coalesce(is_first, F.lit(False))), few, passages, wanted, floor)
    hits = top_n(hits, ["query_id"], [F.desc("similarity"), F.asc("id")], wanted)
    answers = asked.select("query_id", "asked_id").join(
        hits.select(F.col("query_id").alias("asked_id"), "id", "similarity"), "asked_id")
    if exclude_self:
        answers = answers.where(F.col("query_id") != F.col("id"))
    return answers.select("query_id", "id", "similarity")


def _pivots(passages: DataFrame, how_many: int) -> np.ndarray:
    """A few passages picked by hash; their number is fixed, so they are safe to send everywhere."""
    picked = passages.orderBy(F.xxhash64("id")).limit(how_many).select("embedding").toPandas()
    return _unit_rows(picked["embedding"])


def _with_cells(df: DataFrame, id_name: str, shared) -> DataFrame:
    """Add nearest cell, angle to its pivot, and unit vector."""
    id_type = df.schema[id_name].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            units = _unit_rows(batch["embedding"])
            angles = np.arccos(np.clip(units @ shared.value.T, -1.0, 1.0))
            cell = angles.argmin(axis=1)
            yield pd.DataFrame({id_name: batch[id_name], "unit": _packed(units), "cell": cell,
                                "angle": angles[np.arange(len(cell)), cell]})

    return df.select(id_name, "embedding").mapInPandas(
        assign, f"{id_name} {id_type}, unit binary, cell int, angle double")


def _packed(units: np.ndarray) -> list[bytes]:
    """Vectors as bytes: half the cost of arrays on the way to and from the workers."""
    return [row.tobytes() for row in units]


def _unpacked(units: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype="float64").reshape(len(units), -1)


def _blocked(df: DataFrame, cell_counts: DataFrame, key: str, side: str) -> DataFrame:
    """Number the rows of a cell into blocks by hash; a hot cell has many blocks, not a large one."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col(f"n_{side}") / CELL_ROWS)).cast("int")
    return (df.join(F.broadcast(cell_counts.select("cell", blocks.alias(f"{side}_blocks"))), "cell")
            .withColumn(f"{side}_block", F.pmod(F.xxhash64(key), F.col(f"{side}_blocks")).cast("int")))


def _block_products(visits: DataFrame, members: DataFrame, n: int, floor: float | None, schema: str) -> DataFrame:
    """Best pairs of every (cell, query block, passage block), each a bounded cogroup.

    visits: (query_id, unit, cell); members: (id, unit, cell).  A block of one side meets each block
    of the other once, so both sides are replicated by the other's number of blocks.
    """
    q_counts = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n_q"))
    p_counts = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n_p"))
    counts = q_counts.join(p_counts, "cell")  # at most MAX_PIVOTS rows
    keys = ["cell", "q_block", "p_block"]
    q = _blocked(visits, counts, "query_id", "q")
    q = q.join(F.broadcast(counts.select("cell", F.ceil(F.col("n_p") / CELL_ROWS).cast("int").alias("p_blocks"))),
               "cell").withColumn("p_block", F.explode(F.sequence(F.lit(0), F.col("p_blocks") - 1)))
    p = _blocked(members, counts, "id", "p")
    p = p.join(F.broadcast(counts.select("cell", F.ceil(F.col("n_q") / CELL_ROWS).cast("int").alias("q_blocks"))),
               "cell").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))

    def multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["query_id"][:0], "id": right["id"][:0], "similarity": []})
        return _score_block(left["query_id"].to_numpy(), _unpacked(left["unit"]), right["id"].to_numpy(),
                            _unpacked(right["unit"]), n, floor, False)

    return (q.select("query_id", "unit", *keys).groupBy(*keys)
            .cogroup(p.select("id", "unit", *keys).groupBy(*keys)).applyInPandas(multiply, schema))


def _visits(query_ids: np.ndarray, units: np.ndarray, cells: np.ndarray, open_: np.ndarray) -> Iterator[pd.DataFrame]:
    """A row for every query and open cell, a bounded number at a time: each row holds a vector."""
    rows, cols = np.nonzero(open_)
    for start in range(0, len(rows), VISIT_ROWS):
        row, col = rows[start:start + VISIT_ROWS], cols[start:start + VISIT_ROWS]
        yield pd.DataFrame({"query_id": query_ids[row], "unit": units[row], "cell": cells[col]})


def _dense_top_by_cells(queries: DataFrame, passages: DataFrame, n: int, floor: float | None) -> DataFrame:
    spark = passages.sparkSession
    schema = _candidate_schema(queries, passages)
    pivots = min(MAX_PIVOTS, max(1, math.isqrt(passages.count())))
    shared = spark.sparkContext.broadcast(_pivots(passages, pivots))
    members = materialize(_with_cells(passages, "id", shared), "cells-passages")
    asked = materialize(_with_cells(queries, "query_id", shared), "cells-queries")

    home = materialize(top_n(_block_products(asked.select("query_id", "unit", "cell"), members, n, floor, schema),
                             ["query_id"], [F.desc("similarity"), F.asc("id")], n), "home-hits")
    reach = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.min("similarity").alias("nth"))
    # whatever still rounds to the n-th similarity, or to the floor, may win by its id
    widest = F.lit(np.pi if floor is None else float(np.arccos(np.clip(floor - ROUNDING, -1.0, 1.0))))
    nth = F.col("nth") - ROUNDING
    bound = F.when(F.col("n_hits") >= n, F.acos(F.greatest(F.least(nth, F.lit(1.0)), F.lit(-1.0)))).otherwise(widest)
    bounded = asked.join(reach, "query_id", "left").select(
        "query_id", "unit", F.col("cell").alias("home"), F.least(bound, widest).alias("bound"))

    rings = {r["cell"]: (r["near"], r["far"]) for r in members.groupBy("cell").agg(
        F.min("angle").alias("near"), F.max("angle").alias("far")).collect()}  # at most MAX_PIVOTS rows
    cells = np.array(sorted(rings), dtype="int32")
    near = np.array([rings[c][0] for c in cells])
    far = np.array([rings[c][1] for c in cells])
    id_type = queries.schema["query_id"].dataType.simpleString()

    def plan_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            angles = np.arccos(np.clip(_unpacked(batch["unit"]) @ shared.value[cells].T, -1.0, 1.0))
            gap = np.maximum(np.maximum(angles - far, near - angles), 0.0)
            open_ = (gap <= batch["bound"].to_numpy()[:, None] + ANGLE_SLACK) & (
                cells[None, :] != batch["home"].to_numpy()[:, None])
            yield from _visits(batch["query_id"].to_numpy(), batch["unit"].to_numpy(), cells, open_)

    visits = materialize(bounded.mapInPandas(plan_visits, f"query_id {id_type}, unit binary, cell int"),
                         "cells-visits")
    away = _block_products(visits, members, n, floor, schema)
    return home.select("query_id", "id", "similarity").unionByName(away)


def _written_by_cell(df: DataFrame, keep: list[str], shared, label: str) -> str:
    """Write vectors as packed bytes with their cell and the angle to its pivot, sorted by cell; those with is_first false go without."""
    kind = "f4" if isinstance(df.schema["embedding"].dataType.elementType, FloatType) else "f8"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            embeddings = batch.column("embedding")
            widths = pc.unique(pc.list_value_length(embeddings)).to_pylist()
            if len(widths) != 1 or widths[0] is None:
                raise ValueError(f"embeddings of unlike lengths: {widths}")
            vectors = embeddings.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), widths[0])
            angles = _angles(_unit(vectors), shared.value)
            cell = angles.argmin(axis=1)
            packed = pa.array(_packed(vectors.astype(kind)), pa.binary())
            if "is_first" in keep:
                packed = pc.if_else(batch.column("is_first"), packed, None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), packed, pa.array(cell, pa.int32()), pa.array(angles[np.arange(len(cell)), cell])],
                [*keep, "vector", "cell", "angle"])

    path = work_path(df.sparkSession, label)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    (df.select(*keep, "embedding").mapInArrow(assign, f"{kinds}, vector binary, cell int, angle double")
     .sortWithinPartitions("cell").write.option("parquet.block.size", SCAN_BYTES).parquet(path))
    return path


def _unit(vectors: np.ndarray) -> np.ndarray:
    m = vectors.astype("float64")
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    norms[norms == 0] = ZERO_NORM
    return m / norms


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles to all pivots; a vector that holds NaN is far from everything."""
    return np.nan_to_num(np.arccos(np.clip(units @ pivots.T, -1.0, 1.0)), nan=np.pi)


def _parts(path: str) -> list[str]:
    return sorted(glob.glob(f"{glob.escape(path)}/*.parquet"))


def _rows_of(file: str, start: int, stop: int, columns: list[str]) -> pa.Table:
    """Rows of a Parquet file by their number; only the row groups that hold some are read."""
    source, tables, first = pq.ParquetFile(file), [], 0
    for g in range(source.num_row_groups):
        n = source.metadata.row_group(g).num_rows
        if first < stop and start < first + n:
            tables.append(source.read_row_group(g, columns).slice(max(start - first, 0), min(stop, first + n) - max(start, first)))
        first += n
    return pa.concat_tables(tables)


def _cells_within(source: pq.ParquetFile, g: int, last: int) -> tuple[int, int]:
    """First and last cell of a row group by its statistics; every cell where it has none."""
    group = source.metadata.row_group(g)
    of_cell = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema == "cell")
    known = of_cell.statistics if of_cell.is_stats_set and of_cell.statistics.has_min_max else None
    return (known.min, known.max) if known else (0, last)


class _Best:
    """The n best passages of some queries, and the similarity that a passage needs to become one."""

    def __init__(self, units: np.ndarray, n: int, low: np.ndarray):
        self.units, self.narrow, self.n, self.least, self.low = units, units.astype("float32"), n, low, low.copy()
        self.sims = np.full((len(units), n), -np.inf)
        self.nulls, self.ids = np.zeros((len(units), n), dtype=bool), None
        # what a product of 32-bit numbers may lack, and what rounding may add
        self.slack = (units.shape[1] + 4) * 2.0 ** -23 + ROUNDING

    def offer(self, rows: np.ndarray, units: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """Compare passages with some of the queries: 32-bit products tell which pairs are worth an exact one."""
        narrow = units.astype("float32")
        for start in range(0, len(rows), QUERY_ROWS):
            asked = rows[start:start + QUERY_ROWS]
            scores = self.narrow[asked] @ narrow.T
            near = scores >= (self.low[asked] - self.slack).astype("float32")[:, None]
            if np.count_nonzero(near) > 16 * self.n * len(asked):  # few bounds yet: the n best of this block are a bound as well
                busy = np.flatnonzero(near.sum(axis=1) > 16 * self.n)
                found = np.nan_to_num(scores[busy], nan=-np.inf, posinf=-np.inf, neginf=-np.inf)
                nth = np.partition(found, found.shape[1] - self.n, axis=1)[:, found.shape[1] - self.n]
                near[busy] &= found >= (nth - np.float32(2 * self.slack))[:, None]
            row, col = np.divmod(np.flatnonzero(near), near.shape[1])
            for first in range(0, len(row), PAIRS):
                r, c = asked[row[first:first + PAIRS]], col[first:first + PAIRS]
                sims = np.round(np.einsum("ij,ij->i", self.units[r], units[c]), RANK_DECIMALS)
                kept = (sims >= self.low[r]) & (sims > -np.inf)
                if kept.any():
                    self._add(r[kept], sims[kept], ids[c[kept]], nulls[c[kept]])

    def _add(self, rows: np.ndarray, sims: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        if self.ids is None:
            self.ids = np.empty(self.sims.shape, dtype=ids.dtype)
        touched = np.unique(rows)
        r, c = np.nonzero(self.sims[touched] > -np.inf)
        r = touched[r]
        rows, sims = np.concatenate([r, rows]), np.concatenate([self.sims[r, c], sims])
        ids, nulls = np.concatenate([self.ids[r, c], ids]), np.concatenate([self.nulls[r, c], nulls])
        order = np.lexsort((ids, ~nulls, -sims, rows))
        at = np.arange(len(order))
        starts = np.concatenate([[True], rows[order][1:] != rows[order][:-1]])
        rank = at - np.maximum.accumulate(np.where(starts, at, 0))
        order, rank = order[rank < self.n], rank[rank < self.n]
        self.sims[rows[order], rank], self.ids[rows[order], rank], self.nulls[rows[order], rank] = sims[order], ids[order], nulls[order]
        self.low[touched] = np.maximum(self.least[touched], self.sims[touched, self.n - 1])


def _passages_of(table: pa.Table, kind: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DataType]:
    """(units, ids, which ids are null, type of the ids) of rows of passages."""
    ids = table.column("id").combine_chunks()
    nulls = ids.is_null().to_numpy(zero_copy_only=False)
    empty = "" if pa.types.is_string(ids.type) else b"" if pa.types.is_binary(ids.type) else 0
    values = (ids.fill_null(pa.scalar(empty, ids.type)) if nulls.any() else ids).to_numpy(zero_copy_only=False)
    return _unit(_read_vectors(table, kind, width)), values, nulls, ids.type


def _read_vectors(table: pa.Table, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=kind).reshape(len(table), width)


def _dense_top_by_files(asked: DataFrame, few: DataFrame, passages: DataFrame, n: int, floor: float | None) -> tuple[DataFrame, DataFrame]:
    """(query_id, asked_id) as written, and the n best passages of the first queries.

    A task holds SCAN_QUERIES queries, bounds them by passages of their own cells, then reads the passages of all cells
    that are not ruled out.  Memory and disk grow with the rows, not with the pairs.
    """
    spark = passages.sparkSession
    schema = _candidate_schema(asked, few)
    pivots = np.unique(_pivots(passages, min(MAX_PIVOTS, max(1, math.isqrt(passages.count())))), axis=0)
    if not len(pivots):
        return asked, spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(pivots)
    members = _written_by_cell(few, ["id"], shared, "cells-passages")
    queries = _written_by_cell(asked, ["query_id", "asked_id", "is_first"], shared, "cells-queries")
    rings = spark.read.parquet(members).groupBy("cell").agg(F.min("angle"), F.max("angle")).collect()  # at most MAX_PIVOTS rows
    near, far = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for cell, least, most in rings:
        near[cell], far[cell] = least, most
    kinds = ["f4" if isinstance(df.schema["embedding"].dataType.elementType, FloatType) else "f8" for df in (asked, few)]
    query_files, files = (_parts(local_path(spark, path)) for path in (queries, members))
    held = [(file, pq.read_metadata(file).num_rows) for file in query_files]
    size = min(SCAN_QUERIES, max(QUERY_ROWS, math.ceil(sum(k for _, k in held) / (4 * spark.sparkContext.defaultParallelism))))
    work = [(file, start, min(start + size, k)) for file, k in held for start in range(0, k, size)]
    group_rows, slack = CELL_ROWS, ANGLE_SLACK
    width = pivots.shape[1]

    def search(file: str, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        rows = _rows_of(file, start, stop, ["query_id", "vector", "is_first"])
        rows = rows.filter(rows.column("is_first")).combine_chunks()
        if not len(rows):
            return
        units = _unit(_read_vectors(rows, kinds[0], width))
        angles = _angles(units, shared.value)
        home, everyone = angles.argmin(axis=1), np.arange(len(units))
        low = np.full(len(units), -np.inf if floor is None else floor)
        bounds = _Best(units, n, low)
        for part in files:  # any passages of its own cell bound a query
            open_ = np.isneginf(bounds.sims[:, n - 1])
            if not open_.any():
                break
            for found, cells in _groups(part, lambda first, last: (open_ & (home >= first) & (home <= last)).any()):
                for cell in np.unique(cells):
                    mine, there = everyone[open_ & (home == cell)], cells == cell
                    if len(mine):
                        bounds.offer(mine, found[0][there], found[1][there], found[2][there])
        # a passage is at least this far; what still rounds to the n-th similarity, or to the floor, may win by its id
        gap = np.maximum(np.maximum(angles - far, near - angles), 0.0)
        best, id_type = _Best(units, n, bounds.low), None

        def reach() -> np.ndarray:
            return np.arccos(np.clip(best.low - ROUNDING, -1.0, 1.0)) + slack

        for part in files:
            for found, cells in _groups(part, lambda first, last: (gap[:, first:last + 1].min(axis=1) <= reach()).any()):
                id_type = found[3]
                runs = np.unique(cells)
                open_ = gap[:, runs] <= reach()[:, None]
                some, sizes = open_.any(axis=1), np.bincount(np.searchsorted(runs, cells))
                if 2 * (open_.sum(axis=0) * sizes).sum() < some.sum() * len(cells):
                    for k, cell in enumerate(runs):
                        there = cells == cell
                        best.offer(everyone[open_[:, k]], found[0][there], found[1][there], found[2][there])
                else:
                    best.offer(everyone[some], *found[:3])
        row, rank = np.nonzero(best.sims > -np.inf)
        if len(row):
            yield pa.RecordBatch.from_arrays(
                [rows.column("query_id").combine_chunks().take(pa.array(row)),
                 pa.array(best.ids[row, rank], id_type, mask=best.nulls[row, rank]), pa.array(best.sims[row, rank])],
                ["query_id", "id", "similarity"])

    def _groups(part: str, wanted) -> Iterator[tuple]:
        """Blocks of a file's passages with their cells, those of row groups whose range of cells is wanted."""
        source = pq.ParquetFile(part)
        for g in range(source.num_row_groups):
            if wanted(*_cells_within(source, g, len(near) - 1)):
                table = source.read_row_group(g, ["id", "vector", "cell"])
                for start in range(0, len(table), group_rows):
                    block = table.slice(start, group_rows)
                    yield _passages_of(block, kinds[1], width), block.column("cell").to_numpy()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield from search(*work[k])

    hits = spark.range(0, len(work), 1, max(1, len(work))).mapInArrow(scan, schema)
    return spark.read.parquet(queries).select("query_id", "asked_id"), materialize(hits, "cell-hits")


# --- keywords ------------------------------------------------------------------------------------------

def tokenized(passages: DataFrame) -> DataFrame:
    """(id, tokens, n_tokens)."""
    return (passages.select("id", tx.tokens(F.col("text")).alias("tokens"))
            .withColumn("n_tokens", F.size("tokens").cast("bigint")))


def token_statistics(docs: DataFrame) -> DataFrame:
    """(token, n, n_docs): occurrences and documents of every token.

    A document adds a row per occurrence and one per distinct token, and both are summed per task
    before the shuffle; pairs of document and token never travel.
    """
    said = F.transform("tokens", lambda t: F.struct(t.alias("token"), F.lit(1).alias("n"), F.lit(0).alias("n_docs")))
    kinds = F.transform(F.array_distinct("tokens"),
                        lambda t: F.struct(t.alias("token"), F.lit(0).alias("n"), F.lit(1).alias("n_docs")))
    return (docs.select(F.inline_outer(F.concat(said, kinds))).where("token IS NOT NULL").groupBy("token")
            .agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")))


EVERY_DOCUMENT = ""  # never a token; stands for the corpus as a whole in the statistics


def term_statistics(docs: DataFrame) -> tuple[DataFrame, float]:
    """(term, df, idf) and the mean number of tokens; negative idf becomes a share of the mean idf.

    One pass over the texts: each document adds one row per distinct word and one for the corpus.
    Words are counted per task before the shuffle, so a word found in every document is one row per
    task.
    """
    counted = (docs.select("n_tokens", tx.each(F.array_append(F.array_distinct("tokens"), F.lit(EVERY_DOCUMENT)))
                           .alias("term"))
               .groupBy("term").agg(F.count(F.lit(1)).alias("df"),
                                    F.sum(F.when(F.col("term") == EVERY_DOCUMENT, F.col("n_tokens"))).alias("tokens")))
    counted = materialize(counted, "terms")
    corpus = counted.where(F.col("term") == EVERY_DOCUMENT).first()
    n_docs, n_tokens = (corpus["df"], corpus["tokens"]) if corpus else (0, 0)
    raw = counted.where(F.col("term") != EVERY_DOCUMENT).select(
        "term", "df", (F.ln(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw_idf"))
    # equal values are counted before they are added: far fewer additions, far less rounding
    by_value = raw.groupBy("raw_idf").agg(F.count(F.lit(1)).alias("n"))
    mean = by_value.agg(F.sum(F.col("raw_idf") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    idf = F.when(F.col("raw_idf") < 0, F.lit(BM25_EPSILON * mean)).otherwise(F.col("raw_idf"))
    return raw.select("term", "df", idf.alias("idf")), n_tokens / n_docs if n_docs else 0.0


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n_asked): repeated words of a query count each time."""
    return (queries.select("query_id", tx.each(tx.tokens(F.col("text"))).alias("term")).where("term IS NOT NULL")
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n_asked")))


def keyword_scores(queries: DataFrame, passages: DataFrame, broadcast_terms: int = BROADCAST_TERMS,
                   rows_per_salt: int = 1_000_000) -> DataFrame:
    """BM25 score of every passage that shares a weighted term with a query: (query_id, id, score)."""
    docs = tokenized(passages)
    asked = materialize(query_terms(queries), "query-terms")
    terms, mean_tokens = term_statistics(docs)
    weights = asked.join(terms, "term").select("query_id", "term", "df",
                                               (F.col("idf") * F.col("n_asked")).alias("weight"))
    wanted = weights.select("term").distinct()
    small = asked.count() <= broadcast_terms

    found = docs.select("id", "n_tokens", tx.each(F.col("tokens")).alias("term"))
    found = found.join(F.broadcast(wanted) if small else wanted, "term", "left_semi")
    # one shuffle, by document: counting words and, with the queries sent along, adding up the scores
    # of a document then both happen where its words are
    # tasks by the number of matches: merged by the bytes of their short rows, each would add up ever more of them
    matches = weights.agg(F.sum("df")).first()[0] or 0
    tasks = max(passages.sparkSession.sparkContext.defaultParallelism, math.ceil(matches / POSTINGS_PER_TASK))
    found = found.repartition(tasks, "id").groupBy("id", "n_tokens", "term").agg(F.count(F.lit(1)).alias("tf"))
    length = F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("n_tokens") / F.lit(mean_tokens)
    postings = found.select("id", "term", (F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + F.lit(BM25_K1) * length))
                            .alias("saturation"))
    if small:
        hits = postings.join(F.broadcast(weights.drop("df")), "term")
    else:
        # A frequent term is spread over as many salts as its document frequency asks for.
        salts = F.ceil(F.col("df") / rows_per_salt).cast("int")
        spread = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("df")
        # There are at most (all tokens / rows_per_salt) such terms; their number decides how they travel.
        per_term = materialize(terms.where(F.col("df") > rows_per_salt).select("term", salts.alias("salts")), "salts")
        salted = postings.join(F.broadcast(per_term) if per_term.count() <= broadcast_terms else per_term,
                               "term", "left")
        salted = salted.withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int"))
        hits = salted.join(spread, ["term", "salt"])
    return hits.groupBy("query_id", "id").agg(
        F.round(F.sum(F.col("weight") * F.col("saturation")), RANK_DECIMALS).alias("score"))


def keyword_top(queries: DataFrame, passages: DataFrame, n: int, **limits: int) -> DataFrame:
    """The n best passages per query by BM25, those scoring nothing left out."""
    scored = keyword_scores(queries, passages, **limits).where("score > 0")
    return top_n(scored, ["query_id"], [F.desc("score"), F.asc("id")], n)


# --- fusion ----------------------------------------------------------------------------------------------

def fuse(dense: DataFrame, lexical: DataFrame, k: int = FUSION_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: (query_id, id, fused, dense_rank, lexical_rank, rank)."""
    d = dense.select("query_id", "id", F.col("rank").alias("dense_rank"))
    x = lexical.select("query_id", "id", F.col("rank").alias("lexical_rank"))
    share = [F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0)) for c in ("dense_rank", "lexical_rank")]
    both = d.join(x, ["query_id", "id"], "full_outer").withColumn("fused", share[0] + share[1])
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.asc_nulls_last("dense_rank"),
                                                   F.asc_nulls_last("lexical_rank"))
    return both.withColumn("rank", F.row_number().over(order).cast("bigint"))


def ranked_lists(queries: DataFrame, passages: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The n best passages by cosine, among those with an embedding, and by words, among all."""
    with_vector = F.col("embedding").isNotNull()
    return dense_top(queries.where(with_vector), passages.where(with_vector), n), keyword_top(queries, passages, n)


def hybrid_top(queries: DataFrame, passages: DataFrame, n: int = 3, pool: int | None = None) -> DataFrame:
    """Dense and keyword ranking fused: (query_id, rank, id, score, similarity).

    queries: (query_id, text, embedding); passages: (id, text, source, embedding).  Passages and
    queries without an embedding take part by their words alone.  ``pool`` widens the candidate lists
    for a later reranking.  A query whose words are found nowhere keeps its cosine scores.
    """
    fetch = pool or n
    dense, lexical = ranked_lists(queries, passages, fetch)
    dense, lexical = materialize(dense, "dense-hits"), materialize(lexical, "keyword-hits")
    fused = fuse(dense, lexical).where(F.col("rank") <= n)
    scored = fused.join(dense.select("query_id", "id", "similarity"), ["query_id", "id"], "left")
    with_words = lexical.groupBy("query_id").agg(F.lit(True).alias("has_words"))
    score = F.when(F.col("has_words"), F.round("fused", 6)).otherwise(F.round("similarity", 4))
    return (scored.join(with_words, "query_id", "left")
            .select("query_id", "rank", "id", score.alias("score"), F.round("similarity", 4).alias("similarity")))


def rerank(hits: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """Order a candidate pool by scores computed elsewhere: (query_id, id, rerank_score)."""
    joined = hits.drop("rank").join(scores, ["query_id", "id"])
    return top_n(joined, ["query_id"], [F.desc("rerank_score"), F.asc("id")], n)


def cite(hits: DataFrame, by: str = "similarity", threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """Citation ids and a confidence flag per query.

    The gate compares the best ``by`` value of a query with the threshold.  Fused scores never exceed
    2 / 61, so gating on them (``by="score"``) flags every query that found words.
    """
    best = F.max(F.col(by)).over(Window.partitionBy("query_id"))
    return hits.select("*", F.concat(F.lit("c"), F.col("rank").cast("string")).alias("citation"),
                       (F.coalesce(best, F.lit(0.0)) < threshold).alias("low_confidence"))


# --- graph -----------------------------------------------------------------------------------------------

def graph_nodes(passages: DataFrame) -> DataFrame:
    return passages.select("id", tx.label(F.col("text")).alias("label"),
                           F.coalesce("source", F.lit("unknown")).alias("source"))


def graph_edges(passages: DataFrame, neighbours: int = GRAPH_NEIGHBOURS,
                floor: float = GRAPH_MIN_SIMILARITY, **limits: int) -> DataFrame:
    """Undirected edges to each passage's nearest others: (source, target, weight), source < target."""
    passages = passages.where(F.col("embedding").isNotNull())
    asked = passages.select(F.col("id").alias("query_id"), "embedding")
    pairs = dense_top(asked, passages, neighbours, floor=floor, exclude_self=True, **limits)
    return (pairs.groupBy(F.least("query_id", "id").alias("source"), F.greatest("query_id", "id").alias("target"))
            .agg(F.round(F.max("similarity"), 3).alias("weight")))
