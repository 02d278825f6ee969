"""Centroid clustering of integer vectors with Spark's own expressions.

Components become ``floor(scale * x)``.  A round holds the centroids as literal arrays: ``zip_with`` and ``aggregate``
give the squared distance to each, the least struct of (distance, number) is the cluster, and one grouped aggregate of
plain column sums gives the next centroids.  Only these sums, k rows of ``dims`` numbers whatever the table holds, come
to the driver.  All arithmetic is on integers, so results do not depend on the order of rows.

Vectors of another length, with a null component or with one that is not finite take no part and have no row.  Components
beyond ``LIMIT`` in size stop the job, as their squared distances need not fit 64 bits.  Rows of equal id count
each; those with a null id are clustered and start no centroid unless there are too few others.  Of equal ids the row
with the smaller vector comes first.  With fewer than k vectors each of them starts a centroid.  Equal distances go to
the smaller cluster number.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread

#: Largest component for which the squared distance of 64 components fits a long.
LIMIT = 1 << 27


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and x, an array of ``dims`` longs, of the vectors that take part."""
    raw = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("raw"))
    sound = raw.where((F.size("raw") == dims) & ~F.exists("raw", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return sound.select("vec_id", F.transform("raw", lambda v: F.when(
        F.abs(v * scale) < LIMIT, F.floor(v * scale)).otherwise(F.raise_error("component too large to cluster").cast("long"))).alias("x"))


def nearest(x: Column, centroids: list[list[int]]) -> Column:
    """Struct of the least squared distance and the number of the centroid it belongs to."""
    def distance(c: list[int]) -> Column:
        squares = F.zip_with(x, F.lit(c).cast("array<long>"), lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda total, d: total + d)

    return F.array_min(F.array(*(F.struct(distance(c).alias("distance"), F.lit(k).alias("cluster"))
                                 for k, c in enumerate(centroids))))


def moved(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: floors of the means of what is nearest to each; a centroid nobody is nearest to stays."""
    sums = [F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(len(centroids[0]))]
    grouped = points.select(nearest(F.col("x"), centroids)["cluster"].alias("cluster"), "x").groupBy("cluster").agg(
        F.count("*").alias("n"), *sums)
    after = list(centroids)
    for cluster, n, *total in grouped.collect():
        after[cluster] = [s // n for s in total]
    return after


def clustered(vectors: DataFrame, k: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024, seed: int = 3,
              id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid of every vector that takes part.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``<seed>:<id>``.  Rounds end early once no
    centroid moves, which changes nothing.
    """
    points = materialize(spread(integer_vectors(vectors, dims, scale, id_column, vector_column)), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [list(r["x"]) for r in points.orderBy(order.asc_nulls_last(), "x").limit(k).collect()]
    if not centroids:
        return points.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<long>"))))
    for _ in range(rounds):
        after = moved(points, centroids)
        if after == centroids:
            break
        centroids = after
    assigned = materialize(points.select("vec_id", nearest(F.col("x"), centroids).alias("best")).select(
        "vec_id", "best.cluster", "best.distance"), "clusters")
    inertia = [0] * len(centroids)
    for cluster, total in assigned.groupBy("cluster").agg(F.sum("distance")).collect():
        inertia[cluster] = total
    at = F.col("cluster")
    return assigned.select(
        "vec_id", "cluster", "distance", F.get(F.lit(inertia).cast("array<long>"), at).alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"), F.get(F.lit(centroids).cast("array<array<long>>"), at).alias("centroid"))


def cluster_digest(vectors: DataFrame) -> DataFrame:
    """What :func:`clustered` gives, with the SHA-256 of the centroid in place of the centroid."""
    return clustered(vectors).withColumn(
        "centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")
