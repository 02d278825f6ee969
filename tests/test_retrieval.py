"""Ranking against brute force on small fixtures."""

from __future__ import annotations

import math
import random
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sievework.operators import retrieval as rt
from sievework.session import shared_dir


def vectors(n, dim=6, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(centres[i % 5] + 0.3 * rng.normal(size=dim)).tolist() for i in range(n - copies)]
    return rows + [rows[0]] * copies


def table(spark, rows, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{name} bigint, embedding array<float>")


def brute(queries, passages, n, floor=None, exclude_self=False):
    q, p = (np.asarray(m, dtype="float32").astype("float64") for m in (queries, passages))
    unit = [m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1e-9, np.linalg.norm(m, axis=1, keepdims=True))
            for m in (q, p)]
    scores = np.round(unit[0] @ unit[1].T, rt.RANK_DECIMALS)
    found = {}
    for i in range(len(q)):
        order = [j for j in sorted(range(len(p)), key=lambda j: (-scores[i, j], j))
                 if not (exclude_self and i == j) and (floor is None or scores[i, j] >= floor)]
        found[i] = [(j, float(scores[i, j])) for j in order[:n]]
    return found


def ranked(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
    return found


@pytest.mark.parametrize("limits", [{}, {"broadcast_components": 0}])
@pytest.mark.parametrize("copies, floor, exclude_self", [(0, None, False), (40, None, True), (40, 0.35, True), (0, 0.9, False)])
def test_dense_top_is_exact(spark, limits, copies, floor, exclude_self):
    rows = vectors(120, copies=copies)
    asked = table(spark, rows, "query_id")
    found = ranked(rt.dense_top(asked, table(spark, rows), 3, floor, exclude_self, **limits))
    expected = {k: v for k, v in brute(rows, rows, 3, floor, exclude_self).items() if v}
    assert found.keys() == expected.keys()
    for k in expected:
        assert [j for j, _ in found[k]] == [j for j, _ in expected[k]]
        assert [s for _, s in found[k]] == pytest.approx([s for _, s in expected[k]], abs=2e-6)


@pytest.mark.parametrize("floor", [None, 0.999999])
def test_cells_keep_ties_of_rounded_similarities(spark, floor):
    """Hundreds of vectors within a hundredth of a radian: ids decide among equal rounded similarities."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=8)
    rows = [(centre + 10.0 ** -rng.integers(2, 5) * rng.normal(size=8)).tolist() for _ in range(300)]
    asked, stored = table(spark, rows[:80], "query_id"), table(spark, rows)
    by_scan, by_cells = (ranked(rt.dense_top(asked, stored, 5, floor, **limits)) for limits in ({}, {"broadcast_components": 0}))
    assert by_cells == by_scan


def test_hybrid_finds_passages_without_a_vector(spark):
    passages = spark.createDataFrame(
        [(1, "plain words", "a", [1.0, 0.0]), (2, "rare zebra words", "b", None), (3, "other things", "c", [0.0, 1.0]), (4, "more", "d", None)],
        "id bigint, text string, source string, embedding array<float>")
    asked = spark.createDataFrame([(1, "zebra", [1.0, 0.0]), (2, "zebra", None)], "query_id bigint, text string, embedding array<float>")
    found = {(r["query_id"], r["id"]) for r in rt.hybrid_top(asked, passages, 2).collect()}
    assert found == {(1, 1), (1, 2), (2, 2)}


def test_cells_with_several_blocks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(rt, "CELL_ROWS", 16)
    rows = vectors(150, seed=3, copies=20)
    found = ranked(rt.dense_top(table(spark, rows[:60], "query_id"), table(spark, rows), 4, broadcast_components=0))
    expected = brute(rows[:60], rows, 4)
    assert {k: [j for j, _ in v] for k, v in found.items()} == {k: [j for j, _ in v] for k, v in expected.items()}


def test_zero_vectors_are_near_nothing(spark):
    rows = [[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]]
    found = ranked(rt.dense_top(table(spark, rows, "query_id"), table(spark, rows), 3))
    assert found[0] == [(0, 0.0), (1, 0.0), (2, 0.0)] and found[2][0] == (2, 1.0)
    unit = table(spark, rows).select("id", rt.unit_vector(F.col("embedding")).alias("u")).orderBy("id").collect()
    assert [r["u"] for r in unit] == [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]


def bm25(texts, question, k1=1.5, b=0.75, epsilon=0.25):
    docs = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    mean_len = sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor = epsilon * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / mean_len))
                for t in re.findall("[a-z0-9]+", question.lower())) for d in docs]


@pytest.mark.parametrize("limits", [{}, {"broadcast_terms": 0, "rows_per_salt": 3}])
def test_keyword_scores_match_the_formula(spark, limits):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    texts = ["common " + " ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(40)] + ["", "solo"]
    questions = ["common w1 w2 W2", "solo", "absent", "w3 w4 w5 w6"]
    passages = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    asked = spark.createDataFrame(list(enumerate(questions)), "query_id bigint, text string")
    found = {(r["query_id"], r["id"]): r["score"] for r in rt.keyword_scores(asked, passages, **limits).collect()}
    for i, question in enumerate(questions):
        for j, score in enumerate(bm25(texts, question)):
            assert found.get((i, j), 0.0) == pytest.approx(score, abs=1e-6)
    top = rt.keyword_top(asked, passages, 3, **limits).where("query_id = 2")
    assert top.isEmpty()


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, id bigint, rank bigint")


def test_fusion(spark):
    dense = hits(spark, [(1, 10, 1), (1, 11, 2), (1, 12, 3)])
    lexical = hits(spark, [(1, 13, 1), (1, 11, 2)])
    fused = [(r["id"], round(r["fused"], 6)) for r in rt.fuse(dense, lexical).orderBy("rank").collect()]
    assert fused == [(11, round(2 / 62, 6)), (10, round(1 / 61, 6)), (13, round(1 / 61, 6)), (12, round(1 / 63, 6))]


def test_hybrid_falls_back_to_cosine_and_gates(spark):
    passages = spark.createDataFrame([(1, "alpha beta", "a", [1.0, 0.0]), (2, "gamma", "b", [0.0, 1.0]),
                                      (3, "delta words here", "c", [0.7, 0.7])],
                                     "id bigint, text string, source string, embedding array<float>")
    asked = spark.createDataFrame([(1, "nothing shared", [1.0, 0.1]), (2, "gamma", [-1.0, 0.1])],
                                  "query_id bigint, text string, embedding array<float>")
    rows = {(r["query_id"], r["rank"]): r for r in rt.hybrid_top(asked, passages, 2).collect()}
    assert rows[1, 1]["id"] == 1 and rows[1, 1]["score"] == rows[1, 1]["similarity"] > 0.9
    assert rows[2, 1]["id"] == 2 and rows[2, 1]["score"] == pytest.approx(2 / 61, abs=1e-6)
    gates = {r["query_id"]: r["low_confidence"] for r in rt.cite(rt.hybrid_top(asked, passages, 2)).collect()}
    assert gates == {1: False, 2: True}
    assert all(r["low_confidence"] for r in rt.cite(rt.hybrid_top(asked, passages, 2), by="score").where("query_id = 2").collect())
    empty = passages.where("id < 0")
    assert rt.hybrid_top(asked, empty, 2).isEmpty()


def test_reranking_reorders_the_pool(spark):
    pool = hits(spark, [(1, 10, 1), (1, 11, 2), (1, 12, 3)])
    scores = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.9), (1, 12, 0.5)], "query_id bigint, id bigint, rerank_score double")
    assert [r["id"] for r in rt.rerank(pool, scores, 2).orderBy("rank").collect()] == [11, 12]


def test_graph_edges_are_undirected_and_unique(spark):
    rows = vectors(30, seed=5)
    passages = table(spark, rows).withColumn("text", F.lit("t")).withColumn("source", F.lit(None).cast("string"))
    expected = {}
    for i, near in brute(rows, rows, 3, 0.35, True).items():
        for j, s in near:
            expected[min(i, j), max(i, j)] = s
    found = {(r["source"], r["target"]): r["weight"] for r in rt.graph_edges(passages).collect()}
    assert found.keys() == expected.keys()
    assert rt.graph_nodes(passages).where("source = 'unknown'").count() == 30


def test_tasks_of_keyword_scores_grow_with_the_matches(spark, monkeypatch):
    passages = spark.createDataFrame([(i, f"common word{i % 7}") for i in range(400)], "id bigint, text string")
    asked = spark.createDataFrame([(q, f"common word{q}") for q in range(5)], "query_id bigint, text string")
    monkeypatch.setattr(rt, "POSTINGS_PER_TASK", 50)      # 2,000 matches of the common word and 286 of the others
    scores = rt.keyword_scores(asked, passages)
    assert scores.rdd.getNumPartitions() == 46 and scores.count() == 2_000


def test_visits_are_handed_on_in_bounded_slices(monkeypatch):
    monkeypatch.setattr(rt, "VISIT_ROWS", 7)
    open_ = np.random.default_rng(5).random((10, 6)) < 0.6
    units = np.array([bytes([i]) for i in range(10)], dtype=object)
    parts = list(rt._visits(np.arange(10), units, np.arange(100, 106), open_))
    assert max(map(len, parts)) == 7
    found = [(q, u, c) for p in parts for q, u, c in zip(p["query_id"], p["unit"], p["cell"])]
    assert found == [(q, units[q], 100 + c) for q, c in zip(*np.nonzero(open_))]


def test_best_of_some_queries_is_exact_at_any_block(monkeypatch):
    """Ties, ids that are null or repeated, NaN, and slices of a few pairs."""
    monkeypatch.setattr(rt, "QUERY_ROWS", 4)
    monkeypatch.setattr(rt, "PAIRS", 5)
    rng = np.random.default_rng(11)
    units = rt._unit(np.concatenate([rng.normal(size=(30, 6)), np.ones((200, 6)) + 1e-5 * rng.normal(size=(200, 6)), np.zeros((1, 6)), np.full((1, 6), np.nan)]))
    asked, n = units[[0, 1, 40, 230, 231]], 4
    ids = rng.integers(0, 150, len(units))
    nulls = rng.random(len(units)) < 0.05
    best = rt._Best(asked, n, np.full(len(asked), -np.inf))
    for start in range(0, len(units), 50):
        block = slice(start, start + 50)
        best.offer(np.arange(len(asked)), units[block], ids[block], nulls[block])
    for q in range(len(asked)):
        sims = np.round(asked[q] @ units.T, rt.RANK_DECIMALS)
        order = sorted((-s, not null, 0 if null else i) for s, i, null in zip(sims, ids, nulls) if not np.isnan(s))[:n]
        found = [(-s, not null, 0 if null else i) for s, i, null in zip(best.sims[q], best.ids[q] if len(order) else [], best.nulls[q])]
        assert found == order if order else (best.sims[q] == -np.inf).all()


def test_cells_write_nothing_that_grows_with_the_pairs(spark):
    """Vectors without clusters: every cell stays open to every query, yet a vector is written only once for each side."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(3000, 8)).tolist()
    shared = Path(shared_dir(spark))
    before = set(shared.rglob("*.parquet"))
    found = ranked(rt.dense_top(table(spark, rows, "query_id"), table(spark, rows), 3, broadcast_components=0))
    expected = brute(rows, rows, 3)
    assert {k: [j for j, _ in v] for k, v in found.items()} == {k: [j for j, _ in v] for k, v in expected.items()}
    assert sum(pq.read_metadata(p).num_rows for p in set(shared.rglob("*.parquet")) - before) <= 3000 + 3000 + 3 * 3000


def test_vectors_meet_in_a_store_that_only_spark_reads(spark, monkeypatch):
    monkeypatch.setattr(rt, "local_path", lambda *_: None)
    rows = vectors(60, seed=9, copies=5)
    found = ranked(rt.dense_top(table(spark, rows, "query_id"), table(spark, rows), 3, exclude_self=True, broadcast_components=0))
    assert {k: [j for j, _ in v] for k, v in found.items()} == {k: [j for j, _ in v] for k, v in brute(rows, rows, 3, exclude_self=True).items()}


def test_cells_keep_the_types_of_ids(spark):
    rows = [(f"p{i:02d}", [float(i % 5), 1.0, float(i)]) for i in range(12)] + [(None, [1.0, 1.0, 1.0])]
    passages = spark.createDataFrame(rows, "id string, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i}", v) for i, (_, v) in enumerate(rows)], "query_id string, embedding array<double>")
    by_scan, by_cells = (ranked(rt.dense_top(asked, passages.where("id IS NOT NULL"), 4, **limits)) for limits in ({}, {"broadcast_components": 0}))
    assert by_cells == by_scan
    assert ranked(rt.dense_top(asked, passages, 4, broadcast_components=0))["q12"][0] == (None, 1.0)
