"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import catalog, op8_benchmark, op9_jaccard
from sievework.sources.tables import table

from .. import oracle
from .test_pairs import plain_cut, plain_groups, plain_hits
from .test_texts import plain_quality, plain_secrets


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLE_SQL:
        assert oracle.differences(df, con, catalog.ORACLE_SQL[name]) == []
    elif name != "op8_decontamination":
        of = "pages" if "op7" in name else "documents"
        assert df.count() == table(spark, sf_dir, of).count()


def test_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
    assert all(name.startswith("op") for name in catalog.ORACLE_SQL)


def test_whole_tables_against_plain_versions(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    run = lambda name: catalog.QUERIES[name](spark, sf_dir).collect()
    assert {r[0]: tuple(r)[1:] for r in run("op2_substring_dedup")} == plain_cut(docs, 50)
    assert {r[0]: tuple(r)[1:] for r in run("op9_jaccard_join")} == plain_groups(docs, 4, 85)
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert {(r[0], r[1]): (r[2], r[3]) for r in run("op8_decontamination")} == plain_hits(docs, items, 5, 80)


def test_stages(spark, sf_dir):
    """Each stage on what the one before kept, against plain versions of their rules."""
    docs, before = table(spark, sf_dir, "documents"), None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else before
        docs = stage(spark, docs, sf_dir).cache()
        after = {r.doc_id: r for r in docs.collect()}
        if name == "quality rules":
            assert not any(plain_quality(before[i])[-1] for i in after) and len(after) > 0.7 * len(before)
        elif name == "n-gram Jaccard join":
            assert set(after) == {i for i, (_, c) in plain_groups(before.items(), 5, 80).items() if i == c}
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
            assert set(after) == set(before) - {i for i, _ in plain_hits(before.items(), items, 5, 80)}
        elif name == "secret scans":
            assert set(after) == set(before) and not any(plain_secrets(r.text) for r in after.values())
            assert all(after[i].text == t for i, t in before.items() if not plain_secrets(t))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        else:
            assert set(after) == set(before) and all(r.n_pieces == len(r.ids) for r in after.values())


def test_run_is_its_stages(spark, sf_dir):
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.count() == whole.select("doc_id").distinct().count() > 0
    hurt = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 7 > 0, F.col("text"))).limit(60)
    for _, stage in corpus_pipeline.STAGES:
        hurt = stage(spark, hurt, sf_dir)
    assert hurt.count() > 0
    none = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf_dir)
    assert none.count() == 0


def test_operators_take_other_thresholds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    strict = op9_jaccard.similar_groups(docs, 5, 95).where("doc_id <> component_id").count()
    loose = op9_jaccard.similar_groups(docs, 5, 60).where("doc_id <> component_id").count()
    assert strict <= loose
    items = table(spark, sf_dir, "benchmark")
    assert op8_benchmark.contaminated(docs, items, percent=40).count() >= op8_benchmark.contaminated(docs, items).count()
