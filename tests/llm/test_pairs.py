"""Substring dedup, Jaccard join and decontamination against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import components, op2_substrings, op8_benchmark, op9_jaccard
from sievework.session import prepare

ROW = "doc_id long, text string, lang string, kept boolean, place string"


def frame(spark, texts):
    """Rows with extra columns named like some the operators make."""
    return spark.createDataFrame([(i, t, "en", True, "x") for i, t in texts], ROW)


def corpus(seed=3):
    """Short texts with exact copies, edited copies, shared passages, empty and null texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    passage, out = text(70), []
    bases = [text(rnd.randint(5, 200)) for _ in range(40)]
    for i in range(200):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 5, 20])):
            w[rnd.randrange(len(w))] = word()
        if rnd.random() < 0.2:
            at = rnd.randrange(len(w) + 1)
            w[at:at] = passage[rnd.randint(0, 15):]
        out.append(rnd.choice([" ", "\n", "\t "]).join(w).title() if rnd.random() < 0.3 else " ".join(w))
    return list(enumerate(out)) + [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "One two"), (905, None)]


def plain_cut(texts, window):
    first = {}
    words = {i: (t or "").encode().split() for i, t in texts}
    for i, w in sorted(words.items()):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    out = {}
    for i, w in words.items():
        covered = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                covered.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in covered)
        out[i] = (len(w), len(covered), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("window", [10, 50])
def test_cut_repeats(spark, window):
    texts = corpus()
    got = {r[0]: tuple(r)[1:] for r in op2_substrings.kept_digest(frame(spark, texts), window).collect()}
    assert got == plain_cut(texts, window)
    assert sum(v[1] for v in got.values()) > 0


def test_cut_repeats_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long), (5, long), (None, long), (7, long + " end"), (7, "other text"), (8, "w1 " * 5000)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in op2_substrings.cut_repeats(frame(spark, rows)).collect())
    assert got == [(False, 5, 60, 0), (False, 5, 60, 0), (False, 7, 2, 0), (False, 7, 61, 60), (False, 8, 5000, 0), (True, 0, 60, 0)]
    assert op2_substrings.cut_repeats(frame(spark, [])).count() == 0


def test_longer_repeats(spark):
    long = [f"w{i}" for i in range(130)]
    rows = [(1, " ".join(long)), (2, "a " + " ".join(long[:110])), (3, "b " + " ".join(long[20:75]))]
    got = {(r["length"], r.doc_id) for r in op2_substrings.longer_repeats(frame(spark, rows)).select("length", "doc_id").distinct().collect()}
    assert got == {(50, 1), (50, 2), (50, 3), (100, 1), (100, 2)}
    assert op2_substrings.longer_repeats(frame(spark, [])).count() == 0


def plain_groups(texts, size, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = (t or "").translate(lower).encode().split()
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size,percent,small,block,frequent", [(4, 85, 16, 512, 32), (5, 80, 2, 8, 2), (2, 60, 3, 16, 1)])
def test_similar_groups(spark, monkeypatch, size, percent, small, block, frequent):
    monkeypatch.setattr(op9_jaccard, "SMALL_GROUP", small)
    monkeypatch.setattr(op9_jaccard, "BLOCK", block)
    monkeypatch.setattr(op9_jaccard, "FREQUENT_LEAST", frequent)
    monkeypatch.setattr(op9_jaccard, "FREQUENT_DEVIATIONS", 0)
    texts = corpus(size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op9_jaccard.similar_groups(frame(spark, texts), size, percent).collect()}
    assert got == plain_groups(texts, size, percent)
    assert sum(i != c for i, (_, c) in got.items()) > 20


def test_signatures_lose_no_link():
    """Any two sets at the threshold share a signature, whatever is frequent."""
    import numpy as np

    rnd = np.random.default_rng(1)
    for _ in range(300):
        n = int(rnd.integers(7, 700))
        base = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        lose = int(len(base) * 0.15 * rnd.random())
        other = np.unique(np.concatenate([base[lose:], rnd.integers(0, 2**64, int(lose * rnd.random()), dtype=np.uint64)]))
        both = len(np.intersect1d(base, other))
        if 100 * both < 85 * (len(base) + len(other) - both):
            continue
        frequent = rnd.random(op9_jaccard.BUCKETS) < rnd.choice([0, 0.3, 0.9, 1])
        a, b = (op9_jaccard._signatures(x, frequent, 85) for x in (base, other))
        assert len(np.intersect1d(a, b))


def test_similar_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text), (3, text), (None, text), (2, text), (4, None), (4, text.upper()), (6, "")]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in op9_jaccard.similar_groups(frame(spark, rows), 4, 85).collect())
    assert got == [("2", 7, 2), ("3", 7, 2), ("3", 7, 2), ("4", 0, 4), ("4", 7, 2), ("6", 0, 6), ("None", 7, None)]
    kept = op9_jaccard.keep_first(frame(spark, rows), 4, 85)
    assert kept.columns == ["doc_id", "text", "lang", "kept", "place"]
    # 4 is one document by any of its texts; its empty text alone does not make it another
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "6", "None"]
    assert op9_jaccard.similar_groups(frame(spark, [])).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (9, 3), (20, 10), (10, 21), (7, 7), (30, 31), (32, 31), (33, 32), (34, 33), (35, 34)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 20: 10, 21: 10, **dict.fromkeys(range(30, 36), 30)}
    assert components.components(links.limit(0)).count() == 0


def plain_hits(texts, items, size, percent):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    cut = lambda w, k: {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    out = {}
    for j, t in items:
        w = words(t)
        k = min(size, len(w))
        for i, d in texts:
            found = len(cut(w, k) & cut(words(d), k)) if k else 0
            if k and 100 * found >= percent * len(cut(w, k)):
                out[i, j] = (len(cut(w, k)), found)
    return out


@pytest.mark.parametrize("scan_set", [50_000, 0])
def test_contaminated(spark, monkeypatch, scan_set):
    monkeypatch.setattr(op8_benchmark, "SCAN_SET", scan_set)
    texts = corpus(5)
    long = [t for _, t in texts if t and len(t.split()) > 60]
    items = [(k, " ".join(t.split()[10:10 + n]) + "!") for k, (t, n) in enumerate(zip(long, (3, 6, 12, 25, 40, 50)))]
    items += [(50, items[3][1]), (51, None), (52, ""), (53, "...")]
    got = op8_benchmark.contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in got.collect()} == plain_hits(texts, items, 5, 80)


def test_contaminated_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "so " * 3000 + item), (1, "so " * 3000 + item), (None, item), (2, "alpha beta gamma"), (3, None)]
    assert [tuple(r) for r in op8_benchmark.contaminated(frame(spark, rows), items).collect()] == [(1, 1, 3, 3, 1.0)]
    kept = op8_benchmark.drop_contaminated(frame(spark, rows), items)
    assert kept.columns == ["doc_id", "text", "lang", "kept", "place"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "None"]
    assert op8_benchmark.contaminated(frame(spark, rows), items.limit(0)).count() == 0
    assert op8_benchmark.contaminated(frame(spark, []), items).count() == 0


def test_regular_words_and_texts(spark):
    """Sequences and words that agree in every sum of powers are still told apart."""
    for n in (1024, 2048):
        odd = [bin(i).count("1") & 1 for i in range(n)]
        one, other = (" ".join("no yes".split()[x ^ flip] for x in odd) for flip in (0, 1))
        long, lengthy = ("".join("ab"[x ^ flip] for x in odd) for flip in (0, 1))
        head = " ".join(f"w{k}" for k in range(49))
        texts = [(1, one), (2, other), (3, f"{head} {long}"), (4, f"{head} {lengthy}"), (5, f"x y z {long}"), (6, f"x y z {lengthy}")]
        cut = {r[0]: tuple(r)[1:] for r in op2_substrings.kept_digest(frame(spark, texts), 50).collect()}
        assert cut == plain_cut(texts, 50)
        assert {r[0]: tuple(r)[1:] for r in op9_jaccard.similar_groups(frame(spark, texts), 4, 85).collect()} == plain_groups(texts, 4, 85)


def test_texts_reach_python_in_batches_bounded_in_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    texts = prepare(spark).range(0, 3000, 1, 1).select(F.lpad(F.col("id").cast("string"), 10_000, "x").alias("text"))
    got = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 30_000_000 and max(got) < 8_000_000
