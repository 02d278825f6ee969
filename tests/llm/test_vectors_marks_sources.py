"""Centroids, SimHash and source divergence against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from sievework.llm import op11_centroids, op12_simhash, op13_divergence

DOCS = "doc_id long, text string, lang string, source string, mark string, cell long, value long"


def plain_clusters(rows, k, dims, rounds, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept]
    centres = [v for _, v in sorted(named)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if groups[n] else c for n, c in enumerate(centres)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, n, d in found:
        inertia[n] += d
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), tuple(centres[n])) for i, n, d in found), key=str)


@pytest.mark.parametrize("k,rounds", [(3, 4), (8, 10), (40, 2)])
def test_clusters(spark, k, rounds):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(i % 5, 0.3) for _ in range(4)]) for i in range(60)]
    rows += [(7, rows[7][1]), (8, [0.5, -0.5, 0.25, -0.25]), (None, [1.0, 2.0, 3.0, 4.0]), (90, None), (91, []), (92, [1.0, 2.0, 3.0]),
             (93, [1.0, None, 2.0, 3.0]), (94, [math.nan, 0.0, 0.0, 0.0]), (95, [math.inf, 0.0, 0.0, 0.0])] + [(100 + i, [-1.0] * 4) for i in range(30)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, x string").repartition(3)
    got = op11_centroids.clustered(df, k, 4, rounds, 16, 3).collect()
    assert sorted(((*r[:5], tuple(r.centroid)) for r in got), key=str) == plain_clusters(rows, k, 4, rounds, 16, 3)


def test_clusters_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0]), (2, [5.0, 5.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[1:3] for r in op11_centroids.clustered(df, dims=2).orderBy("vec_id").collect()] in ([(0, 0), (1, 0)], [(1, 0), (0, 0)])
    none = op11_centroids.clustered(df, dims=3)
    assert none.count() == 0 and none.columns == op11_centroids.clustered(df, dims=2).columns
    with pytest.raises(Exception, match="too large"):
        op11_centroids.clustered(spark.createDataFrame([(1, [1e30, 1.0])], "vec_id long, embedding array<double>"), dims=2).collect()


def plain_mark(text, size):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    nodes, seen, out = sorted(nodes), set(), {}
    for n in nodes:
        if n not in seen:
            seen.add(n)
            open_ = [n]
            while open_:
                x = open_.pop()
                out[x] = n
                new = [y for y in nodes if y not in seen and linked(x, y)]
                seen.update(new)
                open_ += new
    return out


@pytest.mark.parametrize("size", [1, 2, 4])
def test_fingerprint(monkeypatch, size):
    monkeypatch.setattr(op12_simhash, "PIECE_BYTES", 7)
    rng = random.Random(size)
    for n in (0, 1, 2, 3, 4, 5, 40, 333):
        text = "".join(rng.choice(["a", "Bé", "Ä", "zzz", " x", "\U0001F600"]) + rng.choice([" ", "\t\n", "\x0b", "\r "]) for _ in range(n))
        assert op12_simhash.fingerprint(text.encode(), size) == plain_mark(text, size)


def test_labels(spark):
    """Random fingerprints, chains of neighbours and a dense group, against all pairs."""
    rng = random.Random(5)
    flip = lambda m, k: m ^ sum(1 << b for b in rng.sample(range(64), k))
    marks = {0, (1 << 64) - 1, 1 << 63, *(rng.getrandbits(64) for _ in range(100))}
    for base in list(marks)[:40]:
        for _ in range(4):
            base = flip(base, rng.choice([1, 2, 3, 4, 4, 5, 6]))
            marks.add(base)
    centre = rng.getrandbits(64)
    marks |= {flip(centre, rng.randint(1, 6)) for _ in range(150)}
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    df = spark.createDataFrame([(signed(m),) for m in marks], "mark long")
    for most in (0, 1, 4, 5):
        want = plain_components(marks, lambda x, y: (x ^ y).bit_count() <= most)
        got = {r.mark: r.label for r in op12_simhash._labels(df, most).collect()}
        groups = defaultdict(set)
        for m in marks:
            groups[got.get(signed(m), signed(m))].add(m)
        expected = defaultdict(set)
        for m, root in want.items():
            expected[root].add(m)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_near_groups(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choices("one two Three four five six SEVEN eight nine ten".split(), k=80)) for _ in range(6)]
    rows = [(i, rng.choice(base) + rng.choice(["", " eight", " x"]), "en") for i in range(40)]
    rows += [(50, None, "en"), (51, "", None), (52, " \n", "de"), (53, "one", "de"), (54, "ONE", "de"), (None, "one", "en"), (3, rows[3][1], "en"),
             (4, "another text under this number", "en")]
    df = spark.createDataFrame([(i, t, lang, "s", "m", 1, 2) for i, t, lang in rows], DOCS)
    marks = [(i, plain_mark(t, 4)) for i, t, _ in rows]
    links = plain_components({m for i, m in marks if i is not None}, lambda x, y: (x ^ y).bit_count() <= 4)
    least = {}
    for i, m in marks:
        if i is not None:
            least[links[m]] = min(i, least.get(links[m], i))
    want = sorted(((i, f"{m:016x}", None if i is None else least[links[m]]) for i, m in marks), key=str)
    assert sorted((tuple(r) for r in op12_simhash.near_groups(df).collect()), key=str) == want
    assert op12_simhash.near_groups(df.limit(0)).count() == 0


def plain_audit(rows, least_docs, upto):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least_docs}
        sources = sorted(s for g, s in groups if g == lang)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // total for t in kept}
        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pair = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, upto)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(found)[:limit])]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)] + ["Ünder", "naïve", "日本", "\U0001F600x", "Zed"]
    rows = [(" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60))) + rng.choice(["", ". 12,a_b"]),
             rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", "s3", None])) for _ in range(120)]
    rows += [(None, "en", "bare"), ("", "fr", "a"), ("...", "fr", "b"), ("alone alone", "it", "a"), ("rare words here", "pt", "a"), ("rare", "pt", "b")]
    df = spark.createDataFrame([(None, t, lang, s, "m", 1, 2) for t, lang, s in rows], DOCS).repartition(4)
    for least_docs, upto in ((3, 200), (1, 5), (2, 12)):
        assert sorted(tuple(r) for r in op13_divergence.audit(df, least_docs, upto).collect()) == plain_audit(rows, least_docs, upto)
    assert op13_divergence.audit(df.limit(0)).count() == 0


def test_terms_are_dealt_out_once(spark):
    """One row an occurrence, which also says whether it is the first of its document; no second list of distinct terms."""
    docs = spark.createDataFrame([("e", "s", "A b a"), ("e", "s", "a"), ("e", None, None)], "lang string, source string, text string")
    found = op13_divergence.term_counts(docs)
    assert sorted(map(tuple, found.collect())) == [("e", "s", "a", 3, 2), ("e", "s", "b", 1, 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1


def test_shares_are_exact_on_both_sides_of_the_long_limit(spark):
    counts, n, v = [0, 1, 8_999_999_999, 9_000_000_000, 4_000_000_000_000_000_000], 4_100_000_000_000_000_000, 7
    df = spark.createDataFrame([(c, n, v) for c in counts], "c long, n long, v long")
    got = [r[0] for r in df.select(op13_divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 1_000_000_000 * (c + 1) // (n + v) for c in counts]
    assert op13_divergence._FITS * op13_divergence.SCALE <= 2 ** 63 - 1


def test_pairs_of_sources_keep_both_directions(spark):
    rows = [("en", s, " ".join(w)) for s, w in [("a", ["x"] * 5 + ["y"]), ("b", ["x", "y", "y"]), ("c", ["x", "z"]), ("a", ["z", "y"]), ("b", ["z"] * 4)]]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    got = {(r["source"], r["item"]): r["value"] for r in op13_divergence.audit(df).where("part = 'pair'").collect()}
    words = {s: [w for _, t, x in rows if t == s for w in x.split()] for s in "abc"}
    p = {s: {w: 1 + 10 ** 9 * (ws.count(w) + 1) // (len(ws) + 3) for w in "xyz"} for s, ws in words.items()}
    assert got == {(s, o): sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in "xyz") for s in "abc" for o in "abc" if s != o}
