"""Language identification of long texts and of many languages."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sievework.llm import op10_language

ROW = "doc_id long, text string, lang string"


def test_scores_are_those_of_the_plain_kernel():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(a) for _ in range(rnd.randint(1, 200))) for a in ("abcd ", "cdef ", "efgh ") for _ in range(6)] + ["", "zz", "a"]
    lists = [h for r, h in ((None, op10_language.grams([t])[1]) for t in texts)]
    seen = op10_language.presence(texts)
    assert op10_language.kernel_of(lists, lists[:5]) == pytest.approx(op10_language.kernel(seen, seen[:5].astype(np.float32)), abs=1e-6)
    names, known, per_gram = op10_language.fit(lists[:18], [n for n in "xyz" for _ in range(6)], 9)
    got = op10_language.scores(texts, known, per_gram)
    assert got.shape == (21, 3) and [names[k] for k in got[:18].argmax(1)] == [n for n in "xyz" for _ in range(6)]
    assert got[[4]] == pytest.approx(op10_language.scores([texts[4]], known, per_gram)) and not got[18].any()


def test_long_texts_keep_their_languages(spark):
    """Texts of 40,000 distinct n-grams and more: buckets that fill up would give one language to all."""
    def text(first, n, seed):
        rnd = random.Random(seed)
        return "".join(chr(first + rnd.randint(0, 999)) for _ in range(n))

    rows = [(k, text(0x4E00 + 500 * (k % 2), 300, k), "ab"[k % 2]) for k in range(80)]
    rows += [(1000 + k, text(0x4E00 + 500 * (k % 2), 20_000, 1000 + k), None) for k in range(6)]
    got = {r.doc_id: r.lang_pred for r in op10_language.identify(spark.createDataFrame(rows, ROW)).collect()}
    assert [got[1000 + k] for k in range(6)] == ["a", "b"] * 3


def test_all_languages_are_learned(spark):
    names = [f"l{k:03}" for k in range(70)]
    words = [chr(0x4E00 + 20 * k) * 2 + chr(0x4E01 + 20 * k) for k in range(70)]
    rows = [(70 * j + k, f"{words[k]} {words[k]}", names[k]) for j in range(4) for k in range(70)]
    got = {(r.doc_id % 70, r.lang_pred) for r in op10_language.identify(spark.createDataFrame(rows, ROW)).collect()}
    assert got == {(k, names[k]) for k in range(70)}


def test_one_row_of_a_sampled_identifier(spark, monkeypatch):
    """A thousand rows under one identifier are one text of the model."""
    seen = []
    fit = op10_language.fit
    monkeypatch.setattr(op10_language, "fit", lambda texts, *rest: (seen.append(len(texts)), fit(texts, *rest))[1])
    rows = [(0, "the and of this", "en")] * 1000 + [(0, "this of and the", "en"), (1, "und nicht das", "de"), (4, "oder der die", "de")]
    assert not any(r.held_out for r in op10_language.identify(spark.createDataFrame(rows, ROW)).collect())
    assert seen == [3]
