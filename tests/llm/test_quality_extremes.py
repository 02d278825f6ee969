"""Each statistic of the quality rules can reject a text by itself."""

from __future__ import annotations

import random

from sievework.llm import op6_quality


def word(rnd):
    return "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 8)))


def test_lines_and_words_alone(spark):
    rnd = random.Random(4)
    clean = lambda n: [word(rnd) for _ in range(n)]
    rows = [(k, "\n".join(" ".join(clean(10)) for _ in range(12))) for k in range(300)]
    lines = [" ".join(clean(2)) for _ in range(30)]
    shuffled = [x for _ in range(5) for x in rnd.sample(lines, len(lines))]
    once = clean(80)
    rows += [(1000, "\n".join(shuffled)), (1001, "\n\n \n".join(shuffled)), (1002, " ".join(once + once[:9] + clean(2)))]
    got = {r.doc_id: r for r in op6_quality.judged(spark.createDataFrame(
        [(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[k].kept for k in range(300)) >= 298
    assert [(got[k].base_failed, got[k].kept) for k in (1000, 1001, 1002)] == [(False, False)] * 3
    assert abs(got[1000].distance - got[1001].distance) < 0.5       # blank lines do not hide copies
