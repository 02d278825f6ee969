from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import accounting as ac
from sievework.operators import conversations as cv

SCHEMA = "conv_id bigint, turn bigint, role string, text string, orphan boolean"


def conversation(spark, sizes, orphans=(), conv=1):
    rows = [(conv, i, "user" if i % 2 == 0 else "assistant", "x" * n, i in orphans) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("turns, orphans, split", [
    (4, (), 0), (6, (), 0), (10, (), 4), (10, (4,), 3), (10, (3, 4), 2), (10, (0, 1, 2, 3, 4), 0)])
def test_safe_split(spark, turns, orphans, split):
    row = cv.recent_starts(conversation(spark, [1] * turns, orphans)).first()
    assert (row["n_turns"], row["split_turn"]) == (turns, split)


def kept_by_dropping(sizes, orphans, cap):
    """The budget rule, one message at a time."""
    if sum(sizes) < 3 * cap or sum(sizes) <= 4 * cap:
        return 0
    head = 0
    while head < len(sizes) - 1:
        head += 1
        while head < len(sizes) - 1 and head in orphans:
            head += 1
        if sum(sizes[head:]) <= 4 * cap:
            break
    return head


@pytest.mark.parametrize("seed", range(12))
def test_trim_matches_dropping_one_by_one(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(cv, "BLOCK", 3)
    sizes = [rng.choice([0, 5, 20, 60]) for _ in range(rng.randint(1, 25))]
    orphans = {i for i in range(len(sizes)) if rng.random() < 0.3}
    cap = rng.choice([1, 10, 30, 60, 200])
    row = cv.trim_starts(conversation(spark, sizes, orphans), cap).first()
    assert row["first_turn"] == kept_by_dropping(sizes, orphans, cap)


def test_many_conversations_are_trimmed_apart(spark):
    both = conversation(spark, [50] * 10).unionByName(conversation(spark, [1] * 3, conv=2))
    kept = cv.trim_to_budget(both, 25).groupBy("conv_id").count().orderBy("conv_id").collect()
    assert [tuple(r) for r in kept] == [(1, 2), (2, 3)]


def fitted(sizes, orphans, summary, cap, keep):
    """The budget decision, one conversation at a time: action, then positions that stay."""
    turns = list(range(len(sizes)))
    if sum(sizes) <= 4 * cap:
        return "keep", turns
    split = max(0, len(sizes) - keep)
    while split and split in orphans:
        split -= 1
    if not split or not (summary or "").strip():
        return "trim", turns[kept_by_dropping(sizes, orphans, cap):]
    positions = [-2, -1] + turns[split:]
    pair = [len(cv.SUMMARY_NOTE % (split, summary)), len(cv.SUMMARY_REPLY)]
    head = kept_by_dropping(pair + sizes[split:], {positions.index(t) for t in orphans if t >= split}, cap)
    return ("condense_trim" if head else "condense"), positions[head:]


def test_budget_decisions_match_one_by_one(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(cv, "BLOCK", 3)
    rows, summaries, wanted = [], [], {}
    for conv in range(80):
        sizes = [rng.choice([0, 20, 90, 200]) for _ in range(rng.randint(1, 14))]
        orphans = {i for i in range(len(sizes)) if rng.random() < 0.3}
        summary = rng.choice([None, "  ", "s" * 10, "s" * 150])
        rows += [(conv, i, "user" if i % 2 == 0 else "assistant", "x" * n if n else None, i in orphans) for i, n in enumerate(sizes)]
        summaries += [(conv, summary)] if rng.random() < 0.9 else []
        wanted[conv] = fitted(sizes, orphans, summary if summaries and summaries[-1][0] == conv else None, 60, 3)
    got = {}
    out = cv.fit_to_budget(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(summaries, "conv_id bigint, summary string"), 60, 3)
    for r in out.orderBy("conv_id", "position").collect():
        got.setdefault(r["conv_id"], (r["action"], []))[1].append(r["position"])
    assert got == wanted
    assert {a for a, _ in got.values()} == {"keep", "condense", "condense_trim", "trim"}
    assert cv.fit_to_budget(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "conv_id bigint, summary string"), 60).count() == 0


def test_messages_of_blocks(spark):
    cases = [
        ("user", '"plain"', "plain", False), ("user", None, "", False), ("user", "{broken", "", False), ("user", "[]", "", False),
        ("user", "7", "7", False), ("user", '{"b":1}', '{"b":1}', False), (None, '[{"type":"tool_result"}]', "[tool result: ]", False),
        ("user", '[{"type":"tool_result","content":"%s"}, 3, null, {"type":"text"}]' % ("r" * 201), "[tool result: " + "r" * 200 + "…]", True),
        ("assistant", '[{"type":"text","text":"a"},{"type":"tool_use","name":"f"},{"type":"tool_use"},{"type":"image"}]',
         "a\n[called tool: f]\n[called tool: ?]\n[image]", False),
        ("assistant", '[{"type":"tool_result","content":[1,{"k":2}]}]', '[tool result: [1,{"k":2}]]', False)]
    rows = [(1, i, role, content, "old") for i, (role, content, _, _) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content string, text string")
    for given in (frame, frame.withColumn("content", F.try_parse_json("content"))):
        got = cv.from_content(given).orderBy("turn").collect()
        assert [(r["text"], r["orphan"]) for r in got] == [(text, orphan) for _, _, text, orphan in cases]
    assert cv.recent_starts(cv.from_content(frame), 3).first()["split_turn"] == 6


def test_transcript_parts_and_lines(spark):
    parts = cv.transcripts(conversation(spark, [1, 2, 3]), lines_per_part=2).orderBy("part").collect()
    assert [p["transcript"] for p in parts] == ["USER: x\n\nASSISTANT: xx", "USER: xxx"]


def test_condense(spark):
    messages = conversation(spark, [1] * 10).unionByName(conversation(spark, [1] * 2, conv=2)).drop("orphan")
    summaries = spark.createDataFrame([(1, "gist"), (2, "unused")], "conv_id bigint, summary string")
    rows = cv.condense(messages, summaries).orderBy("conv_id", "position").collect()
    assert [r["position"] for r in rows if r["conv_id"] == 1] == [-2, -1, 4, 5, 6, 7, 8, 9]
    assert rows[0]["text"] == "[Summary of 4 earlier turns]\n\ngist" and rows[1]["role"] == "assistant"
    assert [r["position"] for r in rows if r["conv_id"] == 2] == [0, 1]


def test_critique(spark):
    pairs = spark.createDataFrame([
        ("q", "I don't know", ""), ("q" * 100, "A long and complete answer that explains everything.", ""),
        ("q" * 100, "A long and complete answer that explains everything.", "wrong")],
        "question string, answer string, feedback string")
    rows = cv.critique(pairs).collect()
    assert [r["rating"] for r in rows] == [4, 6, 4]
    assert rows[0]["weaknesses"] == [cv.GAVE_UP, cv.THIN] and rows[1]["weaknesses"] == [cv.NO_CRITIC]
    assert rows[2]["weaknesses"] == [cv.FLAGGED + "wrong"] and "q" * 80 + "'" in rows[2]["lesson"]
    assert ac.new_lessons(cv.critique(pairs)).count() == 3


def test_gates_count_absent_scores_as_zero(spark):
    scores = spark.createDataFrame([(1, "faithfulness", 0.9), (1, "relevance", None), (2, "faithfulness", 0.8)],
                                   "example_id bigint, metric string, score double")
    failures = {(r["example_id"], r["gate"]) for r in ac.gate_failures(scores).collect()}
    assert failures == {(1, "relevance"), (2, "relevance")}
    summary = ac.gate_summary(scores).first()
    assert (summary["n_examples"], summary["n_failures"], summary["passed"]) == (2, 2, False)
    means = {r["metric"]: (r["mean"], r["n_scored"]) for r in ac.metric_means(scores).collect()}
    assert means["relevance"] == (None, 0) and means["faithfulness"][0] == pytest.approx(0.85)


def test_lesson_search_and_digest(spark):
    lessons = spark.createDataFrame([(i, f"2024-01-0{i}", t, "") for i, t in enumerate(
        ["check sources", "verify checks twice", "be brief"], 1)], "lesson_id bigint, ts string, lesson string, question string")
    assert [r["lesson_id"] for r in ac.search_lessons(lessons, "Check and VERIFY it").collect()] == [2, 1]
    assert ac.lesson_digest(lessons, 2).first()["digest"] == "(1) verify checks twice; (2) be brief"
    assert ac.search_lessons(lessons, "a an it").isEmpty()


def test_latest_note_wins(spark):
    log = spark.createDataFrame([("a", "1", 1, 1), ("a", "2", 2, 2), ("a", "3", 2, 3), ("b", "x", 1, 4)],
                                "key string, value string, updated_at int, seq int")
    assert [(r["key"], r["value"]) for r in ac.notes_listing(log).collect()] == [("a", "3"), ("b", "x")]


def test_default_price_and_totals(spark):
    usage = spark.createDataFrame([("m", 1_000_000, 0, 1, 2), ("other", 0, 1_000_000, 3, 4)],
                                  "model string, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_write bigint")
    pricing = spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_price double, output_price double")
    costs = {r["model"]: r["cost_usd"] for r in ac.cost_summary(usage, pricing).collect()}
    assert costs == {"m": 1.0, "other": 15.0, ac.TOTAL: 16.0}
    totals = {r["model"]: r for r in ac.usage_totals(usage).collect()}
    assert totals[ac.TOTAL]["cache_read"] == 4 and totals["m"]["cache_read"] is None
