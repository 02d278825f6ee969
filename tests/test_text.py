"""Cell rewrites and predicates on hand-made values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievework.functions import payload as pl
from sievework.functions import text as tx
from sievework.operators import profile as pf
from sievework.operators import chunking as ck
from sievework.operators import conversations as cv
from sievework.operators import repair as rp


def values(spark, expression, *cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("c"))).collect()]


def test_numbers_from_text(spark):
    cells = ["$1,200.50", "(1,200)", "12%", "12d", "1e3", "Infinity", "-", ".", "--5", "nan", "", None, "5.", ".5"]
    assert values(spark, tx.to_number, *cells) == [1200.5, 1200.0, 12.0, 12.0, 13.0, None, None, None, None, None, None,
                                                   None, 5.0, 0.5]


def test_plain_numbers(spark):
    cells = ["12", " 12 ", "1e3", "-4.5", "+4", "12d", "Infinity", "nan", "", None]
    assert values(spark, tx.parse_number, *cells) == [12.0, 12.0, 1000.0, -4.5, 4.0, None, None, None, None, None]


def test_strip_removes_every_kind_of_blank(spark):
    assert values(spark, tx.norm_key, "\tc1\n", " C1　", "c1", "straße", None) == [
        "C1", "C1", "C1", "STRASSE", None]


def test_dates_in_any_format(spark):
    cells = ["2021-03-05", "03/05/2021", "13/05/2021", "5 Mar 2021", "Mar 5, 2021", "2021-03-05T10:00:00",
             "2021/03/05", "2024-02-30", "soon", None]
    assert values(spark, tx.to_iso, *cells) == [
        "2021-03-05", "2021-03-05", "2021-05-13", "2021-03-05", "2021-03-05", "2021-03-05", "2021-03-05", "2024-02-30",
        "soon", None]


def test_three_formats_are_rewritten_without_a_calendar(spark):
    cells = ["99/13/2021", "5 Mar 2021", "5 Xyz 2021", " 2021-01-02 ", "1/2/2021", "soon", None]
    assert values(spark, tx.rewrite_date, *cells) == [
        "2021-99-13", "2021-03-05", "5 Xyz 2021", "2021-01-02", "1/2/2021", "soon", None]


def test_date_styles(spark):
    assert values(spark, tx.date_style, "2021-01-02", "01/02/2021", "2 Jan 2021", "Jan 2", None) == [
        "ISO (YYYY-MM-DD)", "US (MM/DD/YYYY)", "Text (DD Mon YYYY)", "Unknown", None]


@pytest.mark.parametrize("rule, yes, no", [
    (tx.is_currency, ["$1,200.00", " £5", "€ 7."], ["5", "USD 5", "$"]),
    (tx.is_percent, ["5%", "5.5 %"], ["5", "%"]),
    (tx.is_comma_number, ["1,200", "12,345,678.9"], ["1200", "12,34"]),
    (tx.is_dollar_only, ["$5", " $1,000.5 "], ["£5", "$ 5"]),
    (tx.is_percent_tight, ["5%"], ["5 %"]),
    (tx.is_plain_number, ["-5", " 5.25 "], ["1e3", "5."]),
    (tx.is_date_or_time, ["2021-01-02", "2021-01-02T10:00", "2021-01-02 10:00:05"], ["01/02/2021"]),
    (tx.is_missing_word, ["", "nan", "<NA>", "None", None], ["null", "x"]),
    (tx.is_messy_number, [" 5", "$5", "1e3"], ["5", "-5.0"]),
    (tx.is_noisy_key, [" C1", "c1"], ["C1"]),
])
def test_predicates(spark, rule, yes, no):
    found = values(spark, rule, *yes, *no)
    assert found == [True] * len(yes) + [False] * len(no)


def test_state_dictionary(spark):
    assert values(spark, rp.canonical_category, "Ca", " california ", "New York", "tx", "Ohio", None) == [
        "CA", "CA", "NY", "TX", "OHIO", None]


@pytest.mark.parametrize("n, chunks", [(0, 0), (1, 1), (448, 1), (449, 2), (512, 2), (513, 2), (600, 2), (1000, 3)])
def test_word_chunk_counts(spark, n, chunks):
    text = " ".join(str(i) for i in range(n))
    found = values(spark, ck.word_chunks, text)[0]
    assert len(found) == chunks
    if n > 448:
        assert found[1].split()[0] == "448"
        assert all(len(c.split()) <= 512 for c in found)


def test_word_chunks_overlap(spark):
    text = " ".join(str(i) for i in range(100))
    found = values(spark, lambda c: ck.word_chunks(c, 50, 10), text)[0]
    assert found[1].startswith("40 ") and values(spark, ck.word_chunks, "  \n ", None) == [[], []]


@pytest.mark.parametrize("n, chunks", [(0, 1), (1, 1), (2000, 1), (2001, 2), (3800, 2), (3801, 3)])
def test_char_chunks_cover_the_text(spark, n, chunks):
    text = "".join(chr(97 + i % 26) for i in range(n))
    found = values(spark, ck.char_chunks, text)[0]
    assert len(found) == chunks
    assert found[0] + "".join(c[200:] for c in found[1:]) == text


def test_message_parts(spark):
    text = "x" * 5000
    assert [len(p) for p in values(spark, ck.message_parts, text)[0]] == [4096, 904]
    assert values(spark, ck.message_parts, "")[0] == [""]


def test_objects_inside_answers(spark):
    cells = ['```json\n{"a": 1}\n```', 'Sure: {"a": {"b": 2}} done', "no braces", "{bad", '{"a":1} and {"b":2}', None]
    assert values(spark, pl.extract_object, *cells) == ['{"a": 1}', '{"a": {"b": 2}}', None, None, None, None]


def test_payload_envelopes(spark):
    cells = ['{"a":1}', "[1,2]", "5", "{bad", "", None, "x" * (1024 * 1024 + 1)]
    kinds = values(spark, pl.payload_kind, *cells)
    assert kinds == ["object", "payload", "payload", "raw", "empty", "empty", "too_large"]
    assert values(spark, pl.payload_kind, " null ", "1,2", "1],[2", '{"a":1} x', ' {"a":[]}\n') == [
        "payload", "raw", "raw", "raw", "object"]
    wrapped = values(spark, lambda c: pl.envelope(c, pl.payload_kind(c)), *cells)
    assert wrapped == ['{"a":1}', '{"payload":[1,2]}', '{"payload":5}', '{"raw":"{bad"}', "{}", "{}", None]


def test_message_blocks_as_text(spark):
    schema = "blocks array<struct<type: string, text: string, name: string, content: string>>"
    blocks = [("text", "hello", None, None), ("tool_use", None, "search", None),
              ("tool_result", None, None, "r" * 250), ("image", None, None, None), ("other", None, None, None)]
    df = spark.createDataFrame([(blocks,)], schema)
    row = df.select(cv.block_text(F.col("blocks")), cv.has_tool_result(F.col("blocks"))).first()
    assert row[0] == "hello\n[called tool: search]\n[tool result: " + "r" * 200 + "…]\n[image]"
    assert row[1] is True


def test_visible_ends_are_left_alone_and_blanks_of_any_kind_go(spark):
    cells = [None, "", " ", "a", " a", "a ", "　a　", "\xa0é\x85", "é", "~", "\x7f a\x7f", "!\t", "a\x1f", "日本 ", "x y", "\x00a\x00"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = df.select(tx.strip(F.col("c")).alias("now"), F.btrim("c", F.lit(tx.WHITE_SPACE)).alias("all")).collect()
    assert [r["now"] for r in got] == [r["all"] for r in got]
    # the slow search is reached by a condition only
    assert "CASE WHEN" in df.select(tx.strip(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()


def test_dates_read_as_by_formatters(spark):
    cells = ["2024-02-29", "2023-02-29", "2024-2-9", "0000-01-01", "0999-12-31", "2024/02/30", "2024/2/3", "02/29/2024", "2/3/2024", "13/01/2024",
             "31/02/2024", "00/01/2024", "13/13/2024", "5 Mar 2024", "5 mar 2024", "31 Feb 2024", "Mar 5, 2024", "2024-01-01T10:00", "2024-01-01 10:00:00.5",
             "2024-13-01 10:00", " 01/02/2024 ", "2024-01", "2024", "1/2/24", "a/b/2024", "/", "", "+12024-01-01", "1582-10-10", None, "9999-12-31"]
    formats = [(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
               (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy")]
    bare = F.btrim("c")
    tries = [F.when(bare.rlike(shape), F.try_to_date(bare, fmt)) for shape, fmt in formats]
    timed = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"), F.try_to_date(F.substring(bare, 1, 10), "yyyy-MM-dd"))
    plain = F.coalesce(F.date_format(F.coalesce(*tries, timed), "yyyy-MM-dd"), F.col("c"))
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] == r[1] for r in df.select(tx.to_iso(F.col("c")), plain).collect()] == [True] * len(cells)


def test_conditions_are_counted_inside_the_aggregate(spark):
    df = spark.createDataFrame([("1",), (None,), ("x",)], "c string")
    counted = df.agg(*[a.alias(n) for n, a in pf.kind_measures("a date", F.col("c")).items()], tx.count_where(F.col("c") == "x").alias("x"))
    assert "_common_expr" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert counted.first()["x"] == 1
