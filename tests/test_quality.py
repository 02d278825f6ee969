"""Profiles, scores, repairs and the trust-routed loop."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from sievework.operators import order_stats
from sievework.operators import profile as pf
from sievework.operators import repair as rp
from sievework.operators import score as sc
from sievework.plans import reports, single_table, two_table

CUSTOMERS = "customer_id string, name string, state string, signup_date string, email string"
ORDERS = "order_id string, customer_id string, amount string, order_date string, status string"


@pytest.fixture(scope="module")
def seeded(spark):
    """Two hundred customers and five hundred orders with a known number of each defect."""
    dates = [lambda i: f"2021-01-{i % 28 + 1:02d}", lambda i: f"01/{i % 28 + 1:02d}/2021", lambda i: f"{i % 28 + 1} Jan 2021"]
    states = ["CA", "Ca", "california", "NY", "New York", "tx", "Texas"]
    customers = [[f"C{i:03d}", f"Customer {i}", states[i % 7], dates[i % 3](i),
                  f"customer{i}@example.com" if i % 13 else None] for i in range(1, 201)]
    customers += [list(customers[i]) for i in (5, 42, 99, 150)]
    for i, key in ((10, " C011 "), (20, "c021"), (30, "C031 ")):
        customers[i][0] = key
    customers[7][1], customers[88][1] = None, ""
    amounts = [lambda i: f"{i + 0.5:.2f}", lambda i: f"${i + 1000.5:,.2f}", lambda i: f"  {i + 0.25:.2f} "]
    statuses = ["shipped", "Shipped", "SHIPPED", "pending", "Pending", "cancelled"]
    orders = [[f"O{j:04d}", f"C{900 + j % 90}" if j % 17 == 0 else f"C{j % 200 + 1:03d}", amounts[j % 3](j),
               dates[j % 3](j), statuses[j % 6]] for j in range(1, 501)]
    orders += [list(orders[i]) for i in (3, 77, 200, 333, 400)]
    orders[15][2], orders[250][2] = None, ""
    return (spark.createDataFrame([tuple(r) for r in customers], CUSTOMERS),
            spark.createDataFrame([tuple(r) for r in orders], ORDERS))


def test_seeded_scenario_has_the_known_defects(seeded):
    customers, orders = seeded
    missing = {r["column"]: r["n_missing"] for r in pf.missing_counts(customers).collect()}
    assert (missing["email"], missing["name"]) == (15, 2)
    assert pf.duplicate_counts(customers).first()["n_duplicates"] == 4
    assert pf.duplicate_counts(orders).first()["n_duplicates"] == 5
    assert two_table.noisy_keys(customers).count() == 3
    summary = two_table.orphan_summary(orders, customers).first()
    assert (summary["orders_total"], summary["orphaned_orders"], round(summary["orphan_pct"], 2)) == (505, 29, 5.74)
    scores = sc.scorecard(customers, orders).first()
    assert [round(scores[d], 1) for d in ("completeness", "uniqueness", "integrity", "key_hygiene")] == [
        99.8, 98.7, 94.3, 99.6]


def test_seeded_scenario_is_repaired(seeded):
    fixed = two_table.repair(*seeded)
    assert (fixed.customers.count(), fixed.orders.count(), fixed.quarantine.count()) == (200, 471, 29)
    after = sc.scorecard(fixed.customers, rp.project(fixed.orders, amount=F.col("amount").cast("string"))).first()
    assert after["overall"] == 100.0
    log = {(r["step"], r["column"]): r["n_changed"] for r in fixed.changelog().collect()}
    assert log[1, "customer_id"] == 3 and log[5, "amount"] == 2 and log[7, "customer_id"] == 29
    assert log[6, "name"] == 2


def test_repair_of_repaired_tables_changes_nothing(seeded):
    fixed = two_table.repair(*seeded)
    texts = rp.project(fixed.orders, amount=F.col("amount").cast("string"))
    again = two_table.repair(fixed.customers, texts)
    assert again.customers.exceptAll(fixed.customers).isEmpty() and again.orders.exceptAll(fixed.orders).isEmpty()
    assert again.quarantine.isEmpty()


def test_scorecard_text(seeded):
    lines = reports.scorecard_lines(two_table.before_after(*seeded), [*sc.DIMENSIONS, "overall"]).orderBy("position")
    assert lines.collect()[-1]["line"].split()[0] == "overall" and lines.collect()[-1]["line"].endswith("100.0")


def test_null_keys_are_orphans_when_repairing_only(spark):
    customers = spark.createDataFrame([("A",), ("A",), (None,)], "customer_id string")
    orders = spark.createDataFrame([("1", "A"), ("2", None), ("3", "B")], "order_id string, customer_id string")
    assert {r[0] for r in rp.orphans(orders, customers).collect()} == {"2", "3"}
    assert {r[0] for r in rp.matched(orders, customers).collect()} == {"1"}
    flagged = {r["order_id"]: r["is_orphan"] for r in rp.flag_orphans(orders, customers).collect()}
    assert flagged == {"1": False, "2": True, "3": True}
    assert two_table.orphan_summary(orders, customers).first()["orphaned_orders"] == 1


def test_spelling_ties_limits_and_blanks(spark):
    tie = [("a ",), ("A",), ("A ",), ("a ",), ("A",)]
    df = spark.createDataFrame(tie, "c string")
    found = {r["value"]: r["canonical"] for r in pf.spelling_map(df, ["c"]).collect()}
    assert found == {"a ": "A", "A ": "A"}
    many = spark.createDataFrame([(f"v{i}", f"w{i % 60}") for i in range(61)] + [("V1", "W1")], "wide string, full string")
    gate = pf.gated(pf.aggregate_columns(many, many.columns, pf.spelling_measures))
    assert pf.read_spellings(many, gate) == {}
    few = many.select(F.col("full").alias("full")).where("full <> 'w59'")
    assert pf.read_spellings(few, ["full"]) == {"full": {"w1": "W1"}}


@pytest.mark.parametrize("distinct", [1, 30, 60])
def test_gate_never_drops_a_column_with_few_values(spark, distinct):
    for seed in range(3):
        df = spark.range(distinct).select(F.sha2(F.concat_ws("-", "id", F.lit(seed)), 256).alias("c"))
        assert pf.gated(pf.aggregate_columns(df, ["c"], pf.spelling_measures)) == ["c"]


@pytest.mark.parametrize("seed", range(4))
def test_exact_medians_match_a_sort(spark, seed):
    rng = random.Random(seed)
    heavy = [7.0] * 400
    a = [rng.choice([rng.random() * 100, 7.0, -3.0]) for _ in range(1001 + seed)] + heavy
    b = [float(rng.randint(0, 20)) for _ in a]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double").repartition(5)
    counts = {"a": len(a), "b": len(b)}
    for limits in ({}, {"few_rows": 3, "accuracy": 50}):
        found = order_stats.exact_medians(df, counts, **limits)
        assert found == {"a": statistics.median(a), "b": statistics.median(b)}
    ranks = order_stats.exact_ranks(df, {"a": [0, 10, len(a) - 1]}, counts, few_rows=1, accuracy=20)
    assert [ranks["a", r] for r in (0, 10, len(a) - 1)] == [sorted(a)[r] for r in (0, 10, len(a) - 1)]


def test_medians_skip_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "a double, b double")
    assert order_stats.exact_medians(df, {"a": 2, "b": 0}) == {"a": 2.5}


def test_wide_tables_are_measured_in_batches(spark):
    names = [f"c{i}" for i in range(130)]
    df = spark.createDataFrame([tuple(str(i) for i in range(130)), tuple([""] * 130)], ", ".join(f"{n} string" for n in names))
    profile = pf.profile_table(df)
    assert profile.n_missing == 130 and len(profile.missing) == 130


MESSY = [("$1,200", "x ", "5", "01/02/2021"), ("$5", "X", "", "2021-01-03"), ("$7", "x", "7", "4 Jan 2021"),
         ("$7", "x", "7", "4 Jan 2021"), ("", "X ", "9", "soon"), ("$9", None, "11", "2021-01-05"),
         ("$9", "x", "12", "01/07/2021")]


def messy(spark):
    return spark.createDataFrame(MESSY, "price string, tag string, size string, when_date string")


def test_one_table_repair(spark):
    profile = pf.profile_table(messy(spark))
    assert profile.kinds == {"price": "currency", "when_date": "date"}
    done = single_table.repair(messy(spark), profile)
    rows = {tuple(r) for r in done.table.collect()}
    assert rows == {(1200.0, "x", 5.0, "2021-01-02"), (5.0, "x", 9.0, "2021-01-03"), (7.0, "x", 7.0, "2021-01-04"),
                    (8.0 + 1.0, "x", 9.0, "soon"), (9.0, "UNKNOWN", 11.0, "2021-01-05"), (9.0, "x", 12.0, "2021-01-07")}
    steps = {(action, column): n for _, column, action, n in done.steps}
    assert steps["trimmed", ""] == 2 and steps["deduplicated", ""] == 1 and steps["imputed", ""] == 3
    assert steps["date", "when_date"] == 3 and steps["canonicalised", "tag"] == 1
    assert any("median" in line for line in done.changelog)
    assert done.recovered.where("price IS NULL").count() == 1


def test_text_among_numbers_is_kept(spark):
    df = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("about 5",), ("",)], "n string")
    table, imputed = single_table.impute(df, 6)
    assert imputed == 1 and {r[0] for r in table.collect()} == {"1", "2", "3", "4", "about 5", "2.5"}


def holes(spark, n=40):
    rows = [(f"k{i}", None if i % 2 else f"tag{i}", None if i % 4 == 0 else str(i)) for i in range(n)]
    return spark.createDataFrame(rows, "id string, tag string, size string")


@pytest.mark.parametrize("mode, quarantined", [("reference", 20), ("mask", 30)])
def test_loop_escalates_on_invented_values(spark, mode, quarantined):
    report = single_table.run_trusted(holes(spark), mode)
    assert report.escalated and report.n_quarantined == quarantined
    assert report.quarantine.count() + report.table.count() == 40
    assert [h["attempt"] for h in report.history] == [1, 2]
    assert report.history[0]["imputed_share"] == pytest.approx(30 / 120)
    assert report.history[1]["imputed_share"] == 0
    assert report.after["overall"] == 100.0
    assert any("escalated" in line for line in reports.loop_lines("holes", report))
    if mode == "mask":
        assert report.quarantine.where("tag = 'UNKNOWN'").isEmpty()


def test_loop_accepts_an_earned_score(spark):
    clean = spark.createDataFrame([(f"k{i}", str(i)) for i in range(30)], "id string, size string")
    report = single_table.run_trusted(clean)
    assert not report.escalated and report.n_quarantined == 0 and len(report.history) == 1
    with pytest.raises(ValueError):
        single_table.run_trusted(clean, mode="other")


def test_quick_profile_keeps_eight_issues(spark):
    columns = ", ".join(f"c{i} string" for i in range(12))
    df = spark.createDataFrame([tuple("$5" for _ in range(12)), tuple(None for _ in range(12))], columns)
    profile = pf.quick_profile(df)
    assert len(profile["issues"]) == 8 and profile["completeness"] == 50.0 and profile["duplicate_rows"] == 0


def test_usage_report_of_empty_logs_and_unnamed_models(spark):
    schema = "model string, ts timestamp_ntz, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_write bigint"
    pricing = spark.createDataFrame([("a", 1.0, 2.0)], "model string, input_price double, output_price double")
    empty = reports.usage_report(spark.createDataFrame([], schema), pricing).collect()
    assert [(r.section, r.model, r.line) for r in empty] == [(1, "", "No usage data recorded yet.")]

    log = spark.createDataFrame([("a", None, 1_000_000, None, None, 5), (None, None, None, 2_000_000, 7, None),
                                 ("a", None, 1_000_000, 1_000_000, 1, 1)], schema)
    lines = [r.line for r in reports.usage_report(log, pricing).orderBy("section", "model").collect()]
    assert lines == [
        "Total chat calls : 3", "Total input tokens : 2,000,000", "Total output tokens : 3,000,000",
        "Cache read tokens : 8", "Cache write tokens : 6", "By model:",
        "(unnamed): 1 calls | 0 in / 2,000,000 out | ~$30.0000",
        "a: 2 calls | 2,000,000 in / 1,000,000 out | ~$4.0000",
        "Estimated total cost : ~$34.0000 USD", "Last updated : never"]
