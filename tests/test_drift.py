from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import drift
from sievework.plans import drift_watch
from sievework.session import work_path


def test_inferred_types(spark):
    df = spark.createDataFrame([("1", "2021-01-01", "x", None), ("-2.5", "2021-01-01 10:00", "1", None)],
                               "n string, d string, t string, e string")
    assert [r["inferred_type"] for r in drift.fingerprint(df).orderBy("ordinal").collect()] == [
        "numeric", "date", "text", "empty"]


def test_baseline_life_cycle(spark):
    baselines = drift_watch.Baselines(spark, work_path(spark, "baselines"))
    first = spark.createDataFrame([("1", "a")], "id string, kind string")
    second = first.select(F.lit("x").alias("id"), F.lit("b").alias("brand"))
    assert baselines.names().isEmpty() and not baselines.remove("feed")
    assert baselines.check("feed", first, origin="batch 0").first_run
    assert baselines.check("feed", first, origin="batch 0").first_run      # the same work run again reports the same
    same = baselines.check("feed", first)
    assert not same.drifted and "unchanged" in drift_watch.render(same)[0]
    changed = baselines.check("feed", second)
    assert (changed.added, changed.removed, changed.type_changed) == (["brand"], ["kind"], [("id", "numeric", "text")])
    assert len(drift_watch.render(changed)) == 4
    baselines.accept("feed", drift.fingerprint(second))
    assert not baselines.check("feed", second).drifted
    assert [tuple(r) for r in baselines.names().collect()] == [("feed", 2)]
    assert baselines.remove("feed") and baselines.names().isEmpty()
    assert baselines.check("feed", first).first_run
