import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from riskloom.operators import binning, sketches

PROBS = [0.01, 0.1, 0.5, 0.9, 0.99]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(4)
    data = []
    for i in range(6000):
        x = draw.choice([0.0, round(draw.gauss(50, 20), 1), float("nan") if i % 50 == 0 else 7.0])
        data.append(("CE" if i % 3 else None, 202401 + i % 4, None if i % 31 == 0 else x, draw.random() * i, int(draw.random() < 0.2 + 0.002 * i / 60)))
    return spark.createDataFrame(data, "seg string, month int, x double, z double, y int").repartition(5)


def test_refit_of_few_values_equals_the_exact_fit(spark, rows, tmp_path):
    path = str(tmp_path / "sketches")
    for month in (202401, 202402, 202403, 202404, 202402):  # the second one is written anew
        made = sketches.sketch_rows(rows.filter(F.col("month") == month), ["seg"], "month", ["x", "z"], "y")
        sketches.store(made, path)
    table = sketches.stored(spark, path, made)
    window = F.col("month").between(202402, 202403)
    fitted = sketches.refit(table, ["x", "z"], window)
    exact = binning.fit_bins(rows.filter(window), ["seg"], ["x", "z"], limits=binning.BinningLimits(rel_error=0))
    order = ["seg", "variable", "bin_no"]
    assert fitted.table.orderBy(*order).collect() == exact.table.orderBy(*order).select(*fitted.table.columns).collect()
    assert fitted.splits.count() == 4


def test_a_window_reads_its_own_periods_only(spark, rows, tmp_path):
    made = sketches.sketch_rows(rows, ["seg"], "month", ["x"], "y")
    table = sketches.stored(spark, sketches.store(made, str(tmp_path / "s")), made)
    plan = sketches.merged(table, F.col("month") == 202403)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_merging_in_any_order_stays_within_the_error(spark):
    """Above the accuracy, sketches drop values; every order keeps the stated error."""
    parts, accuracy = 5, 256
    df = spark.range(40_000).select(
        F.lit("s").alias("seg"), (F.col("id") % parts).cast("int").alias("month"), F.lit(0).alias("y"),
        F.pmod(F.col("id") * 7919, F.lit(40_009)).cast("double").alias("x"),
    )
    seen = sorted(r["x"] for r in df.collect())
    rows = sketches.sketch_rows(df, ["seg"], "month", ["x"], "y", accuracy).rows.collect()
    schema = "seg string, month int, y int, variable string, sketch binary, n long, missing long"
    allowed = sketches.rank_error(accuracy) * 40_000
    for order in list(permutations(range(parts)))[::17]:
        ordered = spark.createDataFrame([rows[i] for i in order], schema).coalesce(1)
        table = sketches.SketchTable(ordered, ("seg",), "month", "y", accuracy)
        for r in sketches.quantiles(table, PROBS).collect():
            assert r["n"] == 40_000 and abs(seen.index(r["value"]) - r["prob"] * 40_000) <= 2 * allowed


def test_large_refit_is_near_the_exact_one(spark):
    df = spark.range(60_000).select(
        F.lit("s").alias("seg"), (F.col("id") % 6).cast("int").alias("month"),
        F.pmod(F.col("id") * 7919, F.lit(60_013)).cast("double").alias("x"),
    ).withColumn("y", (F.pmod(F.hash("x"), F.lit(100)) < 10 + F.col("x") / 2000).cast("int"))
    table = sketches.sketch_rows(df, ["seg"], "month", ["x"], "y")
    got = sketches.refit(table, ["x"]).table.filter("bin <> 'Missing'").orderBy("bin_no").collect()
    exact = binning.fit_bins(df, ["seg"], ["x"]).table.filter("bin <> 'Missing'").orderBy("bin_no").collect()
    assert len(got) == len(exact) and sum(r["count"] for r in got) == 60_000
    most = 3 * (sketches.rank_error(4096) + 1 / sketches.GRID) * 60_000
    for a, b in zip(got, exact):
        assert abs(a["count"] - b["count"]) <= most and abs(a["event_rate"] - b["event_rate"]) < 0.01


def test_no_rows_and_no_values(spark):
    kinds = "seg string, month int, x double, y int"
    assert sketches.refit(sketches.sketch_rows(spark.createDataFrame([], kinds), ["seg"], "month", ["x"], "y"), ["x"]).table.count() == 0
    gone = spark.createDataFrame([("a", 1, None, 0), ("a", 2, float("nan"), 1), ("a", 2, None, None)], kinds)
    table = sketches.sketch_rows(gone, ["seg"], "month", ["x"], "y")
    found = {r["bin"]: (r["count"], r["event"]) for r in sketches.refit(table, ["x"]).table.collect()}
    assert found["(-inf, inf)"] == (0, 0) and found["Missing"][0] == 3
    assert sketches.quantiles(table, PROBS).count() == 0 or sketches.quantiles(table, PROBS).filter("value is not null").count() == 0
