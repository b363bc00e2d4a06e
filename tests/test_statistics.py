import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import outliers, profiling, sampling
from riskloom.operators.prefix import running_totals
from riskloom.operators.quantiles import quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """One value holds a third of the rows; two segments; NULL and NaN present."""
    draw = random.Random(3)
    rows = []
    for i in range(6000):
        x = 5.0 if i % 3 == 0 else round(draw.gauss(0, 50), 1)
        rows.append((i, "CE" if i % 4 else "SE", None if i % 50 == 7 else x, i % 97))
    rows.append((6000, "CE", float("nan"), 1))
    return spark.createDataFrame(rows, "id long, seg string, x double, k int").repartition(7)


def nearest_rank(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(round(p * len(values), 9))) - 1]


def test_running_totals_across_slices(spark):
    rows = [(g, float(v), v % 5 + 1) for g in ("a", "b") for v in range(500)] + [("c", 1.0, 9)]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sliced = running_totals(df, ["g"], "v", ["n"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plain = running_totals(df, ["g"], "v", ["n"], bounded=True).collect()
    shown = lambda r: (r["g"], r["v"], r["n"], r["n_upto"], r["n_total"], r["v_next"] or -1.0)
    assert sorted(map(shown, sliced)) == sorted(map(shown, plain))
    assert len(sliced) == len(rows)


def test_exact_quantiles_are_nearest_rank(skewed):
    probs = [0.01, 0.02, 0.25, 0.5, 0.98, 1.0]
    got = {(r["seg"], r["prob"]): r["value"]
           for r in quantiles(skewed, ["seg"], ["x"], probs, rel_error=0).collect()}
    data = {}
    for r in skewed.collect():
        if r["x"] is not None and not math.isnan(r["x"]):
            data.setdefault(r["seg"], []).append(r["x"])
    for seg, values in data.items():
        for p in probs:
            assert got[(seg, p)] == nearest_rank(values, p), (seg, p)


def test_sketched_quantiles_stay_within_their_rank_error(skewed):
    got = {r["prob"]: r["value"]
           for r in quantiles(skewed, [], ["x"], [0.1, 0.5, 0.9], rel_error=0.01).collect()}
    values = sorted(r["x"] for r in skewed.collect() if r["x"] is not None and not math.isnan(r["x"]))
    for p, v in got.items():
        low = sum(1 for x in values if x < v) / len(values)
        high = sum(1 for x in values if x <= v) / len(values)
        assert low - 0.01 <= p <= high + 0.01


@pytest.mark.parametrize("bad", [(0.5, 0.5), (-0.1, 0.9), (0.1, 1.1), (0.9, 0.1)])
def test_winsorize_refuses_bad_percentiles(skewed, bad):
    with pytest.raises(ValueError):
        outliers.winsorize(skewed, ["x"], *bad)


def test_winsorize_refuses_absent_columns(skewed):
    with pytest.raises(ValueError, match="nope"):
        outliers.winsorize(skewed, ["x", "nope"])


def test_winsorize_skips_and_suffixes(spark):
    df = spark.createDataFrame(
        [(i, float(i), 7.0, "s", None, i) for i in range(1, 101)],
        "id long, x double, flat double, s string, empty double, n int",
    )
    out, marks = outliers.winsorize(
        df, ["x", "x", "s", "flat", "empty", "n"], approx_rel_error=0, inplace=False, verbose=False)
    assert marks == {"x": (2.0, 98.0), "flat": (7.0, 7.0), "n": (2.0, 98.0)}
    assert out.columns == df.columns + ["x_win", "flat_win", "n_win"]
    assert [(r["x_win"], r["n_win"]) for r in out.filter("id in (1, 50, 100)").orderBy("id").collect()] == [
        (2.0, 2.0), (50.0, 50.0), (98.0, 98.0)]
    assert outliers.winsorize(df, None, verbose=False) == (df, {})
    same, none = outliers.winsorize(df, ["empty"], verbose=False)
    assert none == {} and same.columns == df.columns


def test_winsorize_keeps_null_and_nan(skewed):
    out, marks = outliers.winsorize(skewed, ["x"], approx_rel_error=0, verbose=False, by="seg")
    before = skewed.agg(F.count_if(F.col("x").isNull()).alias("n"), F.count_if(F.isnan("x")).alias("m")).first()
    after = out.agg(F.count_if(F.col("x").isNull()).alias("n"), F.count_if(F.isnan("x")).alias("m")).first()
    assert before == after and before["m"] == 1
    for r in marks.filter("variable = 'x'").collect():
        ends = out.filter((F.col("seg") == r["seg"]) & ~F.isnan("x")).agg(F.min("x"), F.max("x")).first()
        assert tuple(ends) == (r["low"], r["high"])


def test_winsorize_by_many_values_and_null(spark):
    rows = [(None if k % 7 == 0 else k % 300, float(k)) for k in range(9000)] + [(400, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    out, marks = outliers.winsorize(df, ["x"], 0.1, 0.9, 0, verbose=False, by="g")
    assert out.columns == df.columns and out.count() == len(rows) and marks.count() == 301
    by = {}
    for g, x in rows:
        by.setdefault(g, []).append(x)
    for r in out.groupBy("g").agg(F.min("x").alias("a"), F.max("x").alias("b")).collect():
        if r["g"] != 400:
            assert (r["a"], r["b"]) == (nearest_rank(by[r["g"]], 0.1), nearest_rank(by[r["g"]], 0.9))


def test_observation_cases(spark):
    n = 100
    rows = [(
        float(i) if i < 40 else None,                                  # too many NULLs
        (1e6 if i < 10 else float(i)),                                 # too many outliers
        None if i < 55 else (1e6 if i > 89 else float(i % 7)),         # both
        float(i),                                                      # neither
    ) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {r["variable"]: r for r in profiling.eda_profile(df, ["a", "b", "c", "d"], rel_error=0).collect()}
    nulls, outs = "Porcentaje de Nulos mayor al 50%", "Porcentaje de Atipicos mayor al 5%"
    assert got["a"]["observaciones"] == nulls
    assert got["b"]["observaciones"] == outs
    assert got["c"]["observaciones"] == f"{nulls} y {outs}"
    assert got["d"]["observaciones"] is None
    assert got["b"]["atipicos"] == 10 and got["c"]["atipicos"] == 10
    assert got["a"]["registros"] == n and got["a"]["nulos"] == 60 and got["a"]["porcNulos"] == 60.0
    assert got["d"]["50%"] == 49.0 and got["d"]["iQR"] == 50.0
    assert got["d"]["bandaInferior"] == 24.0 - 75.0 and got["d"]["bandaSuperior"] == 74.0 + 75.0
    assert got["d"]["stddev"] == pytest.approx(29.011491975882016)


def test_profile_accepts_fewer_statistics_and_limits(spark):
    df = spark.createDataFrame([(float(i) if i else None,) for i in range(20)], "a double")
    row = profiling.eda_profile(df, ["a"], ["mean", "90%"], max_nulls=4, rel_error=0).first()
    assert row["observaciones"] == "Porcentaje de Nulos mayor al 4%"
    assert row["mean"] == 10.0 and row["90%"] == 18.0 and "stddev" not in row.asDict()


def test_all_null_column_is_profiled(spark):
    df = spark.createDataFrame([(None, 1.0)] * 3, "a double, b double")
    got = {r["variable"]: r for r in profiling.eda_profile(df, ["a", "b"], rel_error=0).collect()}
    assert got["a"]["nulos"] == 3 and got["a"]["mean"] is None and got["a"]["atipicos"] == 0


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.37, 1.0])
def test_sample_has_the_exact_size_and_is_repeatable(skewed, fraction):
    first = sampling.sample_fraction(skewed, fraction, "id", seed=5)
    ids = {r["id"] for r in first.select("id").collect()}
    assert len(ids) == first.count() == int(fraction * 6001)
    again = {r["id"] for r in sampling.sample_fraction(skewed, fraction, "id", seed=5).collect()}
    assert ids == again


def test_sample_narrows_large_groups(skewed, monkeypatch):
    monkeypatch.setattr(sampling, "_DIGITS", 1)
    assert sampling.sample_fraction(skewed, 0.1, "id").count() == 600


def test_sample_is_exact_for_null_and_repeated_keys(spark):
    rows = [(k % 3, k) for k in range(90)] + [(None, k) for k in range(5)] + [(1, 7)] * 5
    df = spark.createDataFrame(rows, "k int, v int")
    for fraction in (0.1, 0.33, 0.5, 0.95):
        got = sampling.sample_fraction(df, fraction, "k").collect()
        assert len(got) == int(fraction * 100)
        assert sorted(got, key=str) == sorted(sampling.sample_fraction(df, fraction, "k").collect(), key=str)
    same = spark.createDataFrame([(None, None)] * 50, "k int, v int")
    assert sampling.sample_fraction(same, 0.3, "k").count() == 15
    assert sampling.sample_fraction(df.limit(0), 0.3, "k").count() == 0


def test_stratified_folds_differ_by_one_row(spark):
    df = spark.createDataFrame([(k, k % 2, int(k % 11 == 0)) for k in range(500)], "id long, seg int, y int")
    counts = sampling.with_folds(df, ["seg", "y"], "id", 3).groupBy("seg", "y", "fold").count().collect()
    for seg in (0, 1):
        for y in (0, 1):
            sizes = [r["count"] for r in counts if (r["seg"], r["y"]) == (seg, y)]
            assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1


def test_folds_are_near_even(skewed):
    sizes = [r["count"] for r in skewed.groupBy(sampling.fold_number("id", 3)).count().collect()]
    assert len(sizes) == 3 and min(sizes) > 1800
