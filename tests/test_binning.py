import itertools
import math
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import binning, iv, monotone
from riskloom.operators.edges import cut_frame, with_cut_values
from riskloom.settings import CutMap


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(11)
    rows = []
    for i in range(4000):
        x = 0.0 if i % 3 == 0 else round(draw.uniform(-10, 90), 1)   # a third of the rows share a value
        y = int(draw.random() < (0.30 - 0.002 * max(x, 0)))
        rows.append(("CE" if i % 5 else "SE", None if i % 40 == 3 else x, draw.random(), y))
    return spark.createDataFrame(rows, "seg string, x double, noise double, y int").repartition(5)


def brute_force(values, max_bins=5, share=0.1):
    """All groupings of 20-quantile prebins; best IV among feasible monotone ones."""
    seen = sorted(v for v, _ in values)
    n = len(seen)
    edges = sorted({seen[max(1, math.ceil(round(n * i / 20, 9))) - 1] for i in range(1, 20)})
    cells = {}
    for v, y in values:
        pre = sum(1 for e in edges if e <= v)
        c = cells.setdefault(pre, [0, 0])
        c[0] += 1
        c[1] += y
    pres = sorted(cells)
    bads = sum(c[1] for c in cells.values())
    goods = n - bads
    found = []
    for k in range(0, max_bins):
        for cuts in itertools.combinations(range(1, len(pres)), k):
            ends = [0, *cuts, len(pres)]
            bins = []
            for a, b in zip(ends, ends[1:]):
                part = [cells[p] for p in pres[a:b]]
                bins.append((sum(c[0] for c in part), sum(c[1] for c in part)))
            if any(c < share * n or e == 0 or c == e for c, e in bins):
                continue
            rates = [e / c for c, e in bins]
            if rates != sorted(rates) and rates != sorted(rates, reverse=True):
                continue
            total = sum(
                ((c - e) / goods - e / bads) * math.log(((c - e) / goods) / (e / bads)) for c, e in bins)
            found.append((-round(total, 12), len(cuts), cuts))
    best = min(found)
    return [edges[pres[c] - 1] for c in best[2]], -best[0], len(found)


def test_search_equals_brute_force(labelled):
    fitted = binning.fit_bins(labelled, ["seg"], ["x", "noise"], limits=binning.BinningLimits(rel_error=0))
    data = {}
    for r in labelled.collect():
        for name in ("x", "noise"):
            if r[name] is not None:
                data.setdefault((r["seg"], name), []).append((r[name], r["y"]))
    rows = fitted.splits.collect()
    assert len(rows) == 4
    for r in rows:
        cuts, total, feasible = brute_force(data[(r["seg"], r["variable"])])
        assert r["splits"] == cuts and r["feasible"] == feasible
        assert r["search_iv"] == pytest.approx(total, abs=1e-9)


@pytest.mark.parametrize("rel_error", [0, 1e-4])
def test_fitted_table_invariants(labelled, rel_error):
    fitted = binning.fit_bins(labelled, ["seg"], ["x"], limits=binning.BinningLimits(rel_error=rel_error))
    for seg in ("CE", "SE"):
        rows = fitted.table.filter(F.col("seg") == seg).orderBy("bin_no").collect()
        bins, missing = rows[:-1], rows[-1]
        assert missing["bin"] == "Missing" and missing["bin_no"] == len(bins) <= 5
        assert sum(r["count"] for r in rows) == labelled.filter(F.col("seg") == seg).count()
        known = sum(r["count"] for r in bins)
        assert all(r["count"] >= 0.1 * known for r in bins)
        rates = [r["event_rate"] for r in bins]
        assert rates in (sorted(rates), sorted(rates, reverse=True))
        assert all(r["iv"] >= 0 and 0 <= r["js"] <= r["iv"] / 8 + 1e-9 for r in rows)
        assert sum(r["count_share"] for r in rows) == pytest.approx(1)


def test_equal_first_rates_do_not_lose_groupings(spark):
    """The trend must not be taken from the first pair of bins."""
    rows = []
    for block, bads in enumerate([2, 2, 4, 6]):
        rows += [(float(block), int(i < bads)) for i in range(20)]
    df = spark.createDataFrame(rows, "x double, y int")
    fitted = binning.fit_bins(df, [], ["x"], limits=binning.BinningLimits(rel_error=0))
    row = fitted.splits.first()
    assert row["splits"] == [2.0, 3.0]
    assert row["feasible"] == 8   # every subset of the three possible cuts


def test_one_class_gives_no_split(spark):
    df = spark.createDataFrame([(float(i), 0) for i in range(50)], "x double, y int")
    fitted = binning.fit_bins(df, [], ["x"], limits=binning.BinningLimits(rel_error=0))
    assert fitted.splits.first()["splits"] == []
    assert [(r["bin"], r["count"], r["woe"]) for r in fitted.table.orderBy("bin_no").collect()] == [
        ("(-inf, inf)", 50, 0.0), ("Missing", 0, 0.0)]


def test_discretize_and_ranking(labelled):
    fitted = binning.fit_bins(labelled, ["seg"], ["x", "noise"], limits=binning.BinningLimits(rel_error=0))
    out = binning.discretize(labelled, fitted, suffix="_b")
    counted = {(r["seg"], r["x_b"]): r["count"] for r in out.groupBy("seg", "x_b").count().collect()}
    for r in fitted.table.filter("variable = 'x' and count > 0").collect():
        assert counted[(r["seg"], r["bin_no"])] == r["count"]
    ranking = binning.iv_totals(fitted.table, ["seg"]).orderBy("rank").collect()
    assert [r["variable"] for r in ranking if r["seg"] == "CE"][0] == "x"
    assert all(r["usable"] == (r["n_splits"] > 1) for r in ranking)


def test_discretize_keeps_values_without_usable_cuts(spark):
    rows = [("CE", 0.1), ("CE", 1.0), ("CE", None), ("SE", 7.5), ("SE", None), ("XX", 3.0)]
    df = spark.createDataFrame(rows, "seg string, x double")
    splits = [("CE", "x", [0.5, 2.0]), ("SE", "x", [3.0])]
    splits = spark.createDataFrame(splits, "seg string, variable string, splits array<double>")
    out = binning.discretize(df, binning.FittedBins(("seg",), splits, None, ("x",)))
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, [
        ("CE", 0.0), ("CE", 1.0), ("CE", 3.0), ("SE", 7.5), ("SE", None), ("XX", 3.0)]))


def listed_groupings(n, events, max_bins, share):
    """Best cuts, value and number of all feasible groupings, by listing them."""
    total, bads = sum(n), sum(events)
    found = []
    for k in range(max_bins):
        for cuts in itertools.combinations(range(1, len(n)), k):
            ends = [0, *cuts, len(n)]
            bins = [(sum(n[a:b]), sum(events[a:b])) for a, b in zip(ends, ends[1:])]
            if any(c < share * total or e == 0 or c == e for c, e in bins):
                continue
            rates = [e / c for c, e in bins]
            if rates != sorted(rates) and rates != sorted(rates, reverse=True):
                continue
            value = sum(((c - e) / (total - bads) - e / bads) * math.log(((c - e) / (total - bads)) / (e / bads))
                        for c, e in bins)
            found.append((-round(value, 12), len(cuts), cuts))
    return (list(min(found)[2]), -min(found)[0], len(found)) if found else ([], None, 0)


@pytest.mark.parametrize("seed", range(40))
def test_dynamic_programme_equals_listing(seed):
    draw = random.Random(seed)
    parts, bins = draw.randint(1, 11), draw.randint(1, 6)
    n = [draw.choice([10, 20, 40]) for _ in range(parts)]
    events = [draw.randint(0, c) if seed % 4 else c // 10 * draw.choice([1, 2]) for c in n]
    share = draw.choice([0, 0.05, 0.2])
    got = monotone.search(pd.Series([n]), pd.Series([events]), bins, share).iloc[0]
    cuts, value, feasible = listed_groupings(n, events, bins, share) if 0 < sum(events) < sum(n) else ([], None, 0)
    assert got["cuts"] == cuts and got["feasible"] == feasible
    assert got["iv"] == pytest.approx(value, abs=1e-11) if value is not None else pd.isna(got["iv"])


def test_fifty_prebins_and_eight_bins_are_fast():
    draw = random.Random(1)
    n = [200] * 50
    events = [draw.randint(max(1, 60 - k), 90 - k) for k in range(50)]
    started = time.perf_counter()
    got = monotone.search(pd.Series([n] * 8), pd.Series([events] * 8), 8, 0.02)
    assert time.perf_counter() - started < 10
    assert got["feasible"][0] > 10**6 and len(got["cuts"][0]) <= 7
    rates = [sum(events[a:b]) / sum(n[a:b]) for a, b in zip([0, *got["cuts"][0]], [*got["cuts"][0], 50])]
    assert rates in (sorted(rates), sorted(rates, reverse=True))


def test_prebins_of_one_rate_are_counted_not_listed():
    got = monotone.search(pd.Series([[100] * 40]), pd.Series([[10] * 40]), 8, 0).iloc[0]
    assert got["cuts"] == [] and got["feasible"] == sum(math.comb(39, k) for k in range(8))


def test_a_hundred_thousand_segments_meet_their_cuts_in_a_join(spark, monkeypatch):
    """Nothing per segment reaches the driver or the plan."""
    count = 100_000
    seg = F.concat(F.lit("s"), F.col("id"))
    splits = spark.range(count).select(
        seg.alias("seg"), F.explode(F.array(F.lit("x"), F.lit("z"))).alias("variable"),
        F.transform(F.sequence(F.lit(0), (F.col("id") % 4).cast("int")), lambda i: (i + F.col("id") % 7).cast("double")).alias("splits"),
    )
    fitted = binning.FittedBins(("seg",), splits, None, ("x", "z"))
    df = spark.range(200_000).select(
        F.concat(F.lit("s"), F.col("id") % (count + 5)).alias("seg"), (F.col("id") % 13).cast("double").alias("x"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 5).cast("int").alias("z"), "id",
    )
    for name in ("collect", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(df), name, lambda *a: pytest.fail("rows reach the driver"))
    out = binning.discretize(df, fitted, suffix="_b")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.undo()
    assert len(plan) < 20_000

    def number(seg, value):
        edges = [i + seg % 7 for i in range(seg % 4 + 1)]
        if seg >= count or len(edges) < 2:
            return value
        return float(len(edges) + 1 if value is None else sum(e <= value for e in edges))

    rows = out.filter("id % 97 = 0").collect()
    assert len(rows) == 2062
    for r in rows:
        s = int(r["seg"][1:])
        assert r["x_b"] == number(s, r["x"]) and r["z_b"] == number(s, r["z"])


@pytest.mark.parametrize("right_closed", [True, False])
def test_binary_search_equals_counting(spark, right_closed):
    draw = random.Random(3)
    rows = []
    for size in [*range(0, 20), 64, 255, 1000]:
        cuts = sorted(draw.sample(range(2000), size))
        for v in [None, float("nan"), -1.0, 5000.0, *(float(c) for c in cuts[:9]), *(c + 0.5 for c in cuts[-3:])]:
            rows.append((len(rows), [float(c) for c in cuts], v))
    df = spark.createDataFrame(rows, "id int, edges array<double>, v double")
    table = df.select("id", F.lit("v").alias("variable"), "edges",
                      F.transform(F.sequence(F.lit(0), F.size("edges")), lambda i: i.cast("string")).alias("values"),
                      F.lit("gone").alias("missing"), F.lit(right_closed).alias("right_closed"))
    got = {r["id"]: r["v_at"] for r in with_cut_values(df, table, ["id"], ["v"], "_at").collect()}
    for i, cuts, v in rows:
        if v is None or math.isnan(v):
            assert got[i] == "gone"
        else:
            assert got[i] == str(sum(c < v if right_closed else c <= v for c in cuts))


def test_tables_of_maps_and_null_keys(spark):
    maps = {("CE", "x"): CutMap((1.0, 2.0), (-1.0, 0.5, 2.0), 9.0), ("SE", "x"): CutMap((5.0,), (0.1, 0.2), None, False)}
    df = spark.createDataFrame([("CE", 1.0), ("CE", 1.5), ("CE", None), ("SE", 5.0), ("SE", None), (None, 1.0)], "seg string, x double")
    out = with_cut_values(df, cut_frame(spark, maps, "seg"), ["seg"], ["x"], "_v")
    assert {(r[0], r[1]): r[2] for r in out.collect()} == {
        ("CE", 1.0): -1.0, ("CE", 1.5): 0.5, ("CE", None): 9.0, ("SE", 5.0): 0.2, ("SE", None): None, (None, 1.0): None}
    table = spark.createDataFrame([(None, "x", [0.0], [1.0, 2.0], 3.0, True)],
                                  "seg string, variable string, edges array<double>, values array<double>, missing double, right_closed boolean")
    out = with_cut_values(df, table, ["seg"], ["x"], "_v").filter("seg is null").collect()
    assert [r["x_v"] for r in out] == [2.0]
    assert with_cut_values(df.drop("seg"), table.drop("seg"), [], ["x"], "_v").filter("x_v = 2").count() == 4


def test_fitted_woe_equals_the_bin_table(labelled):
    fitted = binning.fit_bins(labelled, ["seg"], ["x", "noise"])
    out = binning.fitted_values(binning.fitted_values(labelled, fitted), fitted, "bin", "_bin")
    seen = {(r["seg"], r["x_bin"]): (r["count"], r["woe"]) for r in
            out.groupBy("seg", "x_bin").agg(F.count(F.lit(1)).alias("count"), F.first("x_woe").alias("woe")).collect()}
    want = {(r["seg"], r["bin"]): (r["count"], r["woe"]) for r in
            fitted.table.filter("variable = 'x' and count > 0").collect()}
    assert seen == want


def test_sorted_by_event_rate_with_empty_missing_last(labelled):
    fitted = binning.fit_bins(labelled, [], ["noise"])
    rates = [r["event_rate"] for r in binning.by_event_rate(fitted.table).orderBy("rank").collect()]
    assert rates[-1] is None and rates[:-1] == sorted(rates[:-1])


def test_woe_sign_and_published_example(spark):
    """Base rate 3.08 % and a bin with rate 0.97 % give WOE +1.177."""
    rows = [("a", 10000, 97), ("b", 90000, 2983)]
    df = spark.createDataFrame(rows, "bin string, n long, events long").withColumn("k", F.lit("v"))
    got = {r["bin"]: r["woe"] for r in binning.bin_statistics(df, ["k"]).collect()}
    assert got["a"] == pytest.approx(1.177, abs=5e-3) and got["b"] < 0


def test_compatible_iv_drops_and_nulls(spark):
    rows = [("a", 0)] * 30 + [("a", 1)] * 10 + [("b", 0)] * 20 + [("b", 1)] * 20
    rows += [("only_bad", 1)] * 5 + [("only_good", 0)] * 5 + [(None, 0)] * 10 + [(None, 1)] * 2
    df = spark.createDataFrame(rows, "v string, y int")
    bins = {r["bin"]: r for r in iv.calc_iv_bins(df, ["v"]).collect()}
    assert set(bins) == {"a", "b", "only_good", None}
    assert bins["only_good"]["iv"] is None and bins[None]["iv"] is None and bins[None]["count_1"] is None
    goods, bads = 65, 37
    expected = sum(
        (g / goods - b / bads) * math.log((g / goods) / (b / bads)) for g, b in ((30, 10), (20, 20)))
    assert iv.calc_iv(df, ["v"]).first()["iv"] == pytest.approx(expected)


def test_round_splits(spark):
    df = spark.createDataFrame([([1.005, 2.344],)], "splits array<double>")
    assert binning.round_splits(df).first()["splits"] == [1.01, 2.34]


@pytest.mark.parametrize("rel_error", [0, 1e-4])
def test_all_null_variable_stays_listed(spark, rel_error):
    rows = [("a", None, float(i), int(i % 4 == 0)) for i in range(80)]
    df = spark.createDataFrame(rows, "seg string, gone double, x double, y int")
    fitted = binning.fit_bins(df, ["seg"], ["gone", "x"], limits=binning.BinningLimits(rel_error=rel_error))
    got = {(r["variable"], r["bin"]): (r["count"], r["event"], r["iv"]) for r in fitted.table.collect()}
    assert got[("gone", "(-inf, inf)")] == (0, 0, 0.0) and got[("gone", "Missing")] == (80, 20, 0.0)
    assert not {r["variable"]: r["usable"] for r in binning.iv_totals(fitted.table).collect()}["gone"]
