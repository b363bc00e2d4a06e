import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions.rules import (
    first_match, match_count, parse_rules, rules_frame, rules_from_rows,
)
from riskloom.operators.profiles import limit_audit, profile_all, profile_rules, rule_audit
from riskloom.plans.profiling_transform import transform
from riskloom.settings import (
    NO_PROFILE, PROFILE_RUNS, RULES_FA_CE, RULES_FA_CE_ORIGINAL, RULES_FA_SE, RULES_FA_SE_ORIGINAL,
    RULES_U3M_CE, RULES_U3M_SE, RULES_U6M_CE, RULES_U6M_SE,
)

TABLES = {
    "fa_ce": RULES_FA_CE, "fa_se": RULES_FA_SE, "u3m_ce": RULES_U3M_CE, "u3m_se": RULES_U3M_SE,
    "u6m_ce": RULES_U6M_CE, "u6m_se": RULES_U6M_SE,
    "fa_ce_original": RULES_FA_CE_ORIGINAL, "fa_se_original": RULES_FA_SE_ORIGINAL,
}


def inside(value, low, high):
    if low is not None:
        edge, closed = low if isinstance(low, tuple) else (low, True)
        if value is None or value < edge or (value == edge and not closed):
            return False
    if high is not None:
        edge, closed = high if isinstance(high, tuple) else (high, False)
        if value is None or value > edge or (value == edge and not closed):
            return False
    return True


def matching(table, score, balance):
    return [
        r[5] for r in table
        if inside(score, r[0], r[1])
        and (inside(balance, r[2], r[3]) or (r[4] and balance is None))
    ]


def edges(table, places):
    found = {e[0] if isinstance(e, tuple) else e for r in table for i in places for e in [r[i]]}
    return sorted(e for e in found if e is not None)


def boundary_points(table, seed=7):
    draw = random.Random(seed)
    scores = [s + d for s in edges(table, (0, 1)) for d in (-1, 0, 1)] + [0, 1500, None]
    balances = [round(b + d, 2) for b in edges(table, (2, 3)) for d in (-0.01, 0.0, 0.01)]
    balances += [-100.0, 1e7, None] + [round(draw.uniform(-50, 2000), 2) for _ in range(5)]
    return [(s, b) for s in scores for b in balances]


@pytest.mark.parametrize("name", TABLES)
def test_tables_on_their_boundary_grid(spark, name):
    table = TABLES[name]
    df = spark.createDataFrame(boundary_points(table), "s int, b double")
    rows = df.select(
        "s", "b", first_match(F.col("s"), F.col("b"), table).alias("p"),
        match_count(F.col("s"), F.col("b"), table).alias("m"),
    ).collect()
    for r in rows:
        held = matching(table, r["s"], r["b"])
        assert r["p"] == (held[0] if held else NO_PROFILE), (r["s"], r["b"])
        assert r["m"] == len(held), (r["s"], r["b"])


def test_current_tables_have_no_gap_and_originals_have_the_known_ones(spark):
    gaps = {}
    for name, table in TABLES.items():
        points = [(s, b) for s, b in boundary_points(table) if s is not None and b is not None]
        df = spark.createDataFrame(points, "s int, b double")
        counted = df.filter(match_count(F.col("s"), F.col("b"), table) == 0)
        gaps[name] = {(r["s"], r["b"]) for r in counted.collect()}
    assert all(not g for name, g in gaps.items() if not name.endswith("original"))
    assert gaps["fa_ce_original"] and all(b == 552.0 and 894 <= s < 960 for s, b in gaps["fa_ce_original"])
    assert gaps["fa_se_original"] and all(b < 6.14 and 920 <= s < 940 for s, b in gaps["fa_se_original"])


def test_only_overlap_is_at_the_shared_limit(spark):
    df = spark.createDataFrame(boundary_points(RULES_FA_CE), "s int, b double")
    twice = df.filter(match_count(F.col("s"), F.col("b"), RULES_FA_CE) > 1).collect()
    assert twice and all(r["b"] == 7.26 and r["s"] >= 960 for r in twice)


def test_null_balance_by_score(spark):
    df = spark.createDataFrame([(919,), (920,), (960,), (971,), (979,), (939,), (940,), (893,), (894,)], "s int")
    none = F.lit(None).cast("double")
    got = {r[0]: tuple(r)[1:] for r in df.select(
        "s", *[first_match(F.col("s"), none, t).alias(n) for n, t in
               {"a": RULES_U3M_CE, "b": RULES_U3M_SE, "c": RULES_U6M_CE, "d": RULES_U6M_SE,
                "e": RULES_FA_CE}.items()]).collect()}
    assert [got[s][0] for s in (919, 920, 960, 971, 979)] == ["C_1", "C_4", "C_8", "C_9", "C_10"]
    assert [got[s][1] for s in (939, 940)] == ["C_1", "C_4"]
    assert [got[s][2] for s in (893, 894, 960, 971, 979)] == ["C_2", "C_4", "C_8", "C_9", "C_10"]
    assert [got[s][3] for s in (939, 940)] == ["C_1", "C_3"]
    assert {v[4] for v in got.values()} == {NO_PROFILE}


HOST = ("tipoModeloFA string, scoreBuroFA int, saldoCuentasFA double, tipoModelo12D string, "
        "scoreBuro12D int, saldoCuentas12D double, avgSaldoCuentasU3M double, avgSaldoCuentasU6M double")


def test_transform_adds_four_columns_and_chooses_by_suffix(spark):
    rows = [(t, 985, 100.0, t, 985, 5.0, 500.0, 500.0) for t in ("CE", "xCE", "SE", "other", None)]
    df = transform(spark, spark.createDataFrame(rows, HOST), {})
    assert df.columns[-4:] == ["perfilesReglasFA", "perfilesReglas12D", "perfilesReglasU3M", "perfilesReglasU6M"]
    got = [tuple(r)[-4:] for r in df.collect()]
    assert got[0] == got[1] == ("C_11", "C_6", "C_11", "C_11")
    assert got[2] == got[3] == got[4] == ("C_12", "C_5", "C_12", "C_9")


def test_null_score_has_no_profile(spark):
    df = spark.createDataFrame([("CE", None, 100.0)], "t string, s int, b double")
    row = profile_rules(df, "t", "s", "b", "p", RULES_FA_CE, RULES_FA_SE).first()
    assert row["p"] == NO_PROFILE


def test_profiling_is_one_narrow_stage(spark):
    df = spark.createDataFrame([], HOST)
    plan = profile_all(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_audit_counts_every_row(spark):
    points = [("CE", s, b, "SE", s, b, b, b) for s, b in boundary_points(RULES_FA_CE)]
    df = spark.createDataFrame(points, HOST)
    total = rule_audit(df, PROFILE_RUNS).groupBy("tabla").agg(F.sum("filas").alias("n")).collect()
    assert {r["n"] for r in total} == {len(points)} and len(total) == 4


def test_rules_survive_the_round_trip_through_rows(spark):
    frame = rules_frame(spark, TABLES)
    for name, table in TABLES.items():
        back = rules_from_rows(frame.filter(F.col("tabla") == name).collect())
        df = spark.createDataFrame(boundary_points(table), "s int, b double")
        differ = df.filter(
            first_match(F.col("s"), F.col("b"), back) != first_match(F.col("s"), F.col("b"), table))
        assert differ.count() == 0


@pytest.mark.parametrize("name", TABLES)
def test_grid_equals_a_case_chain_of_the_conditions(spark, name):
    """The lookup grid against the rules' own Column conditions, first match by order."""
    rules = parse_rules(TABLES[name])
    points = boundary_points(TABLES[name], seed=3) + [(900, float("nan")), (900, float("inf"))]
    df = spark.createDataFrame(points, "s int, b double")
    s, b = F.col("s"), F.col("b")
    chain = F.coalesce(*[F.when(r.condition(s, b), r.label) for r in rules], F.lit(NO_PROFILE))
    assert df.filter(chain != first_match(s, b, rules)).count() == 0


def test_empty_and_unlimited_rules(spark):
    df = spark.createDataFrame([(1, 1.0), (None, None)], "s int, b double")
    s, b = F.col("s"), F.col("b")
    got = df.select(first_match(s, b, [], "none"), first_match(s, b, [(None, None, None, None, False, "all")])).collect()
    assert [tuple(r) for r in got] == [("none", "all"), ("none", "all")]


def test_limit_audit_counts_every_pair_of_limits(spark):
    run = PROFILE_RUNS["fa"]
    df = spark.createDataFrame(
        [("MOD_CE", 1, 1.0), ("MOD_SE", 1, 1.0)] * 50, f"{run.model_type} string, {run.score} int, {run.balance} double"
    )
    got = limit_audit(df, {"fa": run}).collect()
    table = [*run.ce, *run.se]
    scores, balances = ([*edges(table, places), None] for places in ((0, 1), (2, 3)))
    wanted = {}
    for kind, rules in (("CE", run.ce), ("SE", run.se)):
        for s in scores:
            for b in balances:
                held = matching(rules, s, b)
                key = (kind, s is None or b is None, len(held), held[0] if held else NO_PROFILE)
                wanted[key] = wanted.get(key, 0) + 1
    assert {(r["rama"], r["con_nulos"], r["coincidencias"], r["perfil"]): r["filas"] for r in got} == wanted
