from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from riskloom.operators import cohort
from riskloom.plans import staging
from riskloom.plans.scorecard import modelling_run
from riskloom.settings import DEFAULT_ROLES, FIXTURE_LIMITS, FIXTURE_ROLES, MODEL_RUNS
from riskloom.sources.mdt import modelling_table
from riskloom.sources.tables import local_rows, preview, read_csv, read_table, write_csv

ROLES = replace(DEFAULT_ROLES, row_id="rid")
SCHEMA = ("rid long, identificacionCliente long, codigoPeriodoConcesion int, y int, "
          "numeroRegistrosRiesgo int, reportesActivoU12m int, moraMesAnterior int")
ROWS = [
    (1, 1, 202402, 0, 12, 6, 90),      # kept, CE, train, not evident
    (2, 1, 202402, 1, 3, 5, 91),       # same customer and month, bad wins over row 1
    (3, 2, 202311, 1, 20, 9, 0),       # before the start month
    (4, 3, 202411, 0, 11, 9, 0),       # too little history
    (5, 4, 202411, 1, 0, None, None),  # bad without history; NULLs: SE, not evident, test
    (6, 5, None, 0, 30, 7, 0),         # no month
    (7, 6, 202410, None, 30, 7, 0),    # no label
    (8, 7, 202410, 0, 30, 7, 95),      # evident bad
    (9, 7, 202410, 0, 30, 7, 0),       # equal label: the lower row id wins, so 8 stays
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_cohort_rows_and_flags(table):
    got = {r["rid"]: (r["experiencia"], r["particion"], r["maloEvidente"])
           for r in cohort.modelling_cohort(table, ROLES).collect()}
    assert got == {2: ("SE", "train", 1), 5: ("SE", "test", 0), 8: ("CE", "train", 1)}


def test_base_drops_evident_bads_and_weighs(table):
    rows = cohort.modelling_base(table, ROLES).collect()
    assert [(r["rid"], r["weight"]) for r in rows] == [(5, 12.74)]


def test_pushing_the_month_before_the_dedupe_changes_nothing(table):
    late = cohort.since_start(cohort.dedupe(cohort.mature(table, ROLES), ROLES), ROLES)
    early = cohort.dedupe(cohort.since_start(cohort.mature(table, ROLES), ROLES), ROLES)
    assert sorted(map(tuple, late.collect())) == sorted(map(tuple, early.collect()))


def test_balanced_weights(spark):
    rows = [("CE", 1)] * 5 + [("CE", 0)] * 95 + [("SE", 1)] * 10 + [("SE", 0)] * 10
    df = spark.createDataFrame(rows, "experiencia string, y int")
    got = {(r["experiencia"], r["y"]): r["weight"] for r in cohort.balanced_weights(df).collect()}
    assert got == {("CE", 1): 10.0, ("CE", 0): pytest.approx(100 / 190), ("SE", 1): 1.0, ("SE", 0): 1.0}
    joined = cohort.with_balanced_weights(df)
    assert joined.count() == 120 and joined.filter("weight = 10.0").count() == 5


def test_one_hot_customer_is_cut_before_the_shuffle(spark):
    rows = [(i, 1 if i % 3 == 0 else i, 202405, i % 2, 20, 7, 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = cohort.dedupe(df, ROLES)
    assert kept.count() == df.select("identificacionCliente").distinct().count()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2      # one before, one after the exchange
    assert plan.count("hashpartitioning") == 1


def test_filters_and_columns_reach_the_scan(spark, folder):
    df = cohort.modelling_cohort(
        modelling_table(spark, folder, FIXTURE_LIMITS.start_month), FIXTURE_ROLES, FIXTURE_LIMITS)
    plan = df.select("row_id", "experiencia")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert "o_orderpriority" not in plan and "c_name" not in plan and "Cartesian" not in plan


def test_start_month_filter_on_the_scan_is_equivalent(spark, folder):
    narrow = modelling_table(spark, folder, 199801)
    wide = modelling_table(spark, folder).filter("codigo_periodo >= 199801")
    assert narrow.exceptAll(wide).count() == wide.exceptAll(narrow).count() == 0


def test_fixture_counts(spark):
    small = modelling_table(spark, "/root/testdata/sf0.01")
    row = small.agg(F.count(F.lit(1)), F.sum("y"), F.count("score_buro"), F.count("antiguedad_buro")).first()
    assert tuple(row) == (15000, 1372, 14482, 14347)


def test_staging_reads_the_named_folder(spark):
    assert staging.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    kept, rows = staging.stage_counted(spark.range(10).repartition(3))
    assert kept.count() == rows == 10

    def plan(most):
        joined = spark.range(5000).join(staging.broadcast_side(spark.range(10), most), "id")
        return joined._jdf.queryExecution().optimizedPlan().toString()

    assert "broadcast" in plan(160) and "broadcast" not in plan(159)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, 'q"x', 0.1)], "i int, s string, d double")
    path = write_csv(df, str(tmp_path / "out"))
    assert sorted(map(str, read_csv(spark, path, df.schema).collect())) == sorted(map(str, df.collect()))


def test_small_sources(spark, folder):
    assert local_rows(spark, [(1,)], "a int").count() == 1
    orders = read_table(spark, f"{folder}/orders.parquet")
    assert preview(orders, F.desc("o_totalprice"), "o_orderkey").count() == 50


def test_whole_modelling_run(spark, folder):
    result = modelling_run(modelling_table(spark, folder), FIXTURE_ROLES, FIXTURE_LIMITS,
                           runs=[r for r in MODEL_RUNS if r.model_id in ("T3", "T4")])
    try:
        assert {r["variable"] for r in result.thresholds.collect()} == {"antiguedad_buro", "saldo_cuentas"}
        assert result.profile.count() == 2 * 6
        assert result.iv_ranking.count() == 2 * 4 and result.calc_iv.count() == 2 * 2
        assert result.comparison.count() == 2 * 2
        assert result.leaf_table.agg(F.sum("muestra")).first()[0] == pytest.approx(2.0)
        assert result.base.filter("saldo_cuentas < 0").count() == 0
    finally:
        result.base.unpersist()
