import pytest
from pyspark.sql import functions as F

from riskloom.functions.cuts import (
    bin_number, bins_of, code_value, cut_value, hard_cap, iv_strength, per_segment, woe_transform,
)
from riskloom.settings import BIN_LABELS, RATING_WOE, WOE_MAPS, CutMap


def lookup(table, value):
    """Plain reading of a cut table."""
    if value is None:
        return table.missing
    for cut, result in zip(table.cuts, table.values):
        if value < cut or (table.right_closed and value == cut):
            return result
    return table.values[-1]


@pytest.mark.parametrize("maps", [WOE_MAPS, BIN_LABELS])
def test_every_cut_map_at_below_and_above_each_cut(spark, maps):
    points = sorted({p for t in maps.values() for c in t.cuts for p in (c - 0.01, c, c + 0.01)})
    df = spark.createDataFrame([(float(p),) for p in points] + [(None,)], "x double")
    keys = list(maps)
    rows = df.select("x", *[cut_value(F.col("x"), maps[k]).alias(str(i)) for i, k in enumerate(keys)])
    for row in rows.collect():
        for i, k in enumerate(keys):
            assert row[str(i)] == lookup(maps[k], row["x"]), (k, row["x"])


def test_closed_sides_of_known_bins(spark):
    df = spark.createDataFrame([(552.0, 979)], "b double, s int")
    row = df.select(
        cut_value(F.col("b"), WOE_MAPS[("CE", "balance")]).alias("b"),
        cut_value(F.col("s"), WOE_MAPS[("CE", "score")]).alias("s"),
        cut_value(F.col("b"), BIN_LABELS[("CE", "balance")]).alias("l"),
    ).first()
    assert tuple(row) == (0.2025, 1.1462, "c_1")


def test_se_score_map_is_not_monotone():
    values = WOE_MAPS[("SE", "score")].values
    assert list(values) != sorted(values)


def test_generic_lookup(spark):
    df = spark.createDataFrame([(None,), (37.69,), (37.7,), (1e9,)], "x double")
    got = [r[0] for r in df.select(
        woe_transform(F.col("x"), [37.69, 153.48], [1.0, 2.0, 3.0], -9.0)).collect()]
    assert got == [-9.0, 1.0, 2.0, 3.0]


def test_rating_codes_accept_dirty_text(spark):
    df = spark.createDataFrame([("1",), ("1.0",), ("6",), ("x",), (None,)], "c string")
    got = [r[0] for r in df.select(code_value(F.col("c"), RATING_WOE["SE"])).collect()]
    assert got == [0.876159, 0.876159, -0.48007, -0.2144, -0.2144]


def test_unknown_segment_is_null(spark):
    df = spark.createDataFrame([("CE",), ("XX",), (None,)], "s string")
    got = [r[0] for r in df.select(per_segment(F.col("s"), {"CE": F.lit(1), "SE": F.lit(2)})).collect()]
    assert got == [1, None, None]


def test_hard_cap_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (0.0,), (3.0,), (10.0,), (11.0,)], "x double")
    got = [r[0] for r in df.select(hard_cap(F.col("x"), 0.0, 10.0)).collect()]
    assert got == [None, 0.0, 0.0, 3.0, 10.0, 10.0]
    assert [r[0] for r in df.select(hard_cap(F.col("x"), None, 10.0)).collect()][1] == -5.0


def test_iv_strength_edges(spark):
    df = spark.createDataFrame([(0.0199,), (0.02,), (0.1,), (0.3,), (0.5,), (None,)], "x double")
    got = [r[0] for r in df.select(iv_strength(F.col("x"))).collect()]
    assert got == ["sin poder predictivo", "debil", "medio", "fuerte", "sospechoso", None]


def test_bin_number_is_left_closed(spark):
    df = spark.createDataFrame([(0.9,), (1.0,), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(bin_number(F.col("x"), [1.0, 2.0], 3)).collect()] == [0, 1, 2, 3]


def test_bins_cover_the_axis():
    for table in WOE_MAPS.values():
        rows = bins_of(table)
        assert rows[0]["lo"] is None and rows[-2]["hi"] is None and rows[-1]["is_missing"]
        assert [r["hi"] for r in rows[:-2]] == [r["lo"] for r in rows[1:-1]]


def test_bad_tables_are_refused():
    with pytest.raises(ValueError):
        CutMap((1, 2), (0.1, 0.2), None)
    with pytest.raises(ValueError):
        CutMap((2, 1), (0.1, 0.2, 0.3), None)


def test_woe_rows_rebuild_the_map(spark):
    from riskloom.operators.woe import woe_frame

    rows = woe_frame(spark).filter("segmento = 'SE' and variable = 'score'").orderBy("posicion").collect()
    table = WOE_MAPS[("SE", "score")]
    assert tuple(r["woe"] for r in rows[:-1]) == table.values and rows[-1]["woe"] == table.missing
    assert tuple(r["hi"] for r in rows[:-2]) == tuple(map(float, table.cuts))
    assert {r["closed"] for r in rows} == {"left"}


def test_caps_leave_other_segments_alone(spark):
    from riskloom.operators.outliers import hard_cap as cap_frame

    df = spark.createDataFrame(
        [("CE", 1e6, 500.0), ("SE", -1.0, None), ("XX", 1e6, 500.0)],
        "experiencia string, saldoCuentas double, antiguedadBuroSBS double")
    assert [tuple(r)[1:] for r in cap_frame(df).collect()] == [(9855.32, 227.0), (0.0, None), (1e6, 500.0)]


def test_maps_as_a_table_equal_maps_as_expressions(spark):
    from riskloom.operators import woe
    from riskloom.settings import BIN_LABELS, FIXTURE_ROLES as roles, WOE_MAPS

    edges = sorted({c + d for m in WOE_MAPS.values() for c in m.cuts for d in (-0.01, 0, 0.01)}) + [None]
    rows = [(s, *[None if v is None else float(v)] * 5) for s in ("CE", "SE", "XX", None) for v in edges]
    named = [roles.score, roles.tenure, roles.balance, roles.balance_u3m, roles.balance_u6m]
    df = spark.createDataFrame(rows, ", ".join([f"{roles.segment} string", *[f"{c} double" for c in named]]))
    for maps, apply, suffix in ((WOE_MAPS, woe.woe_apply, "_woe"), (BIN_LABELS, woe.bin_label, "_bin")):
        names = list(dict.fromkeys(roles.column(role) for _, role in maps))
        plain = apply(df, roles).select(*df.columns, *[c + suffix for c in names])
        joined = woe.values_from_table(df, woe.map_table(spark, maps, roles), names, suffix, roles).select(*plain.columns)
        assert sorted(map(repr, joined.collect())) == sorted(map(repr, plain.collect()))
