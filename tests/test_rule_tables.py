import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions.rules import RULE_SCHEMA, parse_rules, rules_frame
from riskloom.operators import rule_tables
from riskloom.settings import (
    NO_PROFILE, RULES_FA_CE, RULES_FA_CE_ORIGINAL, RULES_FA_SE, RULES_FA_SE_ORIGINAL, RULES_U3M_CE, RULES_U6M_SE,
)

TABLES = {
    "ce": RULES_FA_CE, "se": RULES_FA_SE, "ce0": RULES_FA_CE_ORIGINAL, "se0": RULES_FA_SE_ORIGINAL,
    "u3": RULES_U3M_CE, "u6": RULES_U6M_SE,
    "odd": [(5, 5, None, None, False, "never"), (None, None, 1, (1, True), True, "point"), (None, None, None, None, False, "all"),
            ((3, False), (9, True), None, 4, True, "open")],
}


def points(table, seed=0):
    draw, axes = random.Random(seed), []
    for ends in ((0, 1), (2, 3)):
        limits = {v[0] if isinstance(v, tuple) else v for r in table for v in (r[k] for k in ends)} - {None}
        axes.append([None, float("nan"), -1e9, 1e9, *(x + d for x in limits for d in (-0.01, 0.0, 0.01))])
    return [(s, b) for s in axes[0] for b in axes[1] if draw.random() < 0.7]


def held(table, s, b):
    def inside(band, v):  # NaN lies beyond every limit
        return band.high is None if v is not None and v != v else band.holds(v)

    return [r.label for r in parse_rules(table)
            if inside(r.score, s) and (inside(r.balance, b) or (r.null_balance and b is None))]


@pytest.fixture(scope="module")
def rules(spark):
    return rules_frame(spark, TABLES)


def test_slot_index_equals_the_rules(spark, rules):
    rows = [(name, s, b) for name, table in TABLES.items() for s, b in points(table)] + [("none", 1.0, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "t string, s double, b double")
    out = rule_tables.profile_by_table(df, rules, F.col("t"), F.col("s"), F.col("b"), "perfil")
    got = out.collect()
    assert out.columns == ["t", "s", "b", "perfil"] and len(got) == len(rows)
    for r in got:
        assert r["perfil"] == (held(TABLES.get(r["t"], []), r["s"], r["b"]) or [NO_PROFILE])[0]


def test_every_gap_and_overlap_lies_in_one_rectangle(spark, rules):
    found = {}
    for r in rule_tables.rule_rectangles(rules).collect():
        found.setdefault(r["tabla"], []).append(r)

    def inside(r, axis, v):
        if v is None or r[f"{axis}_nulo"]:
            return v is None and r[f"{axis}_nulo"]
        low, high = r[f"{axis}_min"], r[f"{axis}_max"]
        return (low is None or v > low or (v == low and r[f"{axis}_min_incl"])) and (
            high is None or v < high or (v == high and r[f"{axis}_max_incl"]))

    for name, table in TABLES.items():
        for s, b in points(table, 1):
            if s != s or b != b:
                continue
            match = held(table, s, b)
            mine = [r for r in found.get(name, []) if inside(r, "score", s) and inside(r, "saldo", b)]
            assert len(mine) == (len(match) != 1), (name, s, b)
            if mine:
                assert mine[0]["reglas"] == ",".join(match) and mine[0]["gana"] == (match[0] if match else None)
        for r in found.get(name, []):  # the witness lies inside
            assert ",".join(held(table, r["testigo_score"], r["testigo_saldo"])) == r["reglas"]


def test_the_known_faults_of_the_tables(rules):
    rows = rule_tables.rule_rectangles(rules).collect()
    gaps = [r for r in rows if r["tipo"] == "hueco" and not (r["score_nulo"] or r["saldo_nulo"])]
    at_552 = [r for r in gaps if r["tabla"] == "ce0" and r["saldo_min"] == r["saldo_max"] == 552.0]
    assert [(r["score_min"], r["score_max"], r["saldo_min_incl"], r["saldo_max_incl"]) for r in at_552] == [(894.0, 960.0, True, True)]
    assert not [r for r in gaps if r["tabla"] == "ce" and r["saldo_min"] == 552.0 == r["saldo_max"]]
    assert [r for r in gaps if r["tabla"] == "se0" and r["score_min"] == 920.0 and r["score_max"] == 940.0 and r["saldo_max"] == 6.14]
    assert not [r for r in gaps if r["tabla"] == "se" and r["saldo_max"] == 6.14 and r["score_max"] == 940.0]
    assert [r for r in rows if r["tabla"] == "ce" and r["tipo"] == "traslape" and r["saldo_min"] == 7.26 == r["saldo_max"]]


def test_thousands_of_tables_in_one_join(spark):
    count = 3000
    low = F.col("k") * 10.0 + F.col("id") % 7
    rules = spark.range(count).select(
        F.concat(F.lit("t"), "id").alias("tabla"), "id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")
    ).select(
        "tabla", F.col("k").cast("int").alias("orden"), low.alias("score_min"), F.lit(True).alias("score_min_incl"),
        (low + 12).alias("score_max"), F.lit(False).alias("score_max_incl"), F.lit(None).cast("double").alias("saldo_min"),
        F.lit(True).alias("saldo_min_incl"), F.lit(None).cast("double").alias("saldo_max"), F.lit(False).alias("saldo_max_incl"),
        F.lit(False).alias("incluye_missing"), F.concat(F.lit("C_"), "k").alias("etiqueta"),
    )
    assert [f.name for f in RULE_SCHEMA] == rules.columns
    df = spark.range(20_000).select("id", F.concat(F.lit("t"), F.col("id") % count).alias("t"), (F.col("id") % 71).cast("double").alias("s"))
    out = rule_tables.profile_by_table(df, rules, F.col("t"), F.col("s"), F.lit(1.0), "perfil")
    for r in out.filter("id % 13 = 0").collect():
        base = (r["id"] % count) % 7
        match = [k for k in range(1, 5) if 10 * k + base <= r["s"] < 10 * k + base + 12]
        assert r["perfil"] == (f"C_{match[0]}" if match else NO_PROFILE)
    boxes = rule_tables.rule_rectangles(rules).groupBy("tabla").count().select("count").distinct().collect()
    assert [r[0] for r in boxes] == [boxes[0][0]]  # the same faults in every table


def test_counts_by_slot_add_up(spark, rules):
    rows = [("ce0", s, b) for s, b in points(RULES_FA_CE_ORIGINAL, 2)]
    df = spark.createDataFrame(rows, "t string, s double, b double")
    counts = rule_tables.rows_by_slot(df, rules, F.col("t"), F.col("s"), F.col("b"))
    assert counts.agg(F.sum("filas")).first()[0] == len(rows)
    in_boxes = rule_tables.rule_rectangles(rules, counts).filter("tabla = 'ce0'").agg(F.sum("filas")).first()[0]
    assert in_boxes == sum(len(held(RULES_FA_CE_ORIGINAL, s, b)) != 1 for _, s, b in rows)


def test_no_rules(spark):
    none = spark.createDataFrame([], RULE_SCHEMA)
    assert rule_tables.rule_rectangles(none).count() == 0
    df = spark.createDataFrame([("x", 1.0)], "t string, s double")
    assert rule_tables.profile_by_table(df, none, F.col("t"), F.col("s"), F.col("s"), "p").first()["p"] == NO_PROFILE
