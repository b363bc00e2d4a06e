
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics, segments, tree
from riskloom.operators.tree import model_cells
from riskloom.settings import CE, DEFAULT_ROLES, SE, WOE_MAPS, ModelRun

ROLES = replace(DEFAULT_ROLES)
RUNS = [
    ModelRun("A", CE, (("balance", "woe"), ("score", "woe"))),
    ModelRun("B", SE, (("balance", "woe"), ("score", "raw"))),
]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    made = []
    for i in range(3000):
        seg = CE if i % 3 else SE
        balance = draw.choice(WOE_MAPS[(seg, "balance")].values)
        score = None if i % 31 == 0 else draw.randint(700, 990)
        woe = draw.choice(WOE_MAPS[(seg, "score")].values)
        p = 0.25 - 0.15 * balance - 0.05 * woe + (0.1 if (score or 0) < 800 else 0)
        made.append((seg, "train" if i % 4 else "test", int(draw.random() < p), balance, woe, score))
    return made


@pytest.fixture(scope="module")
def frame(spark, rows):
    df = spark.createDataFrame(
        rows, "experiencia string, particion string, y int, saldoCuentas_woe double, "
              "scoreBuro_woe double, scoreBuro int").repartition(4)
    return df.withColumn("weight", F.when(F.col("y") == 1, 4.0).otherwise(0.5))


@pytest.fixture(scope="module")
def trees(frame):
    return tree.fit_trees(frame, RUNS, ROLES)


def gini(w, wb):
    return 2 * wb * (w - wb) / w if w else 0.0


def cart(data, min_leaf, depth, node=1):
    """Recursive weighted-gini tree: largest gain, then first feature, then lowest cut."""
    n, bad = len(data), sum(y for _, y, _ in data)
    w, wb = sum(d[2] for d in data), sum(d[2] for d in data if d[1])
    out = {node: (None, None, n, bad)}
    if depth == 0 or bad in (0, n):
        return out
    best = None
    for f in range(len(data[0][0])):
        values = sorted({x[f] for x, _, _ in data})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            left = [d for d in data if d[0][f] <= cut]
            if len(left) < min_leaf or n - len(left) < min_leaf:
                continue
            lw, lb = sum(d[2] for d in left), sum(d[2] for d in left if d[1])
            gain = round((gini(w, wb) - gini(lw, lb) - gini(w - lw, wb - lb)) / w, 10)
            if best is None or gain > best[0]:
                best = (gain, f, cut)
    if best is None:
        return out
    _, f, cut = best
    out[node] = (f, cut, n, bad)
    out.update(cart([d for d in data if d[0][f] <= cut], min_leaf, depth - 1, 2 * node))
    out.update(cart([d for d in data if d[0][f] > cut], min_leaf, depth - 1, 2 * node + 1))
    return out


def vectors(rows, seg, part, raw):
    return [
        ((r[3], float(r[5] or 0) if raw else r[4]), r[2], 4.0 if r[2] else 0.5)
        for r in rows if r[0] == seg and r[1] == part
    ]


@pytest.mark.parametrize("run,seg,raw", [("A", CE, False), ("B", SE, True)])
def test_tree_equals_recursive_search(trees, rows, run, seg, raw):
    data = vectors(rows, seg, "train", raw)
    expected = cart(data, int(0.05 * len(data)), 4)
    got = {r["node"]: (r["feature"], r["threshold"], r["n"], r["bad"])
           for r in trees.nodes.filter(F.col("run") == run).collect()}
    assert got == expected


def test_intervals_come_with_the_nodes(trees, frame):
    """Every leaf's interval holds exactly its rows."""
    train = frame.filter("experiencia = 'SE' and particion = 'train'").withColumn("s", F.coalesce("scoreBuro", F.lit(0)))
    for r in trees.nodes.filter("is_leaf and run = 'B'").collect():
        inside = F.lit(True)
        for column, lo, hi in zip(("saldoCuentas_woe", "s"), r["lo"], r["hi"]):
            inside &= (F.lit(lo is None) if lo is None else F.col(column) > lo) & (F.lit(True) if hi is None else F.col(column) <= hi)
        assert train.filter(inside).count() == r["n"]


def continuous(spark, n=4000):
    draw = random.Random(8)
    made = []
    for i in range(n):
        score = draw.gauss(0, 100)
        made.append((SE, "train" if i % 4 else "test", int(draw.random() < (0.3 if score > 20 else 0.1)), 0.1 * (i % 3), score))
    df = spark.createDataFrame(made, "experiencia string, particion string, y int, saldoCuentas_woe double, scoreBuro double")
    return made, df.repartition(4).withColumn("weight", F.when(F.col("y") == 1, 4.0).otherwise(0.5))


def test_nearly_continuous_features_grow_on_bins(spark):
    made, df = continuous(spark)
    binned = tree.fit_trees(df, RUNS[1:], ROLES, max_bins=64)
    data = [((r[3], r[4]), r[2], 4.0 if r[2] else 0.5) for r in made if r[1] == "train"]
    exact = cart(data, int(0.05 * len(data)), 4)
    nodes = {r["node"]: r for r in binned.nodes.collect()}
    assert nodes[1]["feature"] == exact[1][0] == 1
    near = sum(min(exact[1][1], nodes[1]["threshold"]) < x[1] <= max(exact[1][1], nodes[1]["threshold"]) for x, _, _ in data)
    assert near <= 2 * len(data) / 64
    assert binned.cells.select(F.get("x", F.lit(1))).distinct().count() <= 64
    # thresholds are bin edges: rows that never were in a cell go the same way
    scored = tree.score_proba(df, binned, RUNS[1:]).filter("particion = 'train'")
    counts = {round(r["p_malo"], 12): r["count"] for r in scored.groupBy("p_malo").count().collect()}
    leaves = {}
    for r in nodes.values():
        if r["is_leaf"]:
            leaves[round(r["p_bad"], 12)] = leaves.get(round(r["p_bad"], 12), 0) + r["n"]
    assert counts == leaves


def test_bins_of_all_values_give_the_exact_tree(spark):
    made, df = continuous(spark, 1500)
    data = [((r[3], r[4]), r[2], 4.0 if r[2] else 0.5) for r in made if r[1] == "train"]
    expected = cart(data, int(0.05 * len(data)), 4)
    grown = tree.fit_trees(df, RUNS[1:], ROLES, max_bins=5000)
    assert {r["node"]: (r["feature"], r["threshold"], r["n"], r["bad"]) for r in grown.nodes.collect()} == expected


def test_folds_do_not_multiply_cells(frame):
    runs = [replace(RUNS[0], model_id="g", max_depth=5)]
    plain = model_cells(frame, runs, ROLES)
    folded = model_cells(frame, runs, ROLES, folds=F.pmod(F.xxhash64("y", "scoreBuro"), F.lit(3)).cast("int"), n_folds=3)
    assert folded.count() == plain.count()
    for r in folded.collect():
        whole, *parts = r["ways"]
        assert all(whole["n"] - p["n"] == p["test_n"] for p in parts)
        assert sum(p["test_n"] for p in parts) == whole["n"]


def test_leaves_keep_the_minimum_and_cover_all_rows(trees, rows):
    for run, seg in (("A", CE), ("B", SE)):
        n = sum(1 for r in rows if r[0] == seg and r[1] == "train")
        leaves = trees.nodes.filter((F.col("run") == run) & F.col("is_leaf")).collect()
        assert sum(r["n"] for r in leaves) == n
        assert min(r["n"] for r in leaves) >= int(0.05 * n)


def auc_by_pairs(scored):
    goods = [s for s, y in scored if not y]
    bads = [s for s, y in scored if y]
    hits = sum((b > g) + 0.5 * (b == g) for b in bads for g in goods)
    return hits / (len(goods) * len(bads))


def test_scores_and_metrics_equal_pair_counting(frame, trees):
    scored = tree.score_proba(frame, trees, RUNS)
    compared = {(r["run"], r["particion"]): r for r in tree.model_compare(trees).collect()}
    for run in RUNS:
        for part in ("train", "test"):
            mine = scored.filter((F.col("experiencia") == run.segment) & (F.col("particion") == part))
            pairs = [(r["p_malo"], r["y"]) for r in mine.collect()]
            row = compared[(run.model_id, part)]
            assert row["n"] == len(pairs)
            assert row["auc"] == pytest.approx(auc_by_pairs(pairs), abs=1e-12)
            assert row["gini"] == pytest.approx(2 * row["auc"] - 1)
            best = max(
                (round(sum(1 for s, y in pairs if y and s >= t) / sum(y for _, y in pairs)
                       - sum(1 for s, y in pairs if not y and s >= t) / sum(1 - y for _, y in pairs), 12), t)
                for t in {s for s, _ in pairs})
            assert (row["ks"], row["cut"]) == (pytest.approx(best[0]), best[1])
    assert compared[("A", "train")]["auc"] >= 0.5


def test_auc_equals_the_library_evaluator(frame, trees):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    scored = tree.score_proba(frame, trees, RUNS).filter("particion = 'test' and experiencia = 'CE'")
    measure = BinaryClassificationEvaluator(rawPredictionCol="p_malo", labelCol="y", numBins=0)
    mine = tree.model_compare(trees).filter("run = 'A' and particion = 'test'").first()["auc"]
    assert mine == pytest.approx(measure.evaluate(scored.select("p_malo", "y")), abs=1e-12)


def test_criterion_equals_the_library_tree(spark, frame, trees):
    """A weighted variance tree on the 0/1 label chooses by the same criterion at the root."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    train = frame.filter("experiencia = 'CE' and particion = 'train'").withColumn("label", F.col("y").cast("double"))
    rows = VectorAssembler(inputCols=["saldoCuentas_woe", "scoreBuro_woe"], outputCol="features").transform(train)
    model = DecisionTreeRegressor(maxDepth=1, weightCol="weight", minInstancesPerNode=int(0.05 * train.count()),
                                  maxBins=64).fit(rows)
    root = trees.nodes.filter("run = 'A' and node = 1").first()
    side = F.col(root["variable"]) <= root["threshold"]
    means = {r["s"]: r["p"] for r in rows.groupBy(side.alias("s")).agg(
        (F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).alias("p")).collect()}
    predicted = {round(r["prediction"], 9) for r in model.transform(rows).select("prediction").distinct().collect()}
    assert predicted == {round(p, 9) for p in means.values()}


def test_importances_sum_to_one(trees):
    got = tree.feature_importance(trees).groupBy("run").agg(F.sum("importancia").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in got) and len(got) == 2


def test_rules_pick_exactly_the_leaf_rows(frame, trees):
    train = frame.filter("experiencia = 'CE' and particion = 'train'")
    for r in tree.tree_rules(trees, decimals=9).filter("run = 'A'").collect():
        assert train.filter(F.expr(r["regla"])).count() == r["n"]
        assert r["p_bad"] == pytest.approx(r["peso_malo"] / (r["peso_malo"] + r["peso_bueno"]))


def test_pure_and_tiny_data_stay_a_root(spark):
    rows = [(CE, "train", 0, 0.1 * i, 0.2, 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "experiencia string, particion string, y int, "
                                     "saldoCuentas_woe double, scoreBuro_woe double, weight double")
    grown = tree.fit_trees(df, RUNS[:1], ROLES)
    assert [(r["node"], r["is_leaf"], r["p_bad"]) for r in grown.nodes.collect()] == [(1, True, 0.0)]
    row = tree.model_compare(grown).first()
    assert row["auc"] is None and row["cut"] is None
    assert tree.tree_rules(grown).first()["regla"] == ""


def test_depth_search_scores_are_held_out(frame, rows):
    runs = [replace(RUNS[0], model_id="g", max_depth=5)]
    keyed = frame.withColumn("fold", F.pmod(F.xxhash64("saldoCuentas_woe", "scoreBuro_woe", "y"), F.lit(3)).cast("int"))
    found = tree.grid_search_depth(keyed, F.col("fold"), runs, ROLES)
    scores = found.scores.collect()
    assert [r["max_depth"] for r in sorted(scores, key=lambda r: r["max_depth"])] == [3, 4, 5]
    best = [r for r in scores if r["is_best"]]
    assert len(best) == 1 and best[0]["mean_auc"] == max(r["mean_auc"] for r in scores)
    local = [(r["fold"], (r["saldoCuentas_woe"], r["scoreBuro_woe"]), r["y"]) for r in
             keyed.filter("experiencia = 'CE' and particion = 'train'").collect()]
    least = int(0.05 * len(local))
    for depth in (3, 5):
        aucs = []
        for k in range(3):
            nodes = cart([(x, y, 4.0 if y else 0.5) for f, x, y in local if f != k], least, depth)

            def score(x):
                node = 1
                while nodes[node][0] is not None:
                    node = 2 * node + (x[nodes[node][0]] > nodes[node][1])
                _, _, n, bad = nodes[node]
                return round(bad * 4.0 / (bad * 4.0 + (n - bad) * 0.5), 12)

            aucs.append(auc_by_pairs([(score(x), y) for f, x, y in local if f == k]))
        mine = next(r["mean_auc"] for r in scores if r["max_depth"] == depth)
        assert mine == pytest.approx(sum(aucs) / 3, abs=1e-9)


def test_segments_cover_every_bin_once(trees):
    bins = segments.leaf_bins(trees).filter("run = 'A'")
    cells = segments.grid_cells(trees).filter("run = 'A'")
    n_rows = len(WOE_MAPS[(CE, "balance")].values) + 1
    n_columns = len(WOE_MAPS[(CE, "score")].values) + 1
    assert cells.count() == cells.select("fila_pos", "columna_pos").distinct().count() == n_rows * n_columns
    assert bins.count() >= n_rows + n_columns
    wide = segments.risk_grid(trees, RUNS[:1]).collect()
    assert len(wide) == n_rows and all(v is not None for r in wide for v in r)


def test_segment_table_is_ordered_and_sums_to_one(trees):
    table = segments.leaf_segments(trees)
    mine = table.filter("run = 'A'").orderBy("p_bad", "node").collect()
    assert [r["grupo"] for r in mine] == [f"G{i}" for i in range(1, len(mine) + 1)]
    assert [r["p_bad"] for r in mine] == sorted(r["p_bad"] for r in mine)
    assert all(r["clase"] == ("Malo" if r["p_bad"] > 0.5 else "Bueno") for r in mine)
    assert all(r["cuadra"] for r in segments.leaf_share_check(table).collect())


def test_cut_sides_follow_woe_values(trees):
    for r in segments.woe_cut_to_bins(trees).collect():
        assert r["lado"] == ("izquierda" if r["woe"] <= r["threshold"] else "derecha")


def test_grid_of_several_segments_has_every_score_bin(trees):
    whole = segments.risk_grid(trees, RUNS)
    for run in RUNS:
        part = segments.risk_grid(trees, [run])
        assert set(part.columns) <= set(whole.columns)
        same = whole.filter(F.col("run") == run.model_id).select(*[f"`{c}`" for c in part.columns])
        assert sorted(map(tuple, same.collect()), key=str) == sorted(map(tuple, part.collect()), key=str)


def test_metrics_on_ties_one_class_and_no_separation(spark):
    rows = [("tie", 0.5, 0), ("tie", 0.5, 1), ("one", 0.1, 1), ("one", 0.9, 1),
            ("up", 0.1, 0), ("up", 0.9, 1), ("down", 0.9, 0), ("down", 0.1, 1), ("up", None, 1)]
    cells = metrics.score_cells(spark.createDataFrame(rows, "k string, s double, y int"), ["k"], "s")
    got = {r["k"]: r for r in metrics.summary(cells, ["k"]).collect()}
    assert [got[k]["auc"] for k in ("tie", "one", "up", "down")] == [0.5, None, 1.0, 0.0]
    assert [got[k]["cut"] for k in ("tie", "one", "up", "down")] == [None, None, 0.9, None]
    curve = metrics.roc_curve(cells, ["k"]).filter("k = 'up'").orderBy(F.desc("threshold")).collect()
    assert [(r["threshold"], r["tpr"], r["fpr"]) for r in curve] == [(0.9, 1.0, 0.0), (0.1, 1.0, 1.0)]


def test_cells_merge_rows_before_the_shuffle(frame):
    plan = model_cells(frame, RUNS, ROLES, edges={})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "partial_sum" in plan



@pytest.mark.parametrize("bounded", [True, False])
def test_thinned_curve_keeps_corners_area_and_cut(spark, bounded):
    draw = random.Random(9)
    rows = [(k, draw.random() if k != "flat" else 0.1 * (i % 5), int(draw.random() < 0.3)) for k in ("a", "b", "flat") for i in range(300)]
    cells = metrics.score_cells(spark.createDataFrame(rows, "k string, s double, y int"), ["k"], "s")
    full, thin = metrics.roc_curve(cells, ["k"], bounded), metrics.thinned_curve(cells, ["k"], bounded)
    for k in ("a", "b", "flat"):
        whole, kept = ([(r["threshold"], r["tpr"], r["fpr"]) for r in c.filter(F.col("k") == k).orderBy(F.desc("threshold")).collect()]
                       for c in (full, thin))
        seen = sorted({s for name, s, _ in rows if name == k}, reverse=True)
        steps = [(sum(1 for n, s, y in rows if n == k and s == t and y), sum(1 for n, s, y in rows if n == k and s == t and not y)) for t in seen]
        want = [t for i, t in enumerate(seen) if i in (0, len(seen) - 1) or steps[i] != steps[i + 1]]
        assert [t for t, _, _ in kept] == want and set(kept) <= set(whole)

        def area(curve):
            points = [(0.0, 0.0)] + [(f, t) for _, t, f in curve]
            return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))

        assert area(kept) == pytest.approx(area(whole), abs=1e-12)
        assert max(round(t - f, 12) for _, t, f in kept) == max(round(t - f, 12) for _, t, f in whole)
