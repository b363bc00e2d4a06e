"""Shallow weighted gini trees grown on contingency cells.

The data is read once: rows collapse to cells (model, feature values) that hold counts and weights of the
fitting rows, of those held out, and of each fold. All trees of all segments and folds then grow together, one
level per step, on those cells; a fold's training sums are the total less its own, so neither rows nor cells
are multiplied by folds. A raw feature of many values is held in at most ``MAX_BINS`` quantile bins, one of
fewer keeps its values, and the tree is the exact one. So a level's histograms are bounded by runs, nodes and
bins whatever the data, and one plan serves every size.

Nodes are numbered like a heap: the root is 1, the children of i are 2i and 2i + 1. A level's best cuts, one
row per run and node, come to the driver; nodes carry the interval of every feature as they are split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators.edges import bins_below
from riskloom.operators.metrics import auc, summary
from riskloom.operators.prefix import running_totals
from riskloom.plans.staging import stage
from riskloom.settings import (
    DEFAULT_ROLES, GRID_DEPTHS, GRID_RUNS, LEAF_SHARE, RAW_SCORE_MISSING, ModelRun, Roles,
)
from riskloom.sources.tables import local_rows

_FIT = ("n", "bad", "w", "wb")
_HELD = ("test_n", "test_bad")
#: most values of a raw feature before it is held in quantile bins
MAX_BINS = 1024
MAX_DEPTH = 10   # bounds the nodes of a level, which come to the driver
ALL = "all"


def per_run(choices: Mapping[str, Column], run: Column | str = "run") -> Column:
    """One of several columns by run."""
    run, chain = F.col(run) if isinstance(run, str) else run, None
    for name, made in choices.items():
        chain = F.when(run == name, made) if chain is None else chain.when(run == name, made)
    return F.lit(None) if chain is None else chain


def _features(run: ModelRun, roles: Roles, missing: float) -> list[tuple[str, str, Column]]:
    """(column name, kind, value) of the run's features; a raw feature's NULL gets ``missing``."""
    found = []
    for (_, kind), name in zip(run.features, run.feature_columns(roles)):
        value = F.col(name).cast("double")
        found.append((name, kind, value if kind == "woe" else F.coalesce(value, F.lit(missing))))
    return found


def raw_edges(
    df: DataFrame, runs: Sequence[ModelRun], roles: Roles, max_bins: int = MAX_BINS, missing: float = RAW_SCORE_MISSING
) -> dict[str, np.ndarray]:
    """Upper edges of the quantile bins of raw features with more than ``max_bins`` values, from one
    pass of sketches. WOE features have no more values than their map."""
    raw = {name: value for run in runs for name, kind, value in _features(run, roles, missing) if kind == "raw"}
    if not raw:
        return {}
    probs = F.lit(np.arange(1, max_bins) / max_bins)
    sketched = df.agg(*[
        F.struct(
            F.approx_count_distinct(v).alias("values"),
            F.percentile_approx(v, probs, F.lit(10 * max_bins)).alias("edges"),
        ).alias(name)
        for name, v in raw.items()
    ]).first()
    return {
        name: np.array(sorted(set(sketched[name]["edges"])), np.float64)
        for name in raw if sketched[name]["values"] > max_bins
    }


def feature_vector(
    run: ModelRun, roles: Roles, missing: float = RAW_SCORE_MISSING, edges: Mapping[str, np.ndarray] | None = None
) -> Column:
    """The run's features as an array of doubles; a binned one is the upper edge of its bin."""
    columns = []
    for name, kind, value in _features(run, roles, missing):
        if kind == "raw" and name in (edges or {}):
            uppers = F.lit(edges[name])
            value = F.coalesce(F.get(uppers, bins_below(value, uppers, F.lit(True))), F.lit(float("inf")))
        columns.append(value)
    return F.array(*columns)


def ways_of(n_folds: int) -> list[str]:
    return [ALL, *map(str, range(n_folds))]


def model_cells(
    df: DataFrame,
    runs: Sequence[ModelRun],
    roles: Roles = DEFAULT_ROLES,
    fitting: Column | None = None,
    held_out: Column | None = None,
    folds: Column | None = None,
    n_folds: int = 0,
    edges: Mapping[str, np.ndarray] | None = None,
) -> DataFrame:
    """Contingency cells (run, x, wide, ways) of all runs from one pass over the rows; ``edges`` are
    those of ``raw_edges``, which takes a pass of its own if they are not given.

    ``fitting`` and ``held_out`` are row conditions (train and test part by default). ``ways`` holds
    the sums of each way to fit: all fitting rows, and with ``folds`` the other folds' rows with the own fold held
    out. ``wide`` marks the features that are held in quantile bins.
    """
    fitting = F.col(roles.part) == "train" if fitting is None else fitting
    held_out = F.col(roles.part) == "test" if held_out is None else held_out
    edges = raw_edges(df, runs, roles) if edges is None else edges
    by_segment: dict = {}
    for run in runs:
        vector = feature_vector(run, roles, edges=edges)
        by_segment.setdefault(run.segment, []).append(F.struct(F.lit(run.model_id).alias("run"), vector.alias("x")))
    chosen = per_run({s: F.array(*made) for s, made in by_segment.items()}, roles.segment)

    rows = df.select(
        F.col(roles.label).cast("long").alias("__y"), F.col(roles.weight).cast("double").alias("__w"),
        fitting.alias("__fit"), held_out.alias("__held"),
        (F.lit(None).cast("int") if folds is None else folds).alias("__fold"), F.explode(chosen).alias("__m"),
    )
    y, w, one = F.col("__y"), F.col("__w"), F.lit(1).cast("long")
    values = {"n": one, "bad": y, "w": w, "wb": w * y}

    def sums(test: Column, names) -> dict[str, Column]:
        zero = {k: F.lit(0).cast("double" if k in ("w", "wb") else "long") for k in names}
        return {k: F.sum(F.when(test, values[k]).otherwise(zero[k])) for k in names}

    found = {f"fit_{k}": c for k, c in sums(F.col("__fit"), _FIT).items()}
    found |= {f"held_{k}": c for k, c in sums(F.col("__held"), ("n", "bad")).items()}
    for f in range(n_folds):
        found |= {f"fold{f}_{k}": c for k, c in sums(F.col("__fit") & (F.col("__fold") == f), _FIT).items()}
    cells = rows.groupBy(F.col("__m.run").alias("run"), F.col("__m.x").alias("x")).agg(
        *[c.alias(k) for k, c in found.items()]
    )

    def way(name: str) -> Column:
        own = name if name == ALL else f"fold{name}"
        less = lambda k: F.lit(0) if name == ALL else F.col(f"{own}_{k}")
        held = "held" if name == ALL else own
        return F.struct(
            *[(F.col(f"fit_{k}") - less(k)).alias(k) for k in _FIT],
            *[F.col(f"{held}_{k}").alias(f"test_{k}") for k in ("n", "bad")],
        )

    wide = {
        run.model_id: F.array(*[F.lit(kind == "raw" and name in edges) for name, kind, _ in _features(run, roles, 0.0)])
        for run in runs
    }
    return cells.select("run", "x", per_run(wide).alias("wide"), F.array(*map(way, ways_of(n_folds))).alias("ways"))


def way_cells(cells: DataFrame, n_folds: int = 0) -> DataFrame:
    """Cells of every tree: ``run`` alone, or ``<run>/all`` and ``<run>/<fold>``."""
    flat = cells.select("run", "x", "wide", F.posexplode("ways").alias("way", "sums"))
    if n_folds:
        names = F.lit(ways_of(n_folds))
        flat = flat.withColumn("run", F.concat("run", F.lit("/"), F.get(names, F.col("way"))))
    return flat.select("run", "x", "wide", *[F.col(f"sums.{k}").alias(k) for k in (*_FIT, *_HELD)])


def _weighted_gini(w: Column, wb: Column) -> Column:
    """Node weight times gini impurity: W * 2p(1 - p)."""
    return 2 * wb * F.coalesce(F.try_divide(w - wb, w), F.lit(0.0))


def split_candidates(cells: DataFrame) -> DataFrame:
    """Every cut of every feature in every node with its impurity decrease; ``fits`` marks those whose
    sides both keep ``min_leaf`` rows, in nodes of both classes.

    ``cells`` carry ``run, node, min_leaf, x, wide`` and the fitting sums.  A cut lies midway between
    neighbouring values seen in the node, or at the upper edge of a bin."""
    keys = ["run", "node", "feature"]
    flat = (
        cells.filter("n > 0")
        .select("run", "node", "min_leaf", "wide", *_FIT, F.posexplode("x").alias("feature", "value"))
        .groupBy(*keys, "value")
        .agg(F.max("min_leaf").alias("min_leaf"), F.any_value(F.get("wide", F.col("feature"))).alias("binned"),
             *[F.sum(s).alias(s) for s in _FIT])
    )
    # a histogram is bounded; one partitioning by node serves the windows and the choice of the best
    ranked = running_totals(flat.repartition("run", "node"), keys, "value", list(_FIT), bounded=True)
    left_w, left_wb = F.col("w_upto"), F.col("wb_upto")
    right_w, right_wb = F.col("w_total") - left_w, F.col("wb_total") - left_wb
    decrease = (
        _weighted_gini(F.col("w_total"), F.col("wb_total"))
        - _weighted_gini(left_w, left_wb)
        - _weighted_gini(right_w, right_wb)
    )
    fits = (
        (F.col("n_upto") >= F.col("min_leaf"))
        & (F.col("n_total") - F.col("n_upto") >= F.col("min_leaf"))
        & (F.col("n_upto") < F.col("n_total"))
        & (F.col("bad_total") > 0)
        & (F.col("bad_total") < F.col("n_total"))
    )
    middle = (F.col("value") + F.col("value_next")) / 2
    return ranked.select(
        *keys,
        F.when(F.col("binned"), F.col("value")).otherwise(middle).alias("threshold"),
        decrease.alias("decrease"),
        (decrease / F.col("w_total")).alias("gain"),
        *[F.col(f"{s}_total").alias(s) for s in _FIT],
        F.col("n_upto").alias("n_left"),
        fits.alias("fits"),
    )


def _preference() -> Column:
    """Largest gain first, then the earlier feature, then the lower cut."""
    return F.struct((-F.round("gain", 10)).alias("neg_gain"), "feature", "threshold")


def best_splits(candidates: DataFrame, per: Sequence[str] = ("run", "node")) -> DataFrame:
    """The totals and the best cut, if any fits, per node (or per node and feature)."""
    fits = F.col("fits")
    sums = F.min_by(F.struct(*_FIT), F.struct("feature", "threshold"))
    best = candidates.groupBy(*per).agg(
        sums.alias("t"),
        F.min_by(F.struct("decrease", "gain", "n_left"), F.when(fits, _preference())).alias("c"),
        F.min(F.when(fits, _preference())).alias("p"),
    )
    chosen = ["p.threshold"] if "feature" in per else ["p.feature", "p.threshold"]
    return best.select(*per, *chosen, F.when(F.col("p").isNotNull(), F.col("c")).alias("c"), "t.*").select(
        *per, *[c.split(".")[-1] for c in chosen], "c.*", *_FIT
    )


@dataclass
class _Tree:
    """One run's nodes while it grows: node -> a row of ``NODE``."""

    min_leaf: int
    width: int
    nodes: dict = field(default_factory=dict)
    bounds: dict = field(default_factory=dict)

    def __post_init__(self):
        self.bounds[1] = ([None] * self.width, [None] * self.width)

    def add(self, row, depth_left: bool) -> None:
        node, cut = row["node"], row["feature"] is not None and depth_left
        self.nodes[node] = (
            *[row[s] for s in _FIT], row["feature"] if cut else None, row["threshold"] if cut else None,
            row["decrease"] if cut else None, *self.bounds[node],
        )
        if cut:
            for right in (0, 1):
                ends = [list(side) for side in self.bounds[node]]
                ends[1 - right][row["feature"]] = row["threshold"]
                self.bounds[2 * node + right] = tuple(ends)

    def arrays(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Feature (-1: none) and threshold by node number, down to ``depth`` levels."""
        features, thresholds = np.full(1 << depth, -1, np.int32), np.zeros(1 << depth)
        for node, row in self.nodes.items():
            if row[4] is not None:
                features[node], thresholds[node] = row[4], row[5]
        return features, thresholds


NODE = (
    "run string, node int, n long, bad long, w double, wb double, feature int, threshold double, decrease double, "
    "lo array<double>, hi array<double>, variable string, depth int, p_bad double, is_leaf boolean"
)


@dataclass(frozen=True)
class GrownTrees:
    """``nodes``: one small row per node, with the interval (lo, hi] of every feature; ``cells``: the
    cells with their leaf ``node``; ``known``: the nodes by run and number, for compiling columns."""

    nodes: DataFrame
    cells: DataFrame
    runs: tuple
    roles: Roles
    max_depth: int
    known: dict

    def score_of(self, node: Column) -> Column:
        """P(bad) of a node of the row's ``run``; no join, the scores are literals."""
        scores = {name: np.full(2 << self.max_depth, np.nan) for name in self.known}
        for name, nodes in self.known.items():
            for number, found in nodes.items():
                scores[name][number] = np.nan if found["p_bad"] is None else found["p_bad"]
        return per_run({name: F.nullif(F.get(F.lit(v), node), F.lit(float("nan"))) for name, v in scores.items()})


def depth_of(node: Column) -> Column:
    return (F.length(F.bin(node)) - 1).cast("int")


def leaf_minimum(rows: Column, share: float = LEAF_SHARE) -> Column:
    return F.floor(F.lit(share) * rows).cast("long")


def counted_cells(cells: DataFrame, runs: Sequence[ModelRun]) -> tuple[DataFrame, dict[str, int]]:
    """The staged cells, and each run's fitting rows, observed while the cells are written."""
    seen = Observation()
    rows = F.get("ways", F.lit(0))["n"]
    named = [F.sum(F.when(F.col("run") == r.model_id, rows)).alias(f"rows{i}") for i, r in enumerate(runs)]
    staged = stage(cells.observe(seen, *named))
    return staged, {r.model_id: seen.get[f"rows{i}"] or 0 for i, r in enumerate(runs)}


def minimum_leaf(rows: int, share: float = LEAF_SHARE) -> int:
    return int(np.floor(share * rows))


def root_cells(cells: DataFrame, runs: Sequence[ModelRun]) -> DataFrame:
    """Cells of every run at its root, with the least leaf size."""
    staged, rows = counted_cells(cells, runs)
    least = per_run({name: F.lit(minimum_leaf(n)) for name, n in rows.items()})
    return way_cells(staged).withColumns({"node": F.lit(1), "min_leaf": least.cast("long")})


def placed(cells: DataFrame, trees: Mapping[str, _Tree], depth: int) -> DataFrame:
    """Cells with the node that holds them after ``depth`` levels and their tree's least leaf size."""
    literal = {name: tree.arrays(depth) for name, tree in trees.items()}
    with_tree = cells.withColumns({
        "__f": per_run({name: F.lit(a) for name, (a, _) in literal.items()}),
        "__t": per_run({name: F.lit(b) for name, (_, b) in literal.items()}),
        "min_leaf": per_run({name: F.lit(t.min_leaf) for name, t in trees.items()}).cast("long"),
    })

    def down(node: Column, _: Column) -> Column:
        feature = F.get("__f", node)
        right = F.coalesce(F.get("x", feature) > F.get("__t", node), F.lit(False)).cast("int")
        return F.when(feature >= 0, 2 * node + right).otherwise(node)

    steps = F.sequence(F.lit(1), F.lit(depth)) if depth else F.array().cast("array<int>")
    return with_tree.withColumn("node", F.aggregate(steps, F.lit(1), down)).drop("__f", "__t")


def grow(
    cells: DataFrame,
    runs: Sequence[ModelRun],
    roles: Roles = DEFAULT_ROLES,
    max_depth: int = 4,
    n_folds: int = 0,
) -> GrownTrees:
    """Grow all trees level by level.  A node without an admissible cut stays a leaf.  The least
    leaf is 5 % of a run's fitting rows, of all of them in every fold."""
    if max_depth > MAX_DEPTH:
        raise ValueError(f"trees are at most {MAX_DEPTH} levels deep")
    staged, rows = counted_cells(cells, runs)
    flat = way_cells(staged, n_folds)
    trees: dict[str, _Tree] = {}
    for run in runs:
        for way in ways_of(n_folds):
            name = f"{run.model_id}/{way}" if n_folds else run.model_id
            trees[name] = _Tree(minimum_leaf(rows[run.model_id]), len(run.features))
    for depth in range(max_depth + 1):
        level = placed(flat, trees, depth).filter((F.col("node") >= 2**depth) & (F.col("n") > 0))
        if depth < max_depth:
            found = best_splits(split_candidates(level))
        else:
            found = level.groupBy("run", "node").agg(*[F.sum(s).alias(s) for s in _FIT]).withColumns(
                {"feature": F.lit(None).cast("int"), "threshold": F.lit(None), "decrease": F.lit(None)}
            )
        # at most one row per run and node of this level
        level_rows = found.collect()
        for row in level_rows:
            trees[row["run"]].add(row, depth < max_depth)
        if not any(r["feature"] is not None for r in level_rows):
            break
    return _grown(flat, trees, runs, roles, max_depth)


def _share(bad: float, whole: float) -> float | None:
    """P(bad) to 12 digits, halves up: equal up to the order of summation means equal."""
    return float(Decimal(repr(bad / whole)).quantize(Decimal("1e-12"), ROUND_HALF_UP)) if whole else None


def _grown(flat: DataFrame, trees: Mapping[str, _Tree], runs, roles: Roles, max_depth: int) -> GrownTrees:
    named = {run.model_id: run.feature_columns(roles) for run in runs}
    rows, known = [], {name: {} for name in trees}
    for name, tree in trees.items():
        for node, (n, bad, w, wb, feature, *rest) in sorted(tree.nodes.items()):
            variable = None if feature is None else named[name.split("/")[0]][feature]
            row = (name, node, n, bad, w, wb, feature, *rest, variable, node.bit_length() - 1, _share(wb, w), feature is None)
            rows.append(row)
            known[name][node] = {"feature": feature, "threshold": rest[0], "is_leaf": feature is None, "p_bad": row[-2]}
    nodes = local_rows(flat.sparkSession, rows, NODE).coalesce(1)
    return GrownTrees(nodes, placed(flat, trees, max_depth), tuple(runs), roles, max_depth, known)


def _feature_names(runs: Sequence[ModelRun], roles: Roles) -> Column:
    names = {run.model_id: F.array(*[F.lit(name) for name in run.feature_columns(roles)]) for run in runs}
    return per_run(names, F.substring_index(F.col("run"), "/", 1))


def fit_trees(
    df: DataFrame, runs: Sequence[ModelRun], roles: Roles = DEFAULT_ROLES, max_depth: int = 4,
    max_bins: int = MAX_BINS,
) -> GrownTrees:
    """Fit every run on its segment's train part, with 5 % leaves. Raw features are looked at once
    before, so an expensive ``df`` is better staged or persisted."""
    return grow(model_cells(df, runs, roles, edges=raw_edges(df, runs, roles, max_bins)), runs, roles, max_depth)


def _importances(splits: DataFrame, roots: DataFrame, trees: GrownTrees) -> DataFrame:
    gained = splits.groupBy("run", "feature").agg(F.sum("decrease").alias("decrease"))
    whole = splits.groupBy("run").agg(F.sum("decrease").alias("all"))
    names = F.posexplode(_feature_names(trees.runs, trees.roles)).alias("feature", "variable")
    share = F.coalesce(F.try_divide(F.col("decrease"), F.col("all")), F.lit(0.0))
    return (
        roots.select("run", names)
        .join(gained, ["run", "feature"], "left")
        .join(whole, "run", "left")
        .select("run", "variable", share.alias("importancia"))
        .withColumn("rank", F.row_number().over(
            Window.partitionBy("run").orderBy(F.round("importancia", 12).desc(), "variable")
        ))
    )


def feature_importance(trees: GrownTrees) -> DataFrame:
    """Normalised impurity decrease per run and feature; an unused feature has 0."""
    return _importances(trees.nodes.filter(~F.col("is_leaf")), trees.nodes.filter("node = 1"), trees)


def leaf_conditions(trees: GrownTrees) -> DataFrame:
    """Bounds per leaf and used feature: lo < value <= hi, an open end is NULL."""
    return trees.nodes.filter("is_leaf").select(
        "run", F.col("node").alias("leaf"), F.posexplode(F.arrays_zip("lo", "hi")).alias("feature", "ends")
    ).select(
        "run", "leaf", "feature", F.get(_feature_names(trees.runs, trees.roles), F.col("feature")).alias("variable"),
        "ends.lo", "ends.hi",
    ).filter("lo is not null or hi is not null")


def tree_rules(trees: GrownTrees, decimals: int = 4) -> DataFrame:
    """One row per leaf with its conditions as text, its class weights and P(bad)."""

    def shown(name: str) -> Column:
        return F.format_string(f"%.{decimals}f", F.round(name, decimals))

    text = F.concat_ws(
        " AND ",
        F.when(F.col("lo").isNotNull(), F.concat("variable", F.lit(" > "), shown("lo"))),
        F.when(F.col("hi").isNotNull(), F.concat("variable", F.lit(" <= "), shown("hi"))),
    )
    rules = leaf_conditions(trees).groupBy("run", F.col("leaf").alias("node")).agg(
        F.array_sort(F.collect_list(F.struct("feature", text.alias("t")))).alias("parts")
    ).select("run", "node", F.concat_ws(" AND ", "parts.t").alias("regla"))
    return (
        trees.nodes.filter("is_leaf")
        .join(rules, ["run", "node"], "left")
        .select(
            "run", "node", "depth", F.coalesce("regla", F.lit("")).alias("regla"),
            "n", (F.col("w") - F.col("wb")).alias("peso_bueno"), F.col("wb").alias("peso_malo"),
            "p_bad",
        )
    )


def score_column(trees: GrownTrees, run: ModelRun, name: str | None = None) -> Column:
    """P(bad) of one tree as a CASE column of at most 2^depth arms."""
    nodes = trees.known[name or run.model_id]
    features = feature_vector(run, trees.roles)

    def branch(number: int) -> Column:
        node = nodes[number]
        if node["is_leaf"]:
            return F.lit(node["p_bad"])
        goes_right = F.get(features, F.lit(node["feature"])) > node["threshold"]
        return F.when(goes_right, branch(2 * number + 1)).otherwise(branch(2 * number))

    return branch(1)


def score_proba(
    df: DataFrame, trees: GrownTrees, runs: Sequence[ModelRun], output: str = "p_malo"
) -> DataFrame:
    """Add P(bad) of the given runs, one run per segment."""
    roles, chain = trees.roles, None
    for run in runs:
        test, score = F.col(roles.segment) == run.segment, score_column(trees, run)
        chain = F.when(test, score) if chain is None else chain.when(test, score)
    return df.withColumn(output, chain)


def leaf_scores(trees: GrownTrees, depth: int | None = None) -> DataFrame:
    """Score cells (run, particion, score) of the grown trees, also cut off at ``depth``."""
    node = F.col("node")
    if depth is not None:
        deeper = F.greatest(depth_of(node) - depth, F.lit(0))
        node = F.call_function("shiftright", node, deeper)
    scored = trees.cells.withColumn("node", node).withColumn("score", trees.score_of(F.col("node")))
    parts = F.explode(
        F.array(
            F.struct(F.lit("train").alias("particion"), F.col("n").alias("c"), F.col("bad").alias("b")),
            F.struct(F.lit("test").alias("particion"), F.col("test_n").alias("c"),
                     F.col("test_bad").alias("b")),
        )
    )
    return (
        scored.select("run", "score", parts.alias("p"))
        .groupBy("run", "p.particion", "score")
        .agg(F.sum("p.c").alias("n"), F.sum("p.b").alias("bad"))
        .filter("n > 0")
    )


def model_compare(trees: GrownTrees, depth: int | None = None) -> DataFrame:
    """AUC, GINI, KS and KS cut per run and part; a run has at most 2^depth scores."""
    return summary(leaf_scores(trees, depth), ["run", "particion"], bounded=True)


@dataclass(frozen=True)
class DepthSearch:
    """``scores``: run, depth, mean AUC, best flag; ``trees``: all folds and the refits."""

    scores: DataFrame
    trees: GrownTrees


def grid_search_depth(
    df: DataFrame,
    fold: Column,
    runs: Sequence[ModelRun] = GRID_RUNS,
    roles: Roles = DEFAULT_ROLES,
    depths: Sequence[int] = GRID_DEPTHS,
    n_folds: int = 3,
    edges: Mapping[str, np.ndarray] | None = None,
) -> DepthSearch:
    """Cross-validated choice of the depth by mean held-out AUC, smallest depth on ties.

    A tree of depth d is the top of the deeper tree, so each fold is grown once to the
    largest depth and scored at every depth.  The least leaf size is 5 % of all fitting
    rows in every fold.  All folds of all runs grow together.
    """
    model = F.substring_index("run", "/", 1)
    cells = model_cells(df, runs, roles, folds=fold, n_folds=n_folds, edges=edges)
    trees = grow(cells, runs, roles, max(depths), n_folds)

    # cells collapse to leaves once; each leaf row then stands for itself at every depth
    leaves = trees.cells.filter(~F.col("run").endswith(f"/{ALL}")).groupBy("run", "node").agg(
        F.sum("test_n").alias("n"), F.sum("test_bad").alias("bad")
    )
    deeper = F.greatest(depth_of(F.col("node")) - F.col("max_depth"), F.lit(0))
    cut = leaves.filter("n > 0").withColumn("max_depth", F.explode(F.lit(list(depths))))
    scored = cut.withColumn("node", F.call_function("shiftright", F.col("node"), deeper)).withColumn(
        "score", trees.score_of(F.col("node"))
    )
    by_score = scored.groupBy("run", "max_depth", "score").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    folds = auc(by_score, ["run", "max_depth"], bounded=True)
    mean = folds.groupBy(model.alias("run"), "max_depth").agg(F.avg("auc").alias("auc"))
    top = mean.groupBy("run").agg(
        F.min(F.struct((-F.round("auc", 10)).alias("a"), "max_depth")).alias("t")
    ).select("run", F.col("t.max_depth").alias("best_depth"))
    scores = mean.join(top, "run").select(
        "run", "max_depth", F.col("auc").alias("mean_auc"),
        (F.col("max_depth") == F.col("best_depth")).alias("is_best"),
    )
    return DepthSearch(scores, trees)


def best_importance(search: DepthSearch) -> DataFrame:
    """Importances of each model refitted on all rows at its best depth."""
    best = search.scores.filter("is_best").select(
        F.concat("run", F.lit("/all")).alias("run"), "max_depth"
    )
    refit = search.trees.nodes.join(best, "run").filter("depth < max_depth")
    found = _importances(
        refit.filter(~F.col("is_leaf")), refit.filter("node = 1"), search.trees
    )
    return found.withColumn("run", F.substring_index("run", "/", 1))
