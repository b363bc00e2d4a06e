"""Readable segment tables and risk grids from grown trees.

Nodes and configured bins are a few dozen rows in one partition, so all of this is one task without a
shuffle; intervals come with the nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.cuts import bins_of
from riskloom.operators.tree import GrownTrees, leaf_conditions
from riskloom.settings import WOE_MAPS, ModelRun
from riskloom.sources.tables import local_rows

_BIN_SCHEMA = (
    "run string, feature int, variable string, position int, left_text string, "
    "right_text string, bin string, woe double, is_missing boolean"
)
# Which range column a feature's role fills.
_RANGE_COLUMNS = {
    "score": "rango_score", "tenure": "rango_antiguedad",
    "balance": "rango_saldo", "balance_u3m": "rango_saldo", "balance_u6m": "rango_saldo",
}


def feature_bins(trees: GrownTrees, maps=WOE_MAPS) -> DataFrame:
    """The WOE bins of every WOE feature of every run: a few dozen configuration rows."""
    rows = []
    for run in trees.runs:
        names = run.feature_columns(trees.roles)
        for index, ((role, kind), name) in enumerate(zip(run.features, names)):
            if kind != "woe":
                continue
            for b in bins_of(maps[(run.segment, role)]):
                left, _, right = b["text"].partition(", ")
                rows.append(
                    (run.model_id, index, name, b["position"], left, right, b["text"],
                     float(b["value"]), b["is_missing"])
                )
    return local_rows(trees.nodes.sparkSession, rows, _BIN_SCHEMA).coalesce(1)


def ranked_leaves(trees: GrownTrees) -> DataFrame:
    """Leaves with their group (G1 has the lowest P(bad)), share of rows and class."""
    order = Window.partitionBy("run").orderBy("p_bad", "node")
    whole = Window.partitionBy("run")
    return trees.nodes.filter("is_leaf").select(
        "run", "node", "n", "bad", "p_bad",
        F.row_number().over(order).alias("orden"),
        (F.col("n") / F.sum("n").over(whole)).alias("muestra"),
        F.when(F.col("p_bad") > 0.5, "Malo").otherwise("Bueno").alias("clase"),
    ).withColumn("grupo", F.concat(F.lit("G"), F.col("orden").cast("string")))


def leaf_bins(trees: GrownTrees, maps=WOE_MAPS) -> DataFrame:
    """The bins that fall into each leaf, per WOE feature, decided by their WOE value."""
    leaves = trees.nodes.filter("is_leaf").select("run", F.col("node").alias("leaf"), "lo", "hi")
    low = F.coalesce(F.get("lo", F.col("feature")), F.lit(float("-inf")))
    high = F.coalesce(F.get("hi", F.col("feature")), F.lit(float("inf")))
    return (
        leaves.join(feature_bins(trees, maps), "run")
        .filter((F.col("woe") > low) & (F.col("woe") <= high))
        .drop("lo", "hi")
    )


def _woe_ranges(trees: GrownTrees, maps) -> DataFrame:
    """Bins of a leaf merged to contiguous ranges, e.g. ``[920, 971) o missing``."""
    by_leaf = ["run", "leaf", "feature", "variable"]
    order = Window.partitionBy(*by_leaf, "is_missing").orderBy("position")
    islands = (
        leaf_bins(trees, maps)
        .withColumn("island", F.col("position") - F.row_number().over(order))
        .groupBy(*by_leaf, "is_missing", "island")
        .agg(
            F.min("position").alias("position"),
            F.min_by("left_text", "position").alias("from_text"),
            F.max_by("right_text", "position").alias("to_text"),
        )
    )
    text = F.when(F.col("is_missing"), F.lit("missing")).otherwise(
        F.concat("from_text", F.lit(", "), "to_text")
    )
    return islands.groupBy(*by_leaf).agg(
        F.array_sort(F.collect_list(F.struct("position", text.alias("t")))).alias("parts")
    ).select(*by_leaf, F.concat_ws(" o ", "parts.t").alias("rango"))


def _raw_ranges(trees: GrownTrees) -> DataFrame:
    bounds = leaf_conditions(trees)
    shown = F.concat(
        F.when(F.col("lo").isNull(), F.lit("(-inf")).otherwise(
            F.concat(F.lit("("), F.format_string("%.2f", F.round("lo", 2)))
        ),
        F.lit(", "),
        F.when(F.col("hi").isNull(), F.lit("inf)")).otherwise(
            F.concat(F.format_string("%.2f", F.round("hi", 2)), F.lit("]"))
        ),
    )
    raw = None
    for run in trees.runs:
        for index, (_, kind) in enumerate(run.features):
            if kind == "raw":
                test = (F.col("run") == run.model_id) & (F.col("feature") == index)
                raw = test if raw is None else raw | test
    chosen = bounds.filter(F.lit(False) if raw is None else raw)
    return chosen.select("run", "leaf", "feature", "variable", shown.alias("rango"))


def _range_column(trees: GrownTrees) -> Column:
    chain = F.lit(None).cast("string")
    for run in trees.runs:
        for index, (role, _) in enumerate(run.features):
            test = (F.col("run") == run.model_id) & (F.col("feature") == index)
            chain = F.when(test, _RANGE_COLUMNS[role]).otherwise(chain)
    return chain


def leaf_segments(trees: GrownTrees, maps=WOE_MAPS) -> DataFrame:
    """One row per leaf: group, real range of each variable, share, P(bad), class.

    A range that the tree does not restrict is NULL for a raw feature and the whole
    axis with missing for a WOE feature.
    """
    ranges = _woe_ranges(trees, maps).unionByName(_raw_ranges(trees))
    wide = (
        ranges.withColumn("columna", _range_column(trees))
        .groupBy("run", F.col("leaf").alias("node"))
        .pivot("columna", ["rango_score", "rango_saldo", "rango_antiguedad"])
        .agg(F.first("rango"))
    )
    return (
        ranked_leaves(trees)
        .join(wide, ["run", "node"], "left")
        .select(
            "run", "grupo", "node", "rango_score", "rango_saldo", "rango_antiguedad",
            "n", "muestra", "p_bad", "clase",
        )
    )


def leaf_share_check(segments: DataFrame) -> DataFrame:
    """Shares per run and whether they add up to 100 %."""
    total = F.sum("muestra")
    return segments.groupBy("run").agg(
        F.count(F.lit(1)).alias("grupos"), total.alias("suma"),
        (F.abs(total - 1) < 1e-9).alias("cuadra"),
    )


def woe_cut_to_bins(trees: GrownTrees, maps=WOE_MAPS) -> DataFrame:
    """For every WOE cut of a tree, the bins on its low and on its high side.

    Bins are compared by WOE value, never by range order: a WOE map need not be monotone
    and the missing bin has its own value.
    """
    cuts = trees.nodes.filter(~F.col("is_leaf")).select("run", "node", "feature", "threshold")
    side = F.when(F.col("woe") <= F.col("threshold"), "izquierda").otherwise("derecha")
    return cuts.join(feature_bins(trees, maps), ["run", "feature"]).select(
        "run", "node", "variable", "threshold", "position", "bin", "woe", side.alias("lado")
    )


def grid_cells(trees: GrownTrees, rows: int = 0, columns: int = 1, maps=WOE_MAPS) -> DataFrame:
    """Every bin combination of two features with the group of the leaf that holds it.

    Each leaf contributes its own row bins and column bins, matched on the leaf.
    """
    bins = leaf_bins(trees, maps)

    def side(index: int, name: str) -> DataFrame:
        return bins.filter(F.col("feature") == index).select(
            "run", "leaf", F.col("position").alias(f"{name}_pos"), F.col("bin").alias(f"{name}_bin")
        )

    leaves = ranked_leaves(trees).select(
        "run", F.col("node").alias("leaf"), "grupo", F.col("p_bad")
    )
    return side(rows, "fila").join(side(columns, "columna"), ["run", "leaf"]).join(
        leaves, ["run", "leaf"]
    ).drop("leaf")


def risk_grid(trees: GrownTrees, runs: Sequence[ModelRun], maps=WOE_MAPS) -> DataFrame:
    """Balance bins as rows and score bins as columns; each cell names the group and its P(bad).

    Runs of several segments stand below each other; a score bin that a segment lacks is NULL.
    """
    by_segment = [bins_of(maps[(s, "score")]) for s in dict.fromkeys(run.segment for run in runs)]
    columns = list(dict.fromkeys(b["text"] for bins in by_segment for b in bins))
    wanted = [run.model_id for run in runs]
    shown = F.concat("grupo", F.lit(" "), F.format_string("%.4f", F.round("p_bad", 4)))
    return (
        grid_cells(trees, maps=maps)
        .filter(F.col("run").isin(wanted))
        .groupBy("run", "fila_pos", "fila_bin")
        .pivot("columna_bin", columns)
        .agg(F.first(shown))
    )
