"""ROC measures from score cells: one row per distinct score, exact at any size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.prefix import running_totals


def score_cells(df: DataFrame, keys: list[str], score: str, label: str = "y") -> DataFrame:
    """Row and bad count per distinct score; rows without a score form a cell of their own, which
    :func:`auc` counts and no measure uses."""
    return (
        df.groupBy(*keys, F.col(score).cast("double").alias("score"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("bad"))
    )


def _ranked(cells: DataFrame, keys: list[str], bounded: bool) -> DataFrame:
    return running_totals(cells.filter("score is not null"), keys, "score", ["n", "bad"], bounded).withColumns(
        {
            "good": F.col("n") - F.col("bad"),
            "good_upto": F.col("n_upto") - F.col("bad_upto"),
            "good_total": F.col("n_total") - F.col("bad_total"),
        }
    )


def _area() -> list[Column]:
    """n, bad and auc: every bad counts the goods with a lower score, and half of its own."""
    below = F.col("good_upto") - F.col("good")
    pairs = F.col("bad").cast("double") * (below + F.col("good") / 2)
    both = F.max("bad_total").cast("double") * F.max("good_total").cast("double")
    return [
        F.max("n_total").alias("n"),
        F.max("bad_total").alias("bad"),
        F.try_divide(F.sum(pairs), both).alias("auc"),
    ]


def _rate(kind: str) -> Column:
    """Share of a class with this score or a higher one."""
    reached = F.col(f"{kind}_total") - F.col(f"{kind}_upto") + F.col(kind)
    return F.try_divide(reached.cast("double"), F.col(f"{kind}_total").cast("double"))


def _best_distance(tpr: Column, fpr: Column, threshold: Column) -> Column:
    """Largest TPR - FPR with its threshold, the highest threshold on ties."""
    return F.max(F.struct(F.round(tpr - fpr, 12).alias("ks"), threshold.alias("threshold")))


def _cut(best: str) -> list[Column]:
    ks = F.col(f"{best}.ks")
    return [ks.alias("ks"), F.when(ks > 0, F.col(f"{best}.threshold")).alias("cut")]


def auc(cells: DataFrame, keys: list[str], bounded: bool = False) -> DataFrame:
    """Unweighted ROC-AUC and GINI per key over the rows with a score, and the number ``unscored``
    of those without; NULL where only one class occurs or no row has a score."""
    if not keys:
        return auc(cells.withColumn("__all", F.lit(0)), ["__all"], bounded).drop("__all")
    areas = _ranked(cells, keys, bounded).groupBy(*keys).agg(*_area())
    missing = F.sum(F.when(F.col("score").isNull(), F.col("n")).otherwise(0)).alias("unscored")
    return (
        cells.groupBy(*keys).agg(missing)
        .join(areas, keys, "left")
        .withColumn("gini", 2 * F.col("auc") - 1)
    )


def roc_curve(cells: DataFrame, keys: list[str], bounded: bool = False) -> DataFrame:
    """FPR and TPR of the rule "score >= threshold" at every distinct score."""
    return _ranked(cells, keys, bounded).select(
        *keys, F.col("score").alias("threshold"), _rate("bad").alias("tpr"), _rate("good").alias("fpr")
    )


def thinned_curve(cells: DataFrame, keys: list[str], bounded: bool = False) -> DataFrame:
    """``roc_curve`` without the points inside a straight run of equal steps: a point goes if the next
    lower score adds as many goods and as many bads as it does itself. Ends stay, and so do area and KS.

    A score meets its lower neighbour's counts in a join by the neighbour's next score, so a curve of any length is
    thinned without a window over it."""
    ranked = _ranked(cells, keys, bounded)
    below = ranked.filter("score_next is not null").select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("score_next").alias("__score"),
        F.col("bad").alias("__bad"), F.col("good").alias("__good"),
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("score") == F.col("__score"))
    inside = (F.col("__bad") == F.col("bad")) & (F.col("__good") == F.col("good")) & F.col("score_next").isNotNull()
    return ranked.join(below, same, "left").filter(~F.coalesce(inside, F.lit(False))).select(
        *keys, F.col("score").alias("threshold"), _rate("bad").alias("tpr"), _rate("good").alias("fpr")
    )


def youden_cut(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Threshold with the largest TPR - FPR, the highest one on ties; NULL when none separates."""
    best = _best_distance(F.col("tpr"), F.col("fpr"), F.col("threshold"))
    return curve.groupBy(*keys).agg(best.alias("b")).select(*keys, *_cut("b"))


def summary(cells: DataFrame, keys: list[str], bounded: bool = False) -> DataFrame:
    """AUC, GINI, KS and the KS cut side by side, from one ranking."""
    best = _best_distance(_rate("bad"), _rate("good"), F.col("score"))
    return (
        _ranked(cells, keys, bounded)
        .groupBy(*keys)
        .agg(*_area(), best.alias("b"))
        .select(*keys, "n", "bad", "auc", (2 * F.col("auc") - 1).alias("gini"), *_cut("b"))
    )
