"""The modelling run as one chain of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import binning, cohort, iv, profiling, segments, tree, woe
from riskloom.operators.outliers import hard_cap, winsorize
from riskloom.settings import (
    CLASS_WEIGHTS, DEFAULT_LIMITS, DEFAULT_ROLES, MODEL_RUNS, CohortLimits, ModelRun, Roles,
)


def with_woe(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """WOE columns of all mapped variables and of the rating."""
    return woe.woe_category(woe.woe_apply(df, roles), roles)


@dataclass(frozen=True)
class Scorecard:
    """Reports and models of one modelling run; every member is a DataFrame or small."""

    base: DataFrame
    thresholds: DataFrame
    profile: DataFrame
    bins: binning.FittedBins
    iv_ranking: DataFrame
    calc_iv: DataFrame
    trees: tree.GrownTrees
    comparison: DataFrame
    leaf_table: DataFrame


def modelling_run(
    df: DataFrame,
    roles: Roles = DEFAULT_ROLES,
    limits: CohortLimits = DEFAULT_LIMITS,
    weights=CLASS_WEIGHTS,
    runs: Sequence[ModelRun] = MODEL_RUNS,
    rel_error: float = 0.001,
) -> Scorecard:
    """Cohort, winsorizing, caps, profile, bins, IV, trees and segment tables.

    The prepared base is read by several reports and is therefore persisted; release it
    with ``result.base.unpersist()`` when the reports have been used.
    """
    prepared = cohort.modelling_base(df, roles, limits, weights)
    treated, thresholds = winsorize(
        prepared, roles.winsorized, approx_rel_error=rel_error, by=roles.segment, verbose=False
    )
    base = cohort.persist_base(hard_cap(treated, roles))
    keys = [roles.segment]
    measured = [roles.tenure, roles.balance, roles.balance_u3m, roles.balance_u6m]
    bins = binning.fit_bins(base, keys, measured, roles.label)
    labelled = woe.bin_label(base, roles)
    trees = tree.fit_trees(with_woe(base, roles), runs, roles)
    return Scorecard(
        base=base,
        thresholds=thresholds,
        profile=profiling.eda_profile(base, [roles.score, *measured, roles.label], keys=keys),
        bins=bins,
        iv_ranking=binning.iv_totals(bins.table, keys),
        calc_iv=iv.calc_iv(
            labelled, [f"{roles.balance}_bin", f"{roles.tenure}_bin"], roles.label, keys
        ),
        trees=trees,
        comparison=tree.model_compare(trees),
        leaf_table=segments.leaf_segments(trees),
    )


def event_counts(df: DataFrame, flag: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per value of a flag, as reported for the evident bads."""
    return df.groupBy(*keys, flag).agg(F.count(F.lit(1)).alias("filas"))
