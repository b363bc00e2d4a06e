"""Entry points: a flagship query, the registered queries and their SQL counterparts."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.functions.cuts import iv_strength, woe_transform  # noqa: E402
from riskloom.functions.rules import has_experience, rules_frame  # noqa: E402
from riskloom.operators import (  # noqa: E402
    binning, cohort, iv, metrics, outliers, profiles, profiling, rule_tables, sampling, segments, sketches, tree, woe,
)
from riskloom.operators.quantiles import quantiles  # noqa: E402
from riskloom.plans.profiling_transform import transform  # noqa: E402
from riskloom.plans.scorecard import event_counts, with_woe  # noqa: E402
from riskloom.plans.staging import fresh_path, stage  # noqa: E402
from riskloom.settings import (  # noqa: E402
    FIXTURE_LIMITS, FIXTURE_ROLES, GRID_RUNS, MODEL_RUNS, PROFILE_RUNS, RAW_RUNS, RULES_FA_CE_ORIGINAL,
    RULES_FA_SE_ORIGINAL, WOE_MAPS,
)
from riskloom.sources.mdt import modelling_table  # noqa: E402
from riskloom.sources.tables import preview, read_csv, write_csv  # noqa: E402

ROLES, LIMITS = FIXTURE_ROLES, FIXTURE_LIMITS
SEGMENT = [ROLES.segment]
MEASURED = [ROLES.tenure, ROLES.balance, ROLES.balance_u3m, ROLES.balance_u6m]
PROFILED = [ROLES.score, *MEASURED, ROLES.label]
LABELLED = [f"{ROLES.balance}_bin", f"{ROLES.tenure}_bin"]
#: share of each segment's labelled rows that the grid search fits on
GRID_SHARE = 0.1
EXACT_BINS = binning.BinningLimits(rel_error=0)
IDS = [ROLES.row_id, ROLES.segment]

# fixed values: columns of the host's profiling
_PROFILE_INPUTS = {
    "tipoModeloFA": "tipo_modelo_fa", "scoreBuroFA": ROLES.score, "saldoCuentasFA": ROLES.balance,
    "tipoModelo12D": "tipo_modelo_12d", "scoreBuro12D": "score_12d", "saldoCuentas12D": "saldo_12d",
    "avgSaldoCuentasU3M": ROLES.balance_u3m, "avgSaldoCuentasU6M": ROLES.balance_u6m,
}
PROFILES = {
    name: replace(
        run,
        model_type=_PROFILE_INPUTS[run.model_type],
        score=_PROFILE_INPUTS[run.score],
        balance=_PROFILE_INPUTS[run.balance],
    )
    for name, run in PROFILE_RUNS.items()
}
ORIGINAL = replace(
    PROFILES["fa"], output="perfilesOriginales",
    ce=tuple(RULES_FA_CE_ORIGINAL), se=tuple(RULES_FA_SE_ORIGINAL),
)
RUNS = {run.model_id: run for run in MODEL_RUNS}

# The training-text operators and their pipeline may be taken away; the rest works without them.
try:
    import corpus_pipeline
    from riskloom.llm import queries as text_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "riskloom.llm"):
        raise  # a fault inside them is no absence
    corpus_pipeline = text_queries = None


# --- shared inputs ------------------------------------------------------------
def _table(spark: SparkSession, folder: str) -> DataFrame:
    return modelling_table(spark, folder)


def _recent(spark: SparkSession, folder: str) -> DataFrame:
    return modelling_table(spark, folder, LIMITS.start_month)


def _cohort(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.modelling_cohort(_recent(spark, folder), ROLES, LIMITS)


def _base(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.modelling_base(_recent(spark, folder), ROLES, LIMITS)


def _narrow(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The needed columns of the base, written once for operators that read them repeatedly."""
    return stage(_base(spark, folder).select(*IDS, *columns))


def _woe_base(spark: SparkSession, folder: str) -> DataFrame:
    return with_woe(_base(spark, folder), ROLES)


def _trees(spark: SparkSession, folder: str, *models: str) -> tree.GrownTrees:
    runs = [RUNS[m] for m in models] if models else MODEL_RUNS
    return tree.fit_trees(stage(_model_rows(spark, folder)), runs, ROLES)


def _model_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What the trees need of the base, WOE columns included."""
    features = dict.fromkeys(c for run in MODEL_RUNS for c in run.feature_columns(ROLES))
    return _woe_base(spark, folder).select(*IDS, ROLES.part, ROLES.label, ROLES.weight, *features)


def _fit(spark: SparkSession, folder: str) -> binning.FittedBins:
    """The default fit: sketched prebins, two scans, no large shuffle."""
    return binning.fit_bins(_narrow(spark, folder, ROLES.label, *MEASURED), SEGMENT, MEASURED, ROLES.label)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round derived doubles, so that summation order does not show."""
    return df.select(
        *[
            F.round(f"`{f.name}`", digits).alias(f.name)
            if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


# --- cohort ---------------------------------------------------------------------
def cohort_maturity(spark, folder):
    kept = cohort.mature(_table(spark, folder), ROLES, LIMITS)
    return kept.select(ROLES.row_id, ROLES.customer, ROLES.month, ROLES.label, ROLES.history)


def cohort_dedupe(spark, folder):
    kept = cohort.dedupe(cohort.mature(_table(spark, folder), ROLES, LIMITS), ROLES)
    return kept.select(ROLES.customer, ROLES.month, ROLES.label, ROLES.row_id)


def segment_experience(spark, folder):
    marked = cohort.segment_experience(_table(spark, folder), ROLES, LIMITS)
    return marked.select(ROLES.row_id, ROLES.reports, ROLES.segment)


def split_out_of_time(spark, folder):
    split = cohort.split_out_of_time(_recent(spark, folder), ROLES, LIMITS)
    return split.select(ROLES.row_id, ROLES.month, ROLES.part)


def flag_evident_bad(spark, folder):
    return event_counts(_cohort(spark, folder), ROLES.evident, [ROLES.segment, ROLES.part])


def modelling_base(spark, folder):
    return _base(spark, folder).select(ROLES.row_id, *ROLES.identifiers, *ROLES.candidates)


def class_weights(spark, folder):
    base = _base(spark, folder)
    balanced = cohort.balanced_weights(base.drop(ROLES.weight), ROLES)
    constant = cohort.with_class_weights(balanced.withColumnRenamed(ROLES.weight, "peso_balanceado"),
                                         ROLES)
    return _rounded(constant.withColumnRenamed(ROLES.weight, "peso_fijo"))


# --- outliers and profiling --------------------------------------------------------
def winsorize(spark, folder):
    capped, _ = outliers.winsorize(
        _narrow(spark, folder, *ROLES.winsorized), ROLES.winsorized, approx_rel_error=0, inplace=False,
        verbose=False, by=ROLES.segment,
    )
    return capped.select(*IDS, *ROLES.winsorized, *[f"{c}_win" for c in ROLES.winsorized])


def hard_cap(spark, folder):
    capped = outliers.hard_cap(_base(spark, folder), ROLES, suffix="_cap")
    return capped.select(*IDS, f"{ROLES.balance}_cap", f"{ROLES.tenure}_cap")


def eda_profile(spark, folder):
    return _rounded(
        profiling.eda_profile(_narrow(spark, folder, *PROFILED), PROFILED, keys=SEGMENT, rel_error=0)
    )


def eda_outliers(spark, folder):
    return _rounded(
        profiling.eda_outliers(_narrow(spark, folder, *MEASURED), MEASURED, keys=SEGMENT, rel_error=0)
    )


def agg_null_count(spark, folder):
    return profiling.null_counts(_base(spark, folder), PROFILED, SEGMENT)


def agg_summary(spark, folder):
    return _rounded(profiling.moments(_base(spark, folder), PROFILED, SEGMENT))


def agg_approx_quantile(spark, folder):
    return quantiles(_base(spark, folder), SEGMENT, MEASURED, [0.02, 0.5, 0.98], rel_error=0)


def reshape_unpivot(spark, folder):
    rows = _base(spark, folder).select(*IDS, *MEASURED)
    return rows.unpivot(IDS, MEASURED, "variable", "valor")


def set_union_all(spark, folder):
    return _rounded(profiling.summary_rows(_narrow(spark, folder, *PROFILED), PROFILED, SEGMENT))


def reshape_pivot(spark, folder):
    rows = profiling.summary_rows(_narrow(spark, folder, *PROFILED), PROFILED, SEGMENT)
    return _rounded(profiling.summary_pivot(rows, SEGMENT))


# --- binning, WOE, IV ----------------------------------------------------------------
def bin_label(spark, folder):
    return woe.bin_label(_base(spark, folder), ROLES).select(*IDS, *LABELLED)


def woe_apply(spark, folder):
    mapped = [ROLES.column(role) for role in dict.fromkeys(r for _, r in WOE_MAPS)]
    return woe.woe_apply(_base(spark, folder), ROLES).select(*IDS, *[f"{c}_woe" for c in mapped])


def woe_category(spark, folder):
    mapped = woe.woe_category(_base(spark, folder), ROLES)
    return mapped.select(*IDS, ROLES.rating, f"{ROLES.rating}_woe")


def udf_woe(spark, folder):
    """The generic lookup by cut list on every row, here with the SE three-month balance."""
    table = WOE_MAPS[("SE", "balance_u3m")]
    value = woe_transform(F.col(ROLES.balance_u3m), table.cuts, table.values, table.missing)
    return _table(spark, folder).select(ROLES.row_id, value.alias("woe"))


def _labelled(spark, folder):
    return woe.bin_label(_base(spark, folder), ROLES)


def bin_table(spark, folder):
    return _rounded(iv.bin_table(_labelled(spark, folder), LABELLED, ROLES.label, SEGMENT))


def calc_iv(spark, folder):
    return _rounded(iv.calc_iv(_labelled(spark, folder), LABELLED, ROLES.label, SEGMENT))


def calc_iv_bins(spark, folder):
    return _rounded(iv.calc_iv_bins(_labelled(spark, folder), LABELLED, ROLES.label, SEGMENT))


def optbin_fit(spark, folder):
    """The exact fit, every distinct value ranked."""
    exact = binning.fit_bins(_base(spark, folder), SEGMENT, MEASURED, ROLES.label, EXACT_BINS)
    return _rounded(binning.by_event_rate(exact.table, ROLES.segment, "variable"))


def optbin_splits(spark, folder):
    splits = binning.round_splits(_fit(spark, folder).splits)
    listed = splits.select(
        *SEGMENT, "variable", F.size("splits").cast("long").alias("n_splits"), "search_iv",
        "feasible", F.posexplode_outer("splits").alias("orden", "corte"),
    )
    return _rounded(listed)


def optbin_sketch(spark, folder):
    return _rounded(binning.by_event_rate(_fit(spark, folder).table, ROLES.segment, "variable"))


def iv_ranking(spark, folder):
    return _rounded(binning.iv_totals(_fit(spark, folder).table, SEGMENT))


def iv_strength_query(spark, folder):
    ranking = binning.iv_totals(_fit(spark, folder).table, SEGMENT)
    return _rounded(ranking.withColumn("fuerza", iv_strength(F.col("iv_sum")))).select(
        *SEGMENT, "variable", "iv_sum", "fuerza"
    )


def _measured_fit(spark, folder):
    base = _narrow(spark, folder, ROLES.label, *MEASURED)
    return base, binning.fit_bins(base, SEGMENT, MEASURED, ROLES.label)


def discretize(spark, folder):
    base, fitted = _measured_fit(spark, folder)
    return binning.discretize(base, fitted, suffix="_num").select(*IDS, *[f"{c}_num" for c in MEASURED])


def woe_fitted(spark, folder):
    """WOE and bin of the fit for every row, by the edge arrays of its segment."""
    base, fitted = _measured_fit(spark, folder)
    found = binning.fitted_values(binning.fitted_values(base, fitted), fitted, "bin", "_bin")
    return _rounded(found.select(*IDS, *[f"{c}{end}" for c in MEASURED for end in ("_woe", "_bin")]))


#: months that the rolling refit and its quantiles look at
WINDOW = (199901, 200112)
REFIT_PROBS = [0.02, 0.25, 0.5, 0.75, 0.98]


def _sketched(spark, folder):
    """The table of monthly sketches: all months but the last written first, the last one later."""
    base = _narrow(spark, folder, ROLES.month, ROLES.label, *MEASURED)
    path, last = fresh_path(spark, "sketches"), base.agg(F.max(ROLES.month)).first()[0]
    for months in (F.col(ROLES.month) < last, F.col(ROLES.month) == last):
        made = sketches.sketch_rows(base.filter(months), SEGMENT, ROLES.month, MEASURED, ROLES.label)
        sketches.store(made, path)
    return base, sketches.stored(spark, path, made)


def _in_window():
    return F.col(ROLES.month).between(*WINDOW)


def optbin_refit(spark, folder):
    """Bins of a window of months from their stored sketches."""
    _, table = _sketched(spark, folder)
    fitted = sketches.refit(table, MEASURED, _in_window())
    return _rounded(binning.by_event_rate(fitted.table, ROLES.segment, "variable"))


def sketch_quantiles(spark, folder):
    """Whether the merged sketches' quantiles lie within the stated rank error, and exact counts."""
    base, table = _sketched(spark, folder)
    asked = sketches.quantiles(table, REFIT_PROBS, _in_window()).select(
        *SEGMENT, "variable", "prob", F.col("value").alias("__found"), F.col("n").alias("__n")
    )
    rows = base.filter(_in_window()).unpivot(SEGMENT, MEASURED, "variable", "valor").filter("valor is not null")
    ranked = rows.join(F.broadcast(asked), [*SEGMENT, "variable"]).groupBy(*SEGMENT, "variable", "prob").agg(
        F.count(F.lit(1)).alias("n"), F.first("__n").alias("n_sketch"),
        F.avg((F.col("valor") < F.col("__found")).cast("double")).alias("below"),
        F.avg((F.col("valor") <= F.col("__found")).cast("double")).alias("upto"),
    )
    most = sketches.rank_error(table.accuracy)
    within = (F.col("below") - most <= F.col("prob")) & (F.col("prob") <= F.col("upto") + most)
    return ranked.select(*SEGMENT, "variable", "prob", "n", "n_sketch", within.alias("within"))


# --- profiles -------------------------------------------------------------------------
def _profile(name: str):
    def query(spark, folder):
        run = PROFILES[name]
        done = profiles.profile_rules(
            _table(spark, folder), run.model_type, run.score, run.balance, run.output, run.ce, run.se
        )
        return done.select(ROLES.row_id, run.output)

    return query


def profile_all(spark, folder):
    done = transform(spark, _table(spark, folder), {"profile_runs": PROFILES})
    return done.select(ROLES.row_id, *[run.output for run in PROFILES.values()])


def profile_rules_original(spark, folder):
    done = profiles.profile_all(
        _table(spark, folder), {"fa": PROFILES["fa"], "original": ORIGINAL}
    )
    return done.select(ROLES.row_id, PROFILES["fa"].output, ORIGINAL.output)


def profile_rule_audit(spark, folder):
    """Matches of the rules on the data rows, and on every pair of limits for each model type."""
    rows, runs = _table(spark, folder), {**PROFILES, "original": ORIGINAL}
    on_rows = profiles.rule_audit(rows, runs).withColumn("origen", F.lit("datos"))
    return on_rows.unionByName(profiles.limit_audit(rows, runs).withColumn("origen", F.lit("limites")))


def _rule_frame(spark, *more):
    """The rule tables of every profile and branch as data."""
    runs = {**PROFILES, **{name: ORIGINAL for name in more}}
    return rules_frame(spark, {f"{n}_{b}": rules for n, run in runs.items() for b, rules in (("CE", run.ce), ("SE", run.se))})


def _by_own_table(spark, folder, runs):
    """One row per data row and profile: the table that applies and its inputs."""
    def one(name, run):
        branch = F.when(has_experience(F.col(run.model_type)), "CE").otherwise("SE")
        return F.struct(
            F.lit(name).alias("perfil_de"), F.concat(F.lit(f"{name}_"), branch).alias("tabla"),
            F.col(run.score).cast("double").alias("score"), F.col(run.balance).alias("saldo"),
        )

    stacked = F.explode(F.array(*[one(name, run) for name, run in runs.items()]))
    return _table(spark, folder).select(ROLES.row_id, stacked.alias("p")).select(ROLES.row_id, "p.*")


def profile_tables(spark, folder):
    """Every profile of every row from rules held as data, all tables in one join."""
    done = rule_tables.profile_by_table(
        _by_own_table(spark, folder, PROFILES), _rule_frame(spark), F.col("tabla"), F.col("score"), F.col("saldo"), "perfil"
    )
    return done.select(ROLES.row_id, "perfil_de", "perfil")


def rule_rectangles(spark, folder):
    """Gaps and overlaps of all tables as rectangles, with the data rows that lie in each."""
    rules = _rule_frame(spark, "original")
    rows = _by_own_table(spark, folder, {**PROFILES, "original": ORIGINAL})
    counts = rule_tables.rows_by_slot(rows, rules, F.col("tabla"), F.col("score"), F.col("saldo"))
    return rule_tables.rule_rectangles(rules, counts)


# --- trees ------------------------------------------------------------------------------
def train_matrix(spark, folder):
    """Every model's features, label and weight, for both parts."""
    woes = [f"{ROLES.column(role)}_woe" for role in dict.fromkeys(r for _, r in WOE_MAPS)]
    return _woe_base(spark, folder).select(
        *IDS, ROLES.part, *woes, f"{ROLES.rating}_woe", ROLES.score, ROLES.tenure, ROLES.balance,
        ROLES.label, ROLES.weight,
    )


def min_leaf_5pct(spark, folder):
    train = _base(spark, folder).filter(F.col(ROLES.part) == "train")
    return train.groupBy(ROLES.segment).agg(
        F.count(F.lit(1)).alias("n_train"), tree.leaf_minimum(F.count(F.lit(1))).alias("min_leaf")
    )


def tree_split_search(spark, folder):
    roots = tree.root_cells(tree.model_cells(stage(_model_rows(spark, folder)), MODEL_RUNS, ROLES), MODEL_RUNS)
    best = tree.best_splits(tree.split_candidates(roots).filter("fits"), ("run", "feature"))
    return _rounded(best.select("run", "feature", "threshold", "gain", "n_left"))


def tree_fit(spark, folder):
    return _rounded(
        _trees(spark, folder).nodes.select(
            "run", "node", "depth", "variable", "threshold", "n", "bad", "w", "wb", "p_bad", "is_leaf"
        )
    )


def tree_raw_balance(spark, folder):
    """Trees on the raw balance, exact up to so many distinct values and on quantile bins beyond."""
    base = _narrow(spark, folder, ROLES.part, ROLES.label, ROLES.weight, ROLES.balance, ROLES.score)
    trees = tree.fit_trees(base, RAW_RUNS, ROLES, max_bins=4096)
    return _rounded(trees.nodes.select("run", "node", "depth", "variable", "threshold", "n", "bad", "p_bad", "is_leaf"))


def feature_importance(spark, folder):
    return _rounded(tree.feature_importance(_trees(spark, folder)))


def tree_rules(spark, folder):
    return _rounded(tree.tree_rules(_trees(spark, folder), decimals=6))


def score_proba(spark, folder):
    """P(bad) of every row under each model of its segment."""
    base = stage(_model_rows(spark, folder))
    trees, names = tree.fit_trees(base, MODEL_RUNS, ROLES), [run.model_id for run in MODEL_RUNS]
    scored = base.select("*", *[
        F.when(F.col(ROLES.segment) == run.segment, tree.score_column(trees, run)).alias(run.model_id)
        for run in MODEL_RUNS
    ])
    long = scored.select(*IDS, ROLES.part, *names).unpivot([*IDS, ROLES.part], names, "run", "p_malo")
    return _rounded(long.filter("p_malo is not null"))


def model_compare(spark, folder):
    return _rounded(tree.model_compare(_trees(spark, folder)))


def _grid(spark, folder):
    needed = [*IDS, ROLES.part, ROLES.label, ROLES.weight, ROLES.score]
    base = stage(
        _woe_base(spark, folder).select(*needed, f"{ROLES.tenure}_woe", f"{ROLES.balance}_woe")
    )
    sampled = reduce(DataFrame.unionByName, [
        sampling.sample_fraction(base.filter(F.col(ROLES.segment) == s), GRID_SHARE, ROLES.row_id)
        for s in sorted({run.segment for run in GRID_RUNS})
    ])
    folded = sampling.with_folds(sampled, [ROLES.segment, ROLES.part, ROLES.label], ROLES.row_id, 3)
    edges = tree.raw_edges(base, GRID_RUNS, ROLES)
    return tree.grid_search_depth(folded, F.col("fold"), GRID_RUNS, ROLES, edges=edges)


def grid_search_depth(spark, folder):
    return _rounded(_grid(spark, folder).scores)


def grid_importance(spark, folder):
    return _rounded(tree.best_importance(_grid(spark, folder)))


# --- metrics on a fixed score -------------------------------------------------------------
def _score_cells(spark, folder):
    """1000 - score as a risk score; rows without a score are counted apart."""
    base = _base(spark, folder).withColumn("riesgo", (1000 - F.col(ROLES.score)) / F.lit(1024.0))
    return metrics.score_cells(base, [ROLES.segment, ROLES.part], "riesgo", ROLES.label)


_BY = [ROLES.segment, ROLES.part]


def metric_auc(spark, folder):
    return _rounded(metrics.auc(_score_cells(spark, folder), _BY).drop("gini"))


def metric_gini(spark, folder):
    return _rounded(metrics.auc(_score_cells(spark, folder), _BY).select(*_BY, "gini"))


def metric_roc_curve(spark, folder):
    return _rounded(metrics.roc_curve(_score_cells(spark, folder), _BY))


def metric_roc_thinned(spark, folder):
    """The curve of all scores and balances together, where steps are small, without inner points."""
    base = _base(spark, folder).withColumn("riesgo", (1000 - F.col(ROLES.score)) - F.col(ROLES.balance))
    return _rounded(metrics.thinned_curve(metrics.score_cells(base, _BY, "riesgo", ROLES.label), _BY))


def metric_youden_cut(spark, folder):
    return _rounded(metrics.youden_cut(metrics.roc_curve(_score_cells(spark, folder), _BY), _BY))


# --- segment tables ----------------------------------------------------------------------
def leaf_segments(spark, folder):
    return _rounded(segments.leaf_segments(_trees(spark, folder)))


def leaf_share_check(spark, folder):
    return _rounded(segments.leaf_share_check(segments.ranked_leaves(_trees(spark, folder))))


def woe_cut_to_bins(spark, folder):
    return _rounded(segments.woe_cut_to_bins(_trees(spark, folder)))


def risk_grid(spark, folder):
    wanted = ["T3", "T4", "T5", "T6", "T7", "T8"]
    trees = _trees(spark, folder, *wanted)
    return segments.risk_grid(trees, [RUNS[m] for m in wanted])


def risk_grid_cells(spark, folder):
    trees = _trees(spark, folder, "T3", "T4", "T5", "T6", "T7", "T8")
    return _rounded(segments.grid_cells(trees))


# --- sampling, sinks ------------------------------------------------------------------------
def sample_fraction(spark, folder):
    return sampling.sample_fraction(_table(spark, folder), 0.1, ROLES.row_id).select(
        ROLES.row_id, ROLES.customer, ROLES.month, ROLES.label
    )


def snk_csv(spark, folder):
    rows = _table(spark, folder).select(
        ROLES.row_id, ROLES.customer, ROLES.month, ROLES.label, ROLES.balance, "tipo_modelo_fa"
    )
    return read_csv(spark, write_csv(rows, fresh_path(spark, "csv")), rows.schema)


def snk_show(spark, folder):
    rows = _base(spark, folder).select(*IDS, ROLES.balance)
    return preview(rows, F.col(ROLES.balance).desc_nulls_last(), ROLES.row_id)


# --- contract ---------------------------------------------------------------------------------
def entry(spark: SparkSession) -> DataFrame:
    """Balance and score WOE of the cohort to bin tables with IV, per segment."""
    return bin_table(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        cohort_maturity, cohort_dedupe, segment_experience, split_out_of_time, flag_evident_bad,
        modelling_base, class_weights, winsorize, hard_cap, eda_profile, eda_outliers,
        agg_null_count, agg_summary, agg_approx_quantile, reshape_unpivot, set_union_all,
        reshape_pivot,
        bin_label, woe_apply, woe_category, udf_woe, bin_table, calc_iv, calc_iv_bins,
        optbin_fit, optbin_splits, optbin_sketch, iv_ranking, discretize, woe_fitted,
        optbin_refit, sketch_quantiles,
        profile_all, profile_rules_original, profile_rule_audit, profile_tables, rule_rectangles,
        train_matrix, min_leaf_5pct, tree_split_search, tree_fit, tree_raw_balance, feature_importance, tree_rules,
        score_proba, model_compare, grid_search_depth, grid_importance,
        metric_auc, metric_gini, metric_roc_curve, metric_roc_thinned, metric_youden_cut,
        leaf_segments, leaf_share_check, woe_cut_to_bins, risk_grid, risk_grid_cells,
        sample_fraction, snk_csv, snk_show,
    ]
    found = {fn.__name__: fn for fn in named}
    found["iv_strength"] = iv_strength_query
    found.update({f"profile_{name}": _profile(name) for name in PROFILES})
    if text_queries is not None:
        found.update(text_queries.queries())
        found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    from oracle.statements import statements

    found = statements()
    if text_queries is not None:
        found.update(text_queries.oracle_sql())
        if corpus_pipeline.ORACLE_SQL is not None:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
