"""Cohort preparation: maturity, one row per customer and month, segment, split, weights."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.cuts import per_segment
from riskloom.plans.staging import broadcast_side
from riskloom.settings import CE, CLASS_WEIGHTS, DEFAULT_LIMITS, DEFAULT_ROLES, SE, CohortLimits, Roles


def mature(df: DataFrame, roles: Roles = DEFAULT_ROLES, limits: CohortLimits = DEFAULT_LIMITS):
    """Goods need a minimum history, every bad is kept, rows without a label go."""
    label = F.col(roles.label)
    seasoned = F.col(roles.history) >= limits.min_history
    return df.filter((seasoned & (label == 0)) | (label == 1))


def since_start(df: DataFrame, roles: Roles = DEFAULT_ROLES, limits: CohortLimits = DEFAULT_LIMITS):
    return df.filter(F.col(roles.month) >= limits.start_month)


def dedupe(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """One row per customer and month, the worst label first.

    Spark keeps one row per key and map task before the shuffle (WindowGroupLimit),
    so a key with very many copies does not reach one task whole.
    """
    order = [F.col(roles.label).desc()]
    if roles.row_id:
        order.append(F.col(roles.row_id))
    ranked = Window.partitionBy(roles.customer, roles.month).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(ranked)).filter("__rank = 1").drop("__rank")


def segment_column(roles: Roles = DEFAULT_ROLES, limits: CohortLimits = DEFAULT_LIMITS) -> Column:
    return F.when(F.col(roles.reports) >= limits.min_reports, CE).otherwise(SE)


def part_column(roles: Roles = DEFAULT_ROLES, limits: CohortLimits = DEFAULT_LIMITS) -> Column:
    return F.when(F.col(roles.month) < limits.test_month, "train").otherwise("test")


def evident_column(roles: Roles = DEFAULT_ROLES, limits: CohortLimits = DEFAULT_LIMITS) -> Column:
    return F.when(F.col(roles.overdue) > limits.max_overdue, 1).otherwise(0)


def segment_experience(df, roles: Roles = DEFAULT_ROLES, limits: CohortLimits = DEFAULT_LIMITS):
    return df.withColumn(roles.segment, segment_column(roles, limits))


def split_out_of_time(df, roles: Roles = DEFAULT_ROLES, limits: CohortLimits = DEFAULT_LIMITS):
    return since_start(df, roles, limits).withColumn(roles.part, part_column(roles, limits))


def flag_evident_bad(df, roles: Roles = DEFAULT_ROLES, limits: CohortLimits = DEFAULT_LIMITS):
    return df.withColumn(roles.evident, evident_column(roles, limits))


def without_evident_bad(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    return df.filter(F.col(roles.evident) == 0)


def with_class_weights(df: DataFrame, roles: Roles = DEFAULT_ROLES, weights=CLASS_WEIGHTS):
    """Constant weights per segment: ``weights[segment] = (bad, good)``."""
    bad = F.col(roles.label) == 1
    choices = {
        name: F.when(bad, F.lit(w_bad)).otherwise(F.lit(w_good))
        for name, (w_bad, w_good) in weights.items()
    }
    return df.withColumn(roles.weight, per_segment(F.col(roles.segment), choices))


def balanced_weights(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Balanced weights n / (2 n_k) per segment and label, from one partial aggregation."""
    counts = df.groupBy(roles.segment, roles.label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(roles.segment)
    return counts.withColumn(roles.weight, F.sum("n").over(whole) / (2 * F.col("n")))


def with_balanced_weights(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    table = broadcast_side(balanced_weights(df, roles).drop("n"))
    return df.join(table, [roles.segment, roles.label])


def modelling_cohort(
    df: DataFrame, roles: Roles = DEFAULT_ROLES, limits: CohortLimits = DEFAULT_LIMITS
) -> DataFrame:
    """All preparation steps up to the evident-bad flag.

    Maturity and start month are applied before the dedupe: both are decided by
    the row itself or by the dedupe key, so fewer rows are shuffled.
    """
    kept = dedupe(since_start(mature(df, roles, limits), roles, limits), roles)
    return kept.withColumns(
        {
            roles.segment: segment_column(roles, limits),
            roles.part: part_column(roles, limits),
            roles.evident: evident_column(roles, limits),
        }
    )


def modelling_base(
    df: DataFrame,
    roles: Roles = DEFAULT_ROLES,
    limits: CohortLimits = DEFAULT_LIMITS,
    weights=CLASS_WEIGHTS,
) -> DataFrame:
    """The cohort without evident bads and with class weights."""
    cohort = without_evident_bad(modelling_cohort(df, roles, limits), roles)
    return with_class_weights(cohort, roles, weights)


def persist_base(df: DataFrame) -> DataFrame:
    """Keep a base that several reports read; call ``unpersist`` after the last one."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
