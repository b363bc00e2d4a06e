"""Rule tables held as data: applied by a slot index, audited by a plane sweep.

Rules are rows (``functions.rules.RULE_SCHEMA``): a score band, a balance band, a label and an order within their
table. On each axis a table's limits are steps, ``(limit, 0)`` where ">= limit" starts to hold and ``(limit,
1)`` where "> limit" does; the slot of a value is the number of steps it passes, and between steps
nothing changes. So a table is a small grid of slots, whatever its rules, and any number of tables are
applied or audited in one plan. A NULL has a slot of its own; NaN passes every step.

A table of r rules has at most 2r + 2 slots on an axis. Rules are written by hand, tables may be thousands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators.edges import bins_below
from riskloom.plans.staging import broadcast_side
from riskloom.settings import NO_PROFILE

#: the slot of NULL; it is no neighbour of any other
NULL_SLOT = -2
_AXES = ("score", "saldo")


def _step(limit: str, strict: Column) -> Column:
    return F.when(F.col(limit).isNotNull(), F.struct(F.col(limit).alias("at"), strict.cast("int").alias("strict")))


def _ends(axis: str) -> tuple[Column, Column]:
    """The steps at which a rule's band starts and stops to hold; NULL for an open end."""
    low = _step(f"{axis}_min", ~F.col(f"{axis}_min_incl"))
    return low, _step(f"{axis}_max", F.col(f"{axis}_max_incl"))


def table_steps(rules: DataFrame) -> DataFrame:
    """tabla with the sorted steps of both axes."""
    return rules.groupBy("tabla").agg(*[
        F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list(F.array(*_ends(axis))))))).alias(f"{axis}_steps")
        for axis in _AXES
    ])


def _slots(steps: Column) -> Column:
    return F.array_append(F.sequence(F.lit(0), F.size(steps)), F.lit(NULL_SLOT))


def _covered(axis: str, null_too: Column) -> Column:
    low, high = _ends(axis)
    steps = F.col(f"{axis}_steps")
    first = F.coalesce(F.array_position(steps, low).cast("int"), F.lit(0))
    last = F.coalesce(F.array_position(steps, high).cast("int") - 1, F.size(steps))
    none = F.array().cast("array<int>")
    inside = F.when(first <= last, F.sequence(first, last)).otherwise(none)
    return F.concat(inside, F.when((low.isNull() & high.isNull()) | null_too, F.array(F.lit(NULL_SLOT))).otherwise(none))


def slot_grid(rules: DataFrame) -> DataFrame:
    """tabla, i, j and ``held``, the rules (orden, etiqueta) of each pair of slots in their order; the
    steps come along."""
    steps = table_steps(rules)
    spread = rules.join(steps, "tabla").select(
        "tabla", "orden", "etiqueta", F.explode(_covered("score", F.lit(False))).alias("i"),
        _covered("saldo", F.col("incluye_missing")).alias("js"),
    ).select("tabla", "i", F.explode("js").alias("j"), "orden", "etiqueta")
    held = spread.groupBy("tabla", "i", "j").agg(F.array_sort(F.collect_list(F.struct("orden", "etiqueta"))).alias("held"))
    cells = steps.withColumn("i", F.explode(_slots(F.col("score_steps")))).withColumn(
        "j", F.explode(_slots(F.col("saldo_steps")))
    )
    empty = F.array().cast("array<struct<orden:int,etiqueta:string>>")
    return cells.join(held, ["tabla", "i", "j"], "left").withColumn("held", F.coalesce("held", empty))


def slot_index(rules: DataFrame, default: str = NO_PROFILE) -> DataFrame:
    """One row per table: its steps, and the label of the first rule for every pair of slots, NULL's first."""
    label = F.coalesce(F.get("held", F.lit(0))["etiqueta"], F.lit(default))
    listed = F.array_sort(F.collect_list(F.struct("i", "j", label.alias("label"))))
    return slot_grid(rules).groupBy("tabla").agg(
        F.first("score_steps").alias("score_steps"), F.first("saldo_steps").alias("saldo_steps"),
        F.transform(listed, lambda c: c["label"]).alias("labels"),
    )


def _place(value: Column, steps: Column) -> Column:
    """0 for NULL, else the slot after it."""
    passed = bins_below(F.struct(value.cast("double").alias("at"), F.lit(0).alias("strict")), steps, F.lit(False))
    return F.when(value.isNull(), F.lit(0)).otherwise(passed + 1)


def _with_own_table(df: DataFrame, index: DataFrame, table: Column) -> DataFrame:
    """``df`` with the steps (and labels) of each row's table, whose columns start with two underscores."""
    side = broadcast_side(index.withColumnsRenamed({c: f"__{c}" for c in index.columns}))
    return df.withColumn("__own", table).join(side, F.col("__own") == F.col("__tabla"), "left")


def profile_by_table(
    df: DataFrame, rules: DataFrame, table: Column, score: Column, balance: Column, output: str,
    default: str = NO_PROFILE,
) -> DataFrame:
    """Add the label of the first rule of the row's own table that holds, else ``default``; a row whose
    table has no rules gets ``default`` too. One join by table, of any number of tables."""
    met = _with_own_table(df, slot_index(rules, default), table)
    place = _place(score, F.col("__score_steps")) * (F.size("__saldo_steps") + 2) + _place(balance, F.col("__saldo_steps"))
    found = met.withColumn("__label", F.coalesce(F.get("__labels", place), F.lit(default)))
    return found.drop(output).withColumnRenamed("__label", output).drop(
        "__own", "__tabla", "__score_steps", "__saldo_steps", "__labels"
    )


def rows_by_slot(df: DataFrame, rules: DataFrame, table: Column, score: Column, balance: Column) -> DataFrame:
    """tabla, i, j and filas: the rows of every pair of slots; counts are combined before the shuffle."""
    met = _with_own_table(df, table_steps(rules), table).filter("__tabla is not null")

    def slot(value: Column, steps: str) -> Column:
        place = _place(value, F.col(steps))
        return F.when(place == 0, F.lit(NULL_SLOT)).otherwise(place - 1)

    return met.groupBy(
        F.col("__tabla").alias("tabla"), slot(score, "__score_steps").alias("i"), slot(balance, "__saldo_steps").alias("j")
    ).agg(F.count(F.lit(1)).alias("filas"))


def _bounds(axis: str, first: str, last: str) -> list[Column]:
    """The limits of slots first .. last of an axis, whether they belong, and a value inside."""
    steps, null = F.col(f"{axis}_steps"), F.col(first) == NULL_SLOT
    low, high = F.get(steps, F.col(first) - 1), F.get(steps, F.col(last))
    low, high = F.when(~null, low), F.when(~null, high)
    at_low = low["strict"] == 0
    middle = (low["at"] + high["at"]) / 2
    inside = F.when(low.isNull(), F.coalesce(high["at"] - 1, F.lit(0.0))).when(at_low, low["at"]).otherwise(
        F.coalesce(middle, low["at"] + 1)
    )
    return [
        low["at"].alias(f"{axis}_min"), at_low.alias(f"{axis}_min_incl"),
        high["at"].alias(f"{axis}_max"), (high["strict"] == 1).alias(f"{axis}_max_incl"),
        null.alias(f"{axis}_nulo"), F.when(~null, inside).alias(f"testigo_{axis}"),
    ]


def rule_rectangles(rules: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Gaps and overlaps of every table as rectangles of score x balance with their limits, and with
    the data rows in each if the ``counts`` of ``rows_by_slot`` are given.

    A line sweeps over the scores: in each score slot, neighbouring balance slots with the same rules are one
    run, and equal runs of neighbouring score slots one rectangle. Rectangles of a table do not meet; each names
    the rules that hold in it, the one that wins, and a point inside."""
    labels = F.array_join(F.transform("held", lambda r: r["etiqueta"]), ",")
    cells = slot_grid(rules).withColumn("reglas", labels)
    if counts is not None:
        cells = cells.join(counts, ["tabla", "i", "j"], "left")
    rows = F.coalesce(F.sum(F.col("filas") if counts is not None else F.lit(0)), F.lit(0)).alias("filas")
    along = Window.partitionBy("tabla", "i", "reglas").orderBy("j")
    runs = cells.withColumn("run", F.col("j") - F.row_number().over(along)).filter(F.size("held") != 1).groupBy(
        "tabla", "i", "reglas", "run"
    ).agg(
        F.min("j").alias("j0"), F.max("j").alias("j1"), F.first("held").alias("held"),
        F.first("score_steps").alias("score_steps"), F.first("saldo_steps").alias("saldo_steps"), rows,
    )
    across = Window.partitionBy("tabla", "reglas", "j0", "j1").orderBy("i")
    whole = runs.withColumn("band", F.col("i") - F.row_number().over(across)).groupBy(
        "tabla", "reglas", "j0", "j1", "band"
    ).agg(
        F.min("i").alias("i0"), F.max("i").alias("i1"), F.first("held").alias("held"),
        F.first("score_steps").alias("score_steps"), F.first("saldo_steps").alias("saldo_steps"),
        F.sum("filas").alias("filas"),
    )
    return whole.select(
        "tabla", F.when(F.size("held") == 0, "hueco").otherwise("traslape").alias("tipo"), "reglas",
        F.get("held", F.lit(0))["etiqueta"].alias("gana"),
        *_bounds("score", "i0", "i1"), *_bounds("saldo", "j0", "j1"), *(["filas"] if counts is not None else []),
    )
