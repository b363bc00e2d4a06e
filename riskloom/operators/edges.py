"""Cut tables as data: one row per key with sorted edges, any number of keys.

A cut table has the key columns, ``edges`` (ascending doubles), ``values`` (one more than edges, lowest bin
first), ``missing`` (the value of NULL) and ``right_closed`` (bins ``(a, b]``, else ``[a, b)``). Rows meet their
key's edges in one join and find their bin by binary search inside the row, so neither the plan nor the driver
grows with the number of keys. A small table is broadcast after its size was checked; a large one is
shuffled by key, and a hot key of the rows is split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.prefix import clean
from riskloom.plans.staging import broadcast_side
from riskloom.sources.tables import local_rows

ON = "variable"


def bins_below(value: Column, edges: Column, right_closed: Column) -> Column:
    """The number of edges below ``value``, where an edge equal to it counts for bins ``[a, b)``.

    A binary search: the count is built from its highest binary digit down, each step asking one edge."""
    digits = F.sequence(F.floor(F.log2(F.greatest(F.size(edges), F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

    def step(found: Column, digit: Column) -> Column:
        ahead = found + F.call_function("shiftleft", F.lit(1), digit)
        edge = F.get(edges, ahead - 1)  # NULL beyond the end
        return F.when(F.when(right_closed, edge < value).otherwise(edge <= value), ahead).otherwise(found)

    return F.aggregate(digits, F.lit(0), step)


def _looked_up(value: Column, table: Column) -> Column:
    place = bins_below(value, table["edges"], table["right_closed"])
    return F.when(value.isNull(), table["missing"]).otherwise(F.get(table["values"], place))


def with_cut_values(
    df: DataFrame, table: DataFrame, keys: Sequence[str], variables: Sequence[str], suffix: str,
    otherwise: dict[str, Column] | None = None,
) -> DataFrame:
    """``df`` with ``<variable><suffix>``: the value that the row's key has for the bin of the variable.

    Rows whose key has no table for a variable get NULL, or the Column that ``otherwise`` names. NaN counts as
    NULL. ``table`` must have one row per (keys, variable)."""
    keys, otherwise = list(keys), otherwise or {}
    own = {v: f"__cuts_{i}" for i, v in enumerate(variables)}
    names = {k: f"__key_{i}" for i, k in enumerate(keys)}
    chosen = [
        F.first(F.when(F.col(ON) == v, F.struct("edges", "values", "missing", "right_closed")), ignorenulls=True).alias(c)
        for v, c in own.items()
    ]
    wide = broadcast_side(
        table.filter(F.col(ON).isin(*variables)).groupBy(*[F.col(k).alias(c) for k, c in names.items()]).agg(*chosen)
    )
    if keys:
        met = df.join(wide, reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(c)) for k, c in names.items()]), "left")
    else:
        met = df.join(F.broadcast(wide), F.lit(True), "left")  # one row
    found = {}
    for v, c in own.items():
        value = _looked_up(clean(v, df), F.col(c))
        found[v + suffix] = F.when(F.col(c).isNotNull(), value).otherwise(otherwise[v]) if v in otherwise else value
    return met.withColumns(found).drop(*own.values(), *names.values())


def cut_frame(spark: SparkSession, maps: dict, key: str, name_of=lambda v: v, kind: str = "double") -> DataFrame:
    """The cut table of configured maps {(key, variable): CutMap}."""
    rows = [
        (k, name_of(v), [float(c) for c in m.cuts], list(m.values), m.missing, m.right_closed)
        for (k, v), m in maps.items()
    ]
    schema = f"`{key}` string, {ON} string, edges array<double>, values array<{kind}>, missing {kind}, right_closed boolean"
    return local_rows(spark, rows, schema)
