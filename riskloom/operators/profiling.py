"""Exploratory profile of continuous columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.prefix import clean
from riskloom.operators.quantiles import quantile_rows
from riskloom.plans.staging import broadcast_side, stage

# fixed values: names of the statistics
STATISTICS = (
    "count", "mean", "stddev", "min",
    "1%", "5%", "10%", "25%", "50%", "75%", "90%", "95%", "99%", "max",
)
_MOMENTS = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
_NEEDED = ("25%", "75%")


def _prob(name: str) -> float:
    return float(name.rstrip("%")) / 100


def null_counts(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """Row and NULL count per column in one pass: keys, variable, registros, nulos.  A NaN counts
    as a NULL."""
    pairs = [
        F.struct(
            F.count(F.lit(1)).alias("registros"), F.count_if(clean(c, df).isNull()).alias("nulos")
        ).alias(c)
        for c in columns
    ]
    wide = df.groupBy(*keys).agg(*pairs)
    return wide.unpivot(list(keys), columns, "variable", "__s").select(
        *keys, "variable", "__s.registros", "__s.nulos"
    )


def moments(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """count, mean, stddev, min and max per column: aggregated wide, reshaped afterwards.

    The wide aggregation reads each row once; only one row per key is unpivoted.
    """
    records = [
        F.struct(
            F.count(F.lit(1)).alias("registros"),
            F.count_if(clean(c, df).isNull()).alias("nulos"),
            *[fn(clean(c, df)).alias(name) for name, fn in _MOMENTS.items()],
        ).alias(c)
        for c in columns
    ]
    wide = df.groupBy(*keys).agg(*records)
    return wide.unpivot(list(keys), columns, "variable", "__s").select(*keys, "variable", "__s.*")


def fences(q1: Column, q3: Column) -> tuple[Column, Column, Column]:
    spread = q3 - q1
    return spread, q1 - 1.5 * spread, q3 + 1.5 * spread


def outlier_counts(
    df: DataFrame, columns: list[str], limits: DataFrame, keys: list[str] = ()
) -> DataFrame:
    """Values strictly outside the fences, for all columns in one pass.

    ``limits`` has one row per (keys, variable) with ``bandaInferior`` and ``bandaSuperior``.
    With keys it is reshaped to one row per key, so each data row meets one small row;
    without keys the two numbers per column become literals.
    """
    keys = list(keys)
    narrow = df.select(*keys, *columns)
    if keys:
        wide = limits.groupBy(*keys).pivot("variable", columns).agg(
            F.first(F.struct("bandaInferior", "bandaSuperior"))
        ).withColumnsRenamed({c: f"__lim_{c}" for c in columns})
        narrow = narrow.join(broadcast_side(wide), keys)
        low = {c: F.col(f"__lim_{c}.bandaInferior") for c in columns}
        high = {c: F.col(f"__lim_{c}.bandaSuperior") for c in columns}
    else:
        found = {r["variable"]: r for r in limits.collect()}
        low, high = (
            {c: F.lit(found[c][end] if c in found else None).cast("double") for c in columns}
            for end in ("bandaInferior", "bandaSuperior")
        )
    counted = narrow.groupBy(*keys).agg(
        *[
            F.count_if((clean(c, df) < low[c]) | (clean(c, df) > high[c])).alias(c)
            for c in columns
        ]
    )
    return counted.unpivot(keys, columns, "variable", "atipicos")


# --- fixed values: observation texts -------------------------------------------
_NULLS_TEXT = "Porcentaje de Nulos mayor al %s%%"
_OUTLIERS_TEXT = "Porcentaje de Atipicos mayor al %s%%"
_BOTH_JOIN = " y "


def observation(null_pct: Column, outlier_pct: Column, max_nulls, max_outliers) -> Column:
    """Text for too many NULLs, too many outliers or both; NULL when neither."""
    parts = [
        F.when(null_pct > max_nulls, F.lit(_NULLS_TEXT % max_nulls)),
        F.when(outlier_pct > max_outliers, F.lit(_OUTLIERS_TEXT % max_outliers)),
    ]
    text = F.concat_ws(_BOTH_JOIN, *parts)
    return F.when(text != "", text)


def _percent(part: str, whole: str) -> Column:
    return F.round(100 * F.try_divide(F.col(part), F.col(whole)), 2)


def eda_profile(
    df: DataFrame,
    variables: list[str],
    statistics=STATISTICS,
    max_nulls=50,
    max_outliers=5,
    keys: list[str] = (),
    rel_error: float = 1e-4,
) -> DataFrame:
    """Profile of each variable, per segment if ``keys`` are given."""
    keys = list(keys)
    marks = list(dict.fromkeys([s for s in statistics if s.endswith("%")] + list(_NEEDED)))
    ranks = stage(quantile_rows(df, keys, variables, [_prob(m) for m in marks], rel_error))
    at = {m: F.col("q")[i] for i, m in enumerate(marks)}
    spread, low, high = fences(at["25%"], at["75%"])
    limits = ranks.select(
        *keys, "variable",
        *[at[m].alias(m) for m in marks],
        spread.alias("iQR"), low.alias("bandaInferior"), high.alias("bandaSuperior"),
    )
    outside = outlier_counts(df, variables, limits, keys)
    on = [*keys, "variable"]
    joined = (
        moments(df, variables, keys)
        .join(limits, on, "left")
        .join(outside, on, "left")
        .withColumn("porcNulos", _percent("nulos", "registros"))
        .withColumn("porcentajeAtipicos", _percent("atipicos", "registros"))
    )
    return joined.select(
        *on, "registros", "nulos", "porcNulos",
        *[F.col(f"`{s}`") for s in statistics],
        "iQR", "bandaInferior", "bandaSuperior", "atipicos", "porcentajeAtipicos",
        observation(
            F.col("porcNulos"), F.col("porcentajeAtipicos"), max_nulls, max_outliers
        ).alias("observaciones"),
    )


def eda_outliers(
    df: DataFrame, variables: list[str], keys: list[str] = (), rel_error: float = 1e-4
) -> DataFrame:
    """Fences and outlier count per variable."""
    keys = list(keys)
    ranks = stage(quantile_rows(df, keys, variables, [0.25, 0.75], rel_error))
    _, low, high = fences(F.col("q")[0], F.col("q")[1])
    limits = ranks.select(
        *keys, "variable", low.alias("bandaInferior"), high.alias("bandaSuperior")
    )
    on = [*keys, "variable"]
    return limits.join(outlier_counts(df, variables, limits, keys), on)


def summary_rows(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """NULL counts and moments below each other: keys, variable, medida, valor (all double)."""
    on = [*keys, "variable"]
    parts = [
        null_counts(df, columns, keys).select(*on, F.col("nulos").cast("double")),
        moments(df, columns, keys).select(*on, *[F.col(m).cast("double") for m in _MOMENTS]),
    ]
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            part.unpivot(on, [c for c in part.columns if c not in on], "medida", "valor")
            for part in parts
        ],
    )


def summary_pivot(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One column per measure; the measures are known, so no job looks them up."""
    return rows.groupBy(*keys, "variable").pivot("medida", ["nulos", *_MOMENTS]).agg(F.sum("valor"))
