"""Risk profiles from rule tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.rules import (
    first_match_by_type, has_experience, limit_points, match_count_by_type,
)
from riskloom.settings import NO_PROFILE, PROFILE_RUNS, ProfileRun


def profile_column(run: ProfileRun, default: str = NO_PROFILE) -> Column:
    return first_match_by_type(
        F.col(run.model_type), F.col(run.score), F.col(run.balance), run.ce, run.se, default
    )


def profile_rules(
    df: DataFrame, col_tipo_modelo: str, col_score: str, col_saldo: str, col_perfiles: str,
    reglas_ce, reglas_se,
) -> DataFrame:
    """Add one profile column from a pair of rule tables."""
    run = ProfileRun(
        col_tipo_modelo, col_score, col_saldo, col_perfiles, tuple(reglas_ce), tuple(reglas_se)
    )
    return df.withColumn(run.output, profile_column(run))


def profile_all(df: DataFrame, runs: Mapping[str, ProfileRun] = PROFILE_RUNS) -> DataFrame:
    """Add every profile column in one projection; no shuffle, no action."""
    return df.withColumns({run.output: profile_column(run) for run in runs.values()})


def rule_audit(df: DataFrame, runs: Mapping[str, ProfileRun] = PROFILE_RUNS) -> DataFrame:
    """How often the rules of each table leave a row without or with several matches.

    Counts rows per table, branch, number of matching rules and resulting profile: 0 matches
    is a gap, more than 1 an overlap.  Works on data rows or on a grid of boundary points.
    """
    columns: dict = {}
    records = []
    for name, run in runs.items():
        score, balance, kind = F.col(run.score), F.col(run.balance), F.col(run.model_type)
        found = {
            "rama": F.when(has_experience(kind), "CE").otherwise("SE"),
            "con_nulos": score.isNull() | balance.isNull(),
            "coincidencias": match_count_by_type(kind, score, balance, run.ce, run.se),
            "perfil": profile_column(run),
        }
        columns.update({f"__{name}_{part}": value for part, value in found.items()})
        records.append(
            F.struct(
                F.lit(name).alias("tabla"),
                *[F.col(f"__{name}_{part}").alias(part) for part in found],
            )
        )
    keys = ["tabla", "rama", "con_nulos", "coincidencias", "perfil"]
    return (
        df.select(*[value.alias(name) for name, value in columns.items()])
        .select(F.explode(F.array(*records)).alias("r"))
        .select("r.*")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("filas"))
    )


def limit_audit(df: DataFrame, runs: Mapping[str, ProfileRun] = PROFILE_RUNS) -> DataFrame:
    """:func:`rule_audit` where a score limit meets a balance limit, for each model type in ``df``.

    Gaps and overlaps at a limit rarely show in data rows. Types are grouped before the few limits
    are exploded, so no row is multiplied.
    """
    kinds = list(dict.fromkeys(run.model_type for run in runs.values()))
    tables = []
    for name, run in runs.items():
        scores, balances = (F.lit(axis).cast("array<double>") for axis in limit_points([*run.ce, *run.se]))
        tables.append(F.struct(
            F.lit(name).alias("tabla"), F.col(run.model_type).alias("kind"), scores.alias("scores"), balances.alias("balances"),
        ))
    # types are few; a type that two inputs share is audited once a table
    types = df.select(*kinds).distinct().select(F.explode(F.array(*tables)).alias("t")).select("t.*").dropDuplicates(["tabla", "kind"])
    points = types.select("tabla", "kind", "balances", F.explode("scores").alias("score")).select(
        "tabla", "kind", "score", F.explode("balances").alias("balance")
    )
    kind, score, balance, of = F.col("kind"), F.col("score"), F.col("balance"), F.col("tabla")
    matches = F.coalesce(*[
        F.when(of == name, match_count_by_type(kind, score, balance, run.ce, run.se)) for name, run in runs.items()
    ])
    profile = F.coalesce(*[
        F.when(of == name, first_match_by_type(kind, score, balance, run.ce, run.se, NO_PROFILE)) for name, run in runs.items()
    ])
    return points.select(
        "tabla", F.when(has_experience(kind), "CE").otherwise("SE").alias("rama"),
        (score.isNull() | balance.isNull()).alias("con_nulos"), matches.alias("coincidencias"), profile.alias("perfil"),
    ).groupBy("tabla", "rama", "con_nulos", "coincidencias", "perfil").agg(F.count(F.lit(1)).alias("filas"))
