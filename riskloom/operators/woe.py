"""Weight-of-evidence columns and hand-cut bin labels from configuration tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.cuts import bins_of, code_value, cut_value, per_segment
from riskloom.operators.edges import cut_frame, with_cut_values
from riskloom.settings import BIN_LABELS, DEFAULT_ROLES, RATING_WOE, WOE_MAPS, Roles
from riskloom.sources.tables import local_rows


def _mapped(df: DataFrame, roles: Roles, maps: dict, suffix: str, wanted) -> dict:
    columns: dict = {}
    for role in dict.fromkeys(role for _, role in maps):
        if wanted is not None and role not in wanted:
            continue
        name = roles.column(role)
        choices = {
            segment: cut_value(F.col(name), table)
            for (segment, mapped), table in maps.items()
            if mapped == role
        }
        columns[name + suffix] = per_segment(F.col(roles.segment), choices)
    return columns


def woe_apply(df: DataFrame, roles: Roles = DEFAULT_ROLES, maps=WOE_MAPS, wanted=None) -> DataFrame:
    """Add ``<column>_woe`` for every mapped role (or the ``wanted`` ones)."""
    return df.withColumns(_mapped(df, roles, maps, "_woe", wanted))


def woe_category(df: DataFrame, roles: Roles = DEFAULT_ROLES, maps=RATING_WOE) -> DataFrame:
    """Add the WOE of the rating code."""
    value = F.col(roles.rating)
    choices = {segment: code_value(value, table) for segment, table in maps.items()}
    return df.withColumn(roles.rating + "_woe", per_segment(F.col(roles.segment), choices))


def bin_label(df: DataFrame, roles: Roles = DEFAULT_ROLES, maps=BIN_LABELS) -> DataFrame:
    """Add ``<column>_bin`` with the hand-cut labels."""
    return df.withColumns(_mapped(df, roles, maps, "_bin", None))


def values_from_table(
    df: DataFrame, table: DataFrame, variables: Sequence[str], suffix: str = "_woe", roles: Roles = DEFAULT_ROLES
) -> DataFrame:
    """``woe_apply`` and ``bin_label`` for any number of segments: the maps are a cut table (see
    ``operators.edges``) keyed by the segment column, which the rows meet in one join."""
    return with_cut_values(df, table, [roles.segment], variables, suffix)


def map_table(spark: SparkSession, maps=WOE_MAPS, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Configured WOE or label maps as a cut table."""
    kind = "string" if isinstance(next(iter(maps.values())).values[0], str) else "double"
    return cut_frame(spark, maps, roles.segment, roles.column, kind)


BIN_EDGE_SCHEMA = (
    "segmento string, variable string, closed string, posicion int, lo double, hi double, "
    "bin string, woe double, is_missing boolean"
)


def woe_rows(maps=WOE_MAPS, roles: Roles | None = None) -> list[tuple]:
    rows = []
    for (segment, role), table in maps.items():
        name = roles.column(role) if roles else role
        side = "right" if table.right_closed else "left"
        for b in bins_of(table):
            low, high = (None if e is None else float(e) for e in (b["lo"], b["hi"]))
            rows.append(
                (segment, name, side, b["position"], low, high, b["text"], b["value"], b["is_missing"])
            )
    return rows


def woe_frame(spark: SparkSession, maps=WOE_MAPS, roles: Roles | None = None) -> DataFrame:
    """The WOE maps as rows (a few dozen)."""
    return local_rows(spark, woe_rows(maps, roles), BIN_EDGE_SCHEMA)
