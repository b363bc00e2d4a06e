"""Optimal monotone binning, bin tables and discretizing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.cuts import woe_of
from riskloom.operators import monotone
from riskloom.operators.edges import with_cut_values
from riskloom.operators.prefix import clean, value_cells
from riskloom.operators.quantiles import quantile_rows
from riskloom.plans.staging import fits_broadcast, stage, stage_counted


@dataclass(frozen=True)
class BinningLimits:
    """At most ``max_bins`` bins, each with ``min_share`` of the non-missing rows."""

    max_bins: int = 5
    min_share: float = 0.1
    prebins: int = 20
    rel_error: float = 1e-4


@dataclass(frozen=True)
class FittedBins:
    """``splits``: one row per (keys, variable); ``table``: one row per bin.  Both are small."""

    keys: tuple
    splits: DataFrame
    table: DataFrame
    variables: tuple = ()

    @property
    def _cuts(self) -> list:
        return [*self.keys, "variable", F.col("splits").alias("edges")]

    def number_table(self) -> DataFrame:
        """Cut table (see ``operators.edges``) of bin numbers, for variables with more than one cut."""
        size = F.size("splits")
        numbers = F.transform(F.sequence(F.lit(0), size), lambda i: i.cast("double"))
        return self.splits.filter(size > 1).select(
            *self._cuts, numbers.alias("values"), (size + 1).cast("double").alias("missing"),
            F.lit(False).alias("right_closed"),
        )

    def value_table(self, column: str = "woe") -> DataFrame:
        """Cut table of a column of the bin table, such as WOE or the bin's text, for every variable."""
        on = [*self.keys, "variable"]
        listed = self.table.groupBy(*on).agg(
            F.array_sort(F.collect_list(F.struct("bin_no", F.col(column).alias("value")))).alias("rows")
        )
        rows = F.transform("rows", lambda r: r["value"])
        return null_safe_join(self.splits, listed, on).select(
            *self._cuts, F.slice(rows, F.lit(1), F.size(rows) - 1).alias("values"),
            F.element_at(rows, -1).alias("missing"), F.lit(False).alias("right_closed"),
        )


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join by columns of one name, in which NULL equals NULL; they come from the left side."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in on})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in on])
    return left.join(other, same).drop(*[f"__{k}" for k in on])


def _prebin_edges(df, keys, variables, limits: BinningLimits, cells) -> tuple[DataFrame, int]:
    """Distinct lower edges of the prebins, one row per (keys, variable), and the row count."""
    probs = [i / limits.prebins for i in range(1, limits.prebins)]
    rows = quantile_rows(df, keys, variables, probs, limits.rel_error, cells)
    return stage_counted(
        rows.select(
            *keys, "variable", F.array_sort(F.array_distinct(F.array_compact("q"))).alias("edges")
        )
    )


def _prebin_counts(cells: DataFrame, edges: DataFrame, small: bool, keys, count: int) -> DataFrame:
    """Rows and events per prebin; prebin i holds values in [edge i, edge i + 1).

    The prebin number is a sum of comparisons against the joined edges, so it stays
    in generated code; each map task sends at most ``count`` + 1 rows per variable.
    """
    on = [*keys, "variable"]
    wide = edges.select(*on, *[F.get("edges", F.lit(i)).alias(f"__e{i}") for i in range(count - 1)])
    number = sum(
        (
            F.when(F.col("value") >= F.col(f"__e{i}"), F.lit(1)).otherwise(F.lit(0))
            for i in range(count - 1)
        ),
        start=F.lit(0),
    )
    return (
        cells.join(F.broadcast(wide) if small else wide, on)
        .groupBy(*on, F.when(F.col("value").isNotNull(), number).alias("prebin"))
        .agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
    )


def _row_cells(df, keys, variables, label) -> DataFrame:
    """Every row as its own cell, NULLs included; nothing is shuffled for it."""
    return df.select(
        *keys,
        F.lit(1).cast("long").alias("__n"),
        F.col(label).cast("long").alias("__events"),
        *[clean(v, df).alias(v) for v in variables],
    ).unpivot([*keys, "__n", "__events"], variables, "variable", "value").withColumnsRenamed(
        {"__n": "n", "__events": "events"}
    )


def _search(counts: DataFrame, edges: DataFrame, keys, limits: BinningLimits) -> DataFrame:
    """Best cut list per (keys, variable) over all feasible groupings of the prebins; see
    ``operators.monotone``. A key is one row here, with one count for each prebin."""
    on = [*keys, "variable"]
    seen = counts.filter(F.col("prebin").isNotNull()).groupBy(*on).agg(
        F.array_sort(F.collect_list(F.struct("prebin", "n", "events"))).alias("bins")
    )

    @F.pandas_udf(monotone.SEARCHED)
    def searched(n: pd.Series, events: pd.Series) -> pd.DataFrame:
        return monotone.search(n, events, limits.max_bins, limits.min_share)

    best = seen.select(
        *on, F.col("bins.prebin").alias("prebin_ids"), searched("bins.n", "bins.events").alias("best")
    )
    # Cut c lies before the c-th prebin (0-based); prebin p starts at edges[p - 1].
    cut_edges = F.expr("transform(best.cuts, c -> element_at(edges, element_at(prebin_ids, c + 1)))")
    return edges.join(best, on, "left").select(
        *on,
        F.coalesce(cut_edges, F.array().cast("array<double>")).alias("splits"),
        F.col("best.iv").alias("search_iv"),
        F.coalesce("best.feasible", F.lit(0)).cast("long").alias("feasible"),
    )


def _edge_text(number: Column) -> Column:
    return F.format_string("%.2f", F.round(number, 2))


def _bin_texts(splits: Column) -> Column:
    inner = F.transform(splits, _edge_text)
    lows = F.concat(F.array(F.lit("(-inf")), F.transform(inner, lambda t: F.concat(F.lit("["), t)))
    highs = F.concat(inner, F.array(F.lit("inf")))
    return F.zip_with(lows, highs, lambda a, b: F.concat(a, F.lit(", "), b, F.lit(")")))


def bin_statistics(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Event rate, WOE, IV and JS per bin from ``n`` and ``events``; totals include missing.

    A bin without goods or without bads has WOE, IV and JS 0.  Totals per key are summed on the
    map side and joined, so a key may have any number of bins.
    """
    totals = bins.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(
        F.nullif(F.sum("n"), F.lit(0)).alias("__n"),
        F.nullif(F.sum("events"), F.lit(0)).alias("__b"),
        F.nullif(F.sum(F.col("n") - F.col("events")), F.lit(0)).alias("__g"),
    )
    good, bad = F.col("non_event") / F.col("__g"), F.col("event") / F.col("__b")
    mixed = (F.col("event") > 0) & (F.col("non_event") > 0)
    middle = (good + bad) / 2
    zero = F.lit(0.0)
    return (
        bins.select(
            "*",
            F.col("events").alias("event"),
            (F.col("n") - F.col("events")).alias("non_event"),
        )
        .join(totals, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]))
        .withColumns(
            {
                "count_share": F.col("n") / F.col("__n"),
                "event_rate": F.try_divide(F.col("event"), F.col("n")),
                "woe": F.when(mixed, woe_of(good, bad)).otherwise(zero),
                "iv": F.when(mixed, (good - bad) * woe_of(good, bad)).otherwise(zero),
                "js": F.when(
                    mixed,
                    (good * F.ln(F.nullif(good, zero) / middle)
                     + bad * F.ln(F.nullif(bad, zero) / middle)) / 2,
                ).otherwise(zero),
            }
        )
        .drop("__n", "__b", "__g", "events", *[f"__{k}" for k in keys])
        .withColumnRenamed("n", "count")
    )


def _fitted_table(counts: DataFrame, splits: DataFrame, edges: DataFrame, keys) -> DataFrame:
    """Bin table of a fit from the prebin counts alone; the data is not read again."""
    on = [*keys, "variable"]
    parts = counts.join(splits, on).join(edges, on)
    lower = F.expr("case when prebin > 0 then element_at(edges, prebin) end")
    bin_no = F.when(F.col("prebin").isNull(), F.size("splits") + 1).otherwise(
        F.size(F.filter("splits", lambda s: s <= F.coalesce(lower, F.lit(float("-inf")))))
    )
    merged = parts.groupBy(*on, bin_no.alias("bin_no")).agg(
        F.sum("n").alias("n"), F.sum("events").alias("events")
    )
    frame = splits.select(
        *on,
        F.size("splits").alias("n_splits"),
        F.posexplode(F.concat(_bin_texts(F.col("splits")), F.array(F.lit("Missing")))).alias(
            "bin_no", "bin"
        ),
    )
    full = frame.join(merged, [*on, "bin_no"], "left").fillna(0, ["n", "events"])
    return bin_statistics(full, on)


def fit_bins(
    df: DataFrame, keys: list[str], variables: list[str], label: str = "y",
    limits: BinningLimits = BinningLimits(),
) -> FittedBins:
    """Optimal binning of every variable in every segment at once.

    With a positive ``rel_error`` the data is read twice (sketched quantiles, prebin
    counts) and only a few kilobytes are shuffled.  With 0 the distinct values are
    counted once and both steps work on those counts.
    """
    keys = list(keys)
    if limits.rel_error > 0:
        exact, rows = None, _row_cells(df, keys, variables, label)
    else:
        events = {"events": F.col(label).cast("long")}
        rows = exact = stage(value_cells(df, keys, variables, events))
    edges, edge_rows = _prebin_edges(df, keys, variables, limits, exact)
    small = fits_broadcast(edges, edge_rows)
    counts = stage(_prebin_counts(rows, edges, small, keys, limits.prebins))
    return fit_from_counts(counts, edges, keys, variables, limits)


def fit_from_counts(
    counts: DataFrame, edges: DataFrame, keys: Sequence[str], variables: Sequence[str], limits: BinningLimits
) -> FittedBins:
    """The fit from staged prebin counts (keys, variable, prebin, n, events) and prebin edges."""
    splits = stage(_search(counts, edges, keys, limits))
    return FittedBins(tuple(keys), splits, _fitted_table(counts, splits, edges, keys), tuple(variables))


def round_splits(splits: DataFrame, digits: int = 2) -> DataFrame:
    return splits.withColumn("splits", F.transform("splits", lambda s: F.round(s, digits)))


def by_event_rate(table: DataFrame, *first: str) -> DataFrame:
    """The bin table by rising event rate, empty bins last; ``rank`` is the place in that order."""
    rate = F.col("event_rate").asc_nulls_last()
    place = F.row_number().over(Window.partitionBy(*first).orderBy(rate, "bin_no"))
    return table.withColumn("rank", place)


def iv_totals(table: DataFrame, keys: list[str] = ()) -> DataFrame:
    """IV per variable, highest first, with its ``rank``; ``usable`` marks variables with more
    than one split."""
    highest = Window.partitionBy(*keys).orderBy(F.round("iv_sum", 12).desc(), "variable")
    return (
        table.groupBy(*keys, "variable")
        .agg(F.sum("iv").alias("iv_sum"), F.max("n_splits").alias("n_splits"))
        .withColumns({"usable": F.col("n_splits") > 1, "rank": F.row_number().over(highest)})
    )


def discretize(df: DataFrame, fitted: FittedBins, suffix: str = "") -> DataFrame:
    """Each fitted variable as its bin number, a double, where it has more than one cut in the row's
    segment; NULL gets the number of the Missing bin. Elsewhere the value itself stays, as a double.

    Cuts meet the rows in one join, so there may be any number of segments."""
    return with_cut_values(
        df, fitted.number_table(), fitted.keys, fitted.variables, suffix,
        otherwise={v: F.col(f"`{v}`").cast("double") for v in fitted.variables},
    )


def fitted_values(df: DataFrame, fitted: FittedBins, column: str = "woe", suffix: str = "_woe") -> DataFrame:
    """Add what the fitted bin table says in ``column`` about each variable's bin; NULL where the row's
    segment was not fitted."""
    return with_cut_values(df, fitted.value_table(column), fitted.keys, fitted.variables, suffix)
