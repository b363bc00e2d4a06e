"""Columns built from cut tables: plain CASE expressions, no UDF."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.settings import IV_STRENGTH, CodeMap, CutMap


def cut_value(value: Column, table: CutMap) -> Column:
    """The table's value of the bin that holds ``value``; NULL gets ``missing``."""
    chain = F.when(value.isNull(), F.lit(table.missing))
    for cut, result in zip(table.cuts, table.values):
        below = value <= cut if table.right_closed else value < cut
        chain = chain.when(below, F.lit(result))
    return chain.otherwise(F.lit(table.values[-1]))


def woe_transform(value: Column, cuts, woes, woe_missing) -> Column:
    """Column form of a scalar WOE lookup with bins ``(a, b]`` and an open last bin."""
    return cut_value(value, CutMap(tuple(cuts), tuple(woes), woe_missing))


def code_value(value: Column, table: CodeMap) -> Column:
    """Equality map on a numeric code; text that is no number gets the default."""
    code = value.try_cast("float")
    chain = F.when(code == table.codes[0], F.lit(table.values[0]))
    for number, result in zip(table.codes[1:], table.values[1:]):
        chain = chain.when(code == number, F.lit(result))
    return chain.otherwise(F.lit(table.default))


def per_segment(
    segment: Column, choices: Mapping[str, Column], otherwise: Column | None = None
) -> Column:
    """Pick one of several columns by segment; an unknown segment gets ``otherwise`` or NULL."""
    items = list(choices.items())
    chain = F.when(segment == items[0][0], items[0][1])
    for name, column in items[1:]:
        chain = chain.when(segment == name, column)
    return chain if otherwise is None else chain.otherwise(otherwise)


def hard_cap(value: Column, lower: float | None, upper: float | None) -> Column:
    """Cap a column on either side and keep NULL as NULL."""
    chain = value
    if lower is not None:
        chain = F.when(value < lower, F.lit(lower)).otherwise(chain)
    if upper is not None:
        chain = F.when(value >= upper, F.lit(upper)).otherwise(chain)
    return chain


def iv_strength(iv: Column) -> Column:
    """Reading guide of an information value."""
    return cut_value(iv, IV_STRENGTH)


def woe_of(good_share: Column, bad_share: Column) -> Column:
    """ln(share of goods / share of bads); NULL when either share is missing or zero."""
    return F.ln(F.try_divide(F.nullif(good_share, F.lit(0.0)), F.nullif(bad_share, F.lit(0.0))))


def bin_number(value: Column, splits, missing: int) -> Column:
    """Bin index of ``[a, b)`` bins; NULL gets the number of the missing bin."""
    numbers = tuple(range(len(splits) + 1))
    return cut_value(value, CutMap(tuple(splits), numbers, missing, right_closed=False))


def format_number(number: float) -> str:
    return f"{number:g}"


def bins_of(table: CutMap) -> list[dict]:
    """The table's bins in ascending order with limits, text and value; missing last."""
    rows = []
    edges = [None, *table.cuts, None]
    for position, (low, high) in enumerate(zip(edges, edges[1:])):
        opened = "(" if table.right_closed or low is None else "["
        closed = "]" if table.right_closed and high is not None else ")"
        text = (
            opened
            + ("-inf" if low is None else format_number(low))
            + ", "
            + ("inf" if high is None else format_number(high))
            + closed
        )
        rows.append(
            {
                "position": position, "lo": low, "hi": high, "text": text,
                "value": table.values[position], "is_missing": False,
            }
        )
    rows.append(
        {
            "position": len(rows), "lo": None, "hi": None, "text": "missing",
            "value": table.missing, "is_missing": True,
        }
    )
    return rows
