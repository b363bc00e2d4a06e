"""First-match rule tables over a score and a balance, as Column expressions.

A table of rules is constant between its limits, so it is laid out once as a small grid
(table x score position x balance position -> result).  A row then needs one comparison
per distinct limit and one array lookup, instead of a CASE arm with four comparisons per
rule; the generated code stays small enough for the JIT with all tables in one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.settings import NO_PROFILE




@dataclass(frozen=True)
class Band:
    """A numeric interval; each end may be absent, and each may be open or closed."""

    low: float | None = None
    high: float | None = None
    low_closed: bool = True
    high_closed: bool = False

    @classmethod
    def parse(cls, low, high) -> "Band":
        low_value, low_closed = low if isinstance(low, tuple) else (low, True)
        high_value, high_closed = high if isinstance(high, tuple) else (high, False)
        return cls(low_value, high_value, low_closed, high_closed)

    def tests(self, value: Column) -> list[Column]:
        found = []
        if self.low is not None:
            found.append(value >= self.low if self.low_closed else value > self.low)
        if self.high is not None:
            found.append(value <= self.high if self.high_closed else value < self.high)
        return found

    def holds(self, value) -> bool:
        """Whether a value lies inside; None only does if the band has no end."""
        if value is None:
            return self.low is None and self.high is None
        above = self.low is None or value > self.low or (self.low_closed and value == self.low)
        below = self.high is None or value < self.high or (self.high_closed and value == self.high)
        return above and below

    @property
    def steps(self) -> list[tuple]:
        """Where the band's truth can change: at (limit, 0) ">= limit" starts to hold, at
        (limit, 1) "> limit" does."""
        found = []
        if self.low is not None:
            found.append((float(self.low), 0 if self.low_closed else 1))
        if self.high is not None:
            found.append((float(self.high), 1 if self.high_closed else 0))
        return found


@dataclass(frozen=True)
class Rule:
    """Score band and balance band; ``null_balance`` also admits a NULL balance."""

    score: Band
    balance: Band
    null_balance: bool
    label: str

    @classmethod
    def parse(cls, row: Sequence) -> "Rule":
        score_low, score_high, balance_low, balance_high, null_balance, label = row
        return cls(
            Band.parse(score_low, score_high),
            Band.parse(balance_low, balance_high),
            bool(null_balance),
            label,
        )

    def condition(self, score: Column, balance: Column) -> Column:
        within = _all(self.balance.tests(balance))
        if self.null_balance:
            within = within | balance.isNull()
        return _all([*self.score.tests(score), within])

    def holds(self, score, balance) -> bool:
        within = self.balance.holds(balance) or (self.null_balance and balance is None)
        return self.score.holds(score) and within


def _all(tests: list[Column]) -> Column:
    return reduce(and_, tests) if tests else F.lit(True)


def parse_rules(rows) -> list[Rule]:
    return [row if isinstance(row, Rule) else Rule.parse(row) for row in rows]


def limit_points(rows) -> tuple[list, list]:
    """The limits of a rule table on scores and on balances, each with NULL."""
    parsed = parse_rules(rows)
    axes = [[rule.score for rule in parsed], [rule.balance for rule in parsed]]
    scores, balances = (sorted({float(at) for at, _ in _axis(bands)}) for bands in axes)
    return [*scores, None], [*balances, None]


def _axis(bands: list[Band]) -> list[tuple]:
    return sorted({step for band in bands for step in band.steps})


def _points(steps: list[tuple]) -> list:
    """One value per position of an axis: before the first step, after each step, NULL."""
    if not steps:
        return [0.0, None]
    points = [steps[0][0] - 1.0]
    for (limit, strict), after in zip(steps, [*steps[1:], (steps[-1][0] + 2.0, 0)]):
        points.append((limit + after[0]) / 2 if strict else limit)
    return [*points, None]


def _position(value: Column, steps: list[tuple]) -> Column:
    """Index into :func:`_points`: the number of steps passed; NULL comes after the last."""
    known = F.coalesce(value.cast("double"), F.lit(float("nan")))   # NaN passes every step
    passed = [(known > at if strict else known >= at).cast("int") for at, strict in steps]
    return reduce(add, passed, value.isNull().cast("int"))


def _grid_lookup(score, balance, tables: list, result, table: Column | None = None) -> Column:
    """``result(rules that hold)`` for each row; ``table`` is the index of the row's table."""
    parsed = [parse_rules(rows) for rows in tables]
    every = [rule for rules in parsed for rule in rules]
    score_axis = _axis([rule.score for rule in every])
    balance_axis = _axis([rule.balance for rule in every])
    scores, balances = _points(score_axis), _points(balance_axis)
    cells = [
        result([rule for rule in rules if rule.holds(s, b)])
        for rules in parsed for s in scores for b in balances
    ]
    index = _position(score, score_axis) * len(balances) + _position(balance, balance_axis)
    if table is not None:
        index = table * (len(scores) * len(balances)) + index
    return F.get(F.lit(cells), index)   # the optimizer folds the array to one literal


def _label_or(default: str):
    return lambda held: held[0].label if held else default


def first_match(score: Column, balance: Column, rules, default: str = NO_PROFILE) -> Column:
    """Label of the first rule that holds, else ``default``."""
    return _grid_lookup(score, balance, [rules], _label_or(default))


def match_count(score: Column, balance: Column, rules) -> Column:
    """How many rules hold: 0 is a gap, more than 1 an overlap."""
    return _grid_lookup(score, balance, [rules], len).cast("int")


def has_experience(model_type: Column) -> Column:
    """Whether a model type ends in CE; NULL does not."""
    return F.coalesce(model_type.endswith("CE"), F.lit(False))


def _table_index(model_type: Column) -> Column:
    return F.lit(1) - has_experience(model_type).cast("int")


def first_match_by_type(model_type, score, balance, ce, se, default: str = NO_PROFILE) -> Column:
    """First match in the CE table for types that end in CE, else in the SE table."""
    return _grid_lookup(score, balance, [ce, se], _label_or(default), _table_index(model_type))


def match_count_by_type(model_type, score, balance, ce, se) -> Column:
    return _grid_lookup(score, balance, [ce, se], len, _table_index(model_type)).cast("int")


RULE_SCHEMA = T.StructType(
    [
        T.StructField("tabla", T.StringType(), False),
        T.StructField("orden", T.IntegerType(), False),
        T.StructField("score_min", T.DoubleType()),
        T.StructField("score_min_incl", T.BooleanType(), False),
        T.StructField("score_max", T.DoubleType()),
        T.StructField("score_max_incl", T.BooleanType(), False),
        T.StructField("saldo_min", T.DoubleType()),
        T.StructField("saldo_min_incl", T.BooleanType(), False),
        T.StructField("saldo_max", T.DoubleType()),
        T.StructField("saldo_max_incl", T.BooleanType(), False),
        T.StructField("incluye_missing", T.BooleanType(), False),
        T.StructField("etiqueta", T.StringType(), False),
    ]
)


def rules_frame(spark: SparkSession, tables: dict) -> DataFrame:
    """Rule tables as rows, for storage next to the data they were applied to."""

    def number(value):
        return None if value is None else float(value)

    rows = []
    for name, table in tables.items():
        for order, rule in enumerate(parse_rules(table), start=1):
            rows.append(
                (
                    name, order,
                    number(rule.score.low), rule.score.low_closed,
                    number(rule.score.high), rule.score.high_closed,
                    number(rule.balance.low), rule.balance.low_closed,
                    number(rule.balance.high), rule.balance.high_closed,
                    rule.null_balance, rule.label,
                )
            )
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rules_from_rows(rows) -> list[Rule]:
    """Rules from rows of :data:`RULE_SCHEMA` of one table, in their stored order."""
    return [
        Rule(
            Band(r["score_min"], r["score_max"], r["score_min_incl"], r["score_max_incl"]),
            Band(r["saldo_min"], r["saldo_max"], r["saldo_min_incl"], r["saldo_max_incl"]),
            r["incluye_missing"],
            r["etiqueta"],
        )
        for r in sorted(rows, key=lambda r: r["orden"])
    ]
