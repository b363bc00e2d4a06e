"""The best monotone grouping of prebins, by dynamic programming with dominance pruning.

Bins are runs of neighbouring prebins. A state is (last cut, bins so far, trend); it keeps only the partial
groupings that no other one dominates, that is, whose last rate leaves more room for the next bin or
whose information value is higher. So the next bin needs one look-up by rate in each state, and
the work grows with bins x prebins^2 instead of with the number of groupings, which are
counted in the same way and never listed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd

#: digits to which information values tell groupings apart; equal ones go to fewer, then to earlier cuts
DIGITS = 12
_MOST = 2**63 - 1


class Prebins:
    """Every run [lo, hi) of prebins as a bin: its rate, its information value and whether it may be one."""

    def __init__(self, n, events, min_share: float):
        self.parts = len(n)
        rows, bad = (np.concatenate([[0], np.cumsum(np.asarray(x, np.int64))]) for x in (n, events))
        n, e = (c[None, :] - c[:, None] for c in (rows, bad))
        with np.errstate(divide="ignore", invalid="ignore"):
            g, b = (n - e) / (rows[-1] - bad[-1]), e / bad[-1]
            self.rate, self.iv = e / n, (g - b) * np.log(g / b)
        self.fits = (n >= min_share * rows[-1]) & (e > 0) & (n > e)

    def ends(self, lo: int) -> np.ndarray:
        return np.flatnonzero(self.fits[lo])


def _pareto(states: list) -> list:
    """States (signed rate, -value, cuts, value) by rising rate, each better than all before it."""
    kept: list = []
    for state in sorted(states):
        if not kept or state[1:3] < kept[-1][1:3]:
            kept.append(state)
    return kept


def best_grouping(prebins: Prebins, max_bins: int) -> tuple[list[int], float] | None:
    """Cuts (before which prebin) and information value of the best feasible grouping."""
    found, parts = [], prebins.parts
    for trend in (1, -1):
        level = {0: [(-np.inf, 0.0, (), 0.0)]}
        for _ in range(max_bins):
            grown: dict[int, list] = {}
            for last, states in level.items():
                rates = [s[0] for s in states]
                for end in prebins.ends(last):
                    rate = trend * prebins.rate[last, end]
                    at = bisect_right(rates, rate) - 1
                    if at < 0:
                        continue
                    value = states[at][3] + prebins.iv[last, end]
                    cuts = states[at][2] + (int(end),)
                    grown.setdefault(int(end), []).append((rate, -round(value, DIGITS), cuts, value))
            found += [(s[1], len(s[2]), s[2][:-1], s[3]) for s in grown.pop(parts, ())]
            level = {end: _pareto(states) for end, states in grown.items()}
    if not found:
        return None
    least = min(found)
    return list(least[2]), -least[0]


def count_groupings(prebins: Prebins, max_bins: int) -> int:
    """The number of feasible groupings: those that rise, and those that fall, less those that do both."""

    def chains(allowed) -> int:
        total = 0
        ways = {(0, int(end)): 1 for end in prebins.ends(0)}
        for k in range(max_bins):
            total += sum(w for (_, end), w in ways.items() if end == prebins.parts)
            before: dict[int, list] = {}
            for (lo, end), w in ways.items():
                before.setdefault(end, []).append((prebins.rate[lo, end], w))
            ways = {}
            for last, seen in before.items():
                seen.sort()
                rates, sums = [s[0] for s in seen], [0]
                for _, w in seen:
                    sums.append(sums[-1] + w)
                for end in prebins.ends(last):
                    w = allowed(rates, sums, prebins.rate[last, end])
                    if w:
                        ways[(last, int(end))] = w
        return total


    rising = chains(lambda rates, sums, rate: sums[bisect_right(rates, rate)])
    falling = chains(lambda rates, sums, rate: sums[-1] - sums[bisect_left(rates, rate)])
    level = chains(lambda rates, sums, rate: sums[bisect_right(rates, rate)] - sums[bisect_left(rates, rate)])
    return rising + falling - level


#: what ``search`` returns for each row
SEARCHED = "struct<cuts: array<int>, iv: double, feasible: bigint>"


def search(n: pd.Series, events: pd.Series, max_bins: int, min_share: float) -> pd.DataFrame:
    """One grouping for each row of ``n`` and ``events``, arrays of prebin counts; no cuts and no value where
    a class is missing or nothing is feasible."""
    out = []
    for one_n, one_e in zip(n, events):
        found, count = None, 0
        if one_n is not None and len(one_n) and 0 < sum(one_e) < sum(one_n):
            prebins = Prebins(one_n, one_e, min_share)
            found, count = best_grouping(prebins, max_bins), min(count_groupings(prebins, max_bins), _MOST)
        out.append((*(found or ([], None)), count))
    return pd.DataFrame(out, columns=["cuts", "iv", "feasible"])
