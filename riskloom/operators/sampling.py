"""Seeded sample of an exact size, without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.prefix import running_totals

#: hexadecimal digits counted in one pass: at most 16 ** _DIGITS counts come to the driver
_DIGITS = 4
_LENGTH = 32


def sample_hash(key: str, seed: int) -> Column:
    """A NULL key has a hash like any other."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("\0"))
    return F.md5(F.concat(text, F.lit(f":{seed}")))


def fold_number(key: str, n_folds: int, seed: int = 17) -> Column:
    """Reproducible fold 0 .. n_folds - 1 from a hash of ``key``."""
    head = F.conv(F.substring(sample_hash(key, seed), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(n_folds)).cast("int")


def with_folds(
    df: DataFrame, strata: list[str], key: str, n_folds: int, seed: int = 17, output: str = "fold"
) -> DataFrame:
    """``df`` with a reproducible fold 0 .. n_folds - 1, dealt in turn along the hash of ``key``
    within each stratum, so that folds of a stratum differ by one row at most."""
    hashed = df.withColumns({"__h": sample_hash(key, seed), "__one": F.lit(1).cast("long")})
    ranked = running_totals(hashed, strata, "__h", ["__one"])
    turn = F.pmod(F.col("__one_upto") - 1, F.lit(n_folds)).cast("int")
    return ranked.withColumn(output, turn).select(*df.columns, output)


def _cut_off(df: DataFrame, digest: Column, fraction: float, wanted: int | None) -> tuple[str, int, int]:
    """The shortest prefix at which the ``wanted`` smallest digests end, how many of the rows with
    it still belong to them, and how many there are. ``wanted`` None: ``fraction`` of the rows."""
    digests, prefix = df.select(digest.alias("h")), ""
    while True:
        inside = digests.filter(F.col("h").startswith(prefix)) if prefix else digests
        counts = inside.groupBy(F.substring("h", len(prefix) + 1, _DIGITS).alias("d")).count()
        found = sorted((r["d"], r["count"]) for r in counts.collect())
        if wanted is None:
            wanted = int(fraction * sum(c for _, c in found))
        if not wanted:
            return "", 0, 0
        for digits, count in found:
            if wanted <= count:
                break
            wanted -= count
        prefix += digits
        if wanted == count or len(prefix) == _LENGTH:
            return prefix, wanted, count


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: int = 13) -> DataFrame:
    """Exactly ``int(fraction * rows)`` rows: those with the smallest hash of ``key``.

    The cut-off hash is found digit group by digit group: each pass counts rows per next digits
    and narrows the prefix, so nothing but counts is shuffled and the sample itself is a filter.
    Rows that share a key at the cut-off are told apart by a hash of the whole row in the same
    way; of rows that are equal in every column any are as good as others, and one stands for
    as many as are still wanted.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie in [0, 1]")
    digest = sample_hash(key, seed)
    cut, wanted, count = _cut_off(df, digest, fraction, None)
    if not wanted:
        return df.limit(0)
    if wanted == count:
        return df.filter(F.substring(digest, 1, len(cut)) <= cut)
    below, tied = df.filter(digest < cut), df.filter(digest == cut)
    whole = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    cut, wanted, count = _cut_off(tied, whole, 0, wanted)
    if wanted == count:
        return below.unionByName(tied.filter(F.substring(whole, 1, len(cut)) <= cut))
    alike = tied.filter(whole == cut).limit(1)
    repeated = alike.withColumn("__times", F.explode(F.sequence(F.lit(1), F.lit(wanted)))).drop("__times")
    return below.unionByName(tied.filter(whole < cut)).unionByName(repeated)
