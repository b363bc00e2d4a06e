import math
import random

import numpy as np
import pytest

from riskloom.llm.embedding_dedup import Coder, Limits, flips, learn, links, near_duplicates, unit

KINDS = "vec_id long, embedding array<float>, label int, n int, ball string, node double"


def plain(rows, cosine=0.98):
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
          for _, v, lab in rows]
    units = [np.array(v, float) / np.abs(v).max() if o else None for o, (_, v, _) in zip(ok, rows)]
    units = [u if u is None else u / np.sqrt(u @ u) for u in units]
    near = [[b for b in range(len(rows)) if b != a and ok[a] and ok[b] and rows[a][2] == rows[b][2]
             and len(rows[a][1]) == len(rows[b][1]) and units[a] @ units[b] >= cosine] for a in range(len(rows))]
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            new = [b for b in near[todo.pop()] if b not in seen]
            seen.update(new)
            todo += new
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[a][0], len(near[a]), least, rows[a][0] == least))
    return sorted(out, key=repr)


def narrow(v):
    return [float(np.float32(x)) for x in v]


def made(n, dim, seed=0, groups=8, copies=12, spread=0.07, labels=3):
    rng = np.random.default_rng(seed)
    rows = [(k, narrow(rng.standard_normal(dim)), int(rng.integers(labels))) for k in range(n)]
    for g in range(groups):
        centre, lab = unit(rng.standard_normal((1, dim)))[0], int(rng.integers(labels))
        for _ in range(copies):
            v = centre + rng.standard_normal(dim) * spread * rng.choice([0.5, 1, 2]) / math.sqrt(dim)
            rows.append((len(rows), narrow(v * rng.choice([1, 3, 1e-3])), lab))
    return rows


def run(spark, rows, limits=Limits()):
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], KINDS).repartition(3)
    return sorted(map(tuple, near_duplicates(df, limits).collect()), key=repr)


@pytest.mark.parametrize("limits", [
    Limits(), Limits(hot=4, hot_times=0, cell=3, counted=1), Limits(bits_per_table=8, hot=2, hot_times=0, cell=1, counted=2),
    Limits(hot=10**6, cell=2, counted=1),
])
def test_equals_brute_force(spark, limits):
    rows = made(200, 64) + made(60, 9, 1, groups=3) + made(30, 2, 2, groups=0) + made(30, 100, 3, groups=3)
    rows = [(k, v, lab) for k, (_, v, lab) in enumerate(rows)]
    some = rows[:3] + rows[200:203]
    rows += some + [(None, rows[205][1], rows[205][2]), (None, [1.0, 2.0], 7)]  # repeated, and without ids
    rows += [(2000, None, 1), (2001, [0.0] * 64, 1), (2002, [1.0, None], 1), (2003, [float("nan")] * 2, 1)]
    rows += [(2004, [float("inf"), 1.0], 1), (2005, rows[210][1], None), (2006, [], 1), (2007, [1e-38, 1e-30], 7)]
    assert run(spark, rows, limits) == plain(rows)


def test_one_hot_group(spark):
    rows = made(50, 64, groups=1, copies=400, spread=0.06, labels=1) + [(1000, [1.0] * 64, 0)]
    want = plain(rows)
    assert run(spark, rows, Limits(hot=16, cell=16, counted=1)) == want
    assert run(spark, rows, Limits(hot=10**9, cell=32, counted=3)) == want


def test_huge_and_tiny_components(spark):
    rows = [(k, [1e300 * x for x in v] if k % 2 else [1e-300 * x for x in v], 1) for k, v, _ in made(10, 5, groups=2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, near_duplicates(df).collect()), key=repr) == plain(rows)


def test_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], KINDS)).count() == 0
    assert run(spark, [(1, None, 1)]) == [(1, 0, 1, True)]


def test_rotation_is_one_and_loses_less_than_a_random_one():
    rng = np.random.default_rng(5)
    x = unit(rng.standard_normal((2000, 16)) * np.linspace(0.2, 2, 16))
    loss = lambda axes: ((np.sign((x - mean) @ axes) / 4 - (x - mean) @ axes) ** 2).sum()
    mean, axes = learn(x, 16, 50)
    assert np.allclose(axes.T @ axes, np.eye(16))
    assert loss(axes) < loss(np.linalg.qr(rng.standard_normal((16, 16)))[0])
    assert np.abs(((x - mean) @ axes >= 0).mean(axis=0) - 0.5).max() < 0.1


def test_every_link_meets_in_a_table():
    rng = np.random.default_rng(6)
    x = unit(rng.standard_normal((3000, 64)))
    y = unit(x + rng.standard_normal((3000, 64)) * 0.02)
    y = y[(x * y).sum(axis=1) >= 0.98]
    x = x[: len(y)] if len(y) == len(x) else x[(x * unit(x + 0)).sum(axis=1) >= 0][: len(y)]
    coder = Coder(Limits(), {64: learn(x, 64, 20)})
    (cx, wx, mx), (cy, wy, my) = coder(x), coder(y)
    linked = (x * y).sum(axis=1) >= 0.98
    met = np.zeros(len(x), bool)
    differ = np.unpackbits((cx ^ cy).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    differ = np.pad(differ, ((0, 0), (0, 1))).reshape(-1, 5, 13)
    met = (np.where(differ, np.minimum(wx, wy), 0).sum(axis=2, dtype=int) <= 250).any(axis=1)
    assert linked.any() and met[linked].all()
    for k, level in enumerate((0, 3, 9)):
        for m in (mx, my):
            assert (np.bitwise_count((cx ^ cy) & m[:, k])[linked] <= level).all()


def test_flips_are_all_small_sets():
    rng = random.Random(7)
    weights = np.array([[rng.choice([10, 90, 120, 255]) for _ in range(6)] for _ in range(20)], np.uint8)
    row, mask, spent = map(np.concatenate, zip(*flips(weights)))
    assert spent.max() <= 250
    want = {(r, m) for r in range(20) for m in range(64) if sum(int(weights[r, b]) for b in range(6) if m >> b & 1) <= 250}
    assert sorted(zip(row.tolist(), mask.tolist())) == sorted(want) and (mask[:20] == 0).all()


def test_many_flips_are_made_in_pieces():
    found = list(flips(np.ones((40, 16), np.uint8)))
    assert max(len(f[0]) for f in found) <= 1 << 14
    assert len({(int(r), int(m)) for rows, masks, _ in found for r, m in zip(rows, masks)}) == 40 << 16


def test_entries_report_no_pairs(spark):
    """Rows of links grow with the group, not with its pairs."""
    from riskloom.llm import embedding_dedup as of

    rows = made(0, 64, groups=1, copies=400, spread=0.05, labels=1)
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], KINDS)
    seen = []
    whole, of.links = of.links, lambda *a: seen.append(links(*a)) or seen[-1]
    try:
        of.near_duplicates(df, Limits(hot=10**9))
    finally:
        of.links = whole
    assert seen[0].count() < 400 * 40
