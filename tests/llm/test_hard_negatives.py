import math
import random

import numpy as np
import pytest

from riskloom.llm.hard_negatives import Mining, best_places, from_planes, mine, scores, to_planes


def plain(rows, every=100, scale=256, k=5):
    hold = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    usable = [
        (i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(scale * x) for x in v])
        for i, v, lab in rows
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, lab, q) in enumerate(usable):
        if i % every:
            continue
        scored = [
            (-hold(sum(x * y for x, y in zip(q, v))), j, other == lab)
            for b, (j, other, v) in enumerate(usable) if b != a and len(v) == len(q)
        ]
        for s, j, _ in sorted(x for x in scored if x[2])[:k]:
            fit = sorted(x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def made(n, seed=0, dim=5, labels=3):
    rng = random.Random(seed)
    pick = lambda: float(np.float32(rng.choice([rng.uniform(-1, 1), 0.5, -0.25])))
    return [(k, [pick() for _ in range(dim)], rng.randrange(labels)) for k in range(n)]


SMALL = Mining(every=5, candidates_per_block=16, blocks_per_slice=2, anchors_per_block=4, kept_blocks=2)


@pytest.mark.parametrize("mining", [Mining(every=5), SMALL])
def test_equals_brute_force(spark, mining):
    rows = made(300) + made(60, 1, dim=11)
    rows += [(1000 + k, [0.5] * 5, k % 3) for k in range(100)]  # ties
    rows += [(1500, None, 1), (1505, [0.1, None, 0.2, 0.3, 0.4], 1), (1510, [float("nan")] * 5, 1)]
    rows += [(1515, [float("-inf")] * 5, 1), (None, [0.5] * 5, 1), (1520, [0.5] * 5, None)]
    rows += [(0, rows[0][1], rows[0][2]), (35, rows[35][1], rows[35][2]), (3, rows[3][1], rows[3][2])]  # repeated
    kinds = "vec_id long, embedding array<float>, label int, score int, block int, rank string"
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], kinds).repartition(3)
    got = sorted(map(tuple, mine(df, mining).collect()))
    assert got == plain(rows, 5) and got


def test_huge_components(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([1e300, -3e5, 2.0**70, 7.0]), rng.uniform(-1, 1) * 2.0**40, 1.0], k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, mine(df, Mining(every=10)).collect())) == plain(rows, 10)


def test_few_and_no_rows(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    rows = [(0, [1.0], 0), (1, [1.0], 1), (2, [0.75], 2), (100, [], 1), (200, [], 1), (3, [], 2)]
    got = sorted(map(tuple, mine(spark.createDataFrame(rows, kinds)).collect()))
    assert got == plain(rows) and (0, 1, 1, 2, 65536, 49152) not in got
    assert mine(spark.createDataFrame([], kinds)).count() == 0


def test_lookups_equal_products():
    rng = np.random.default_rng(3)
    for dim, size in ((1, 3), (8, 256), (13, 5), (64, 300), (9, 2**29)):
        c, a = (rng.integers(-size, size, (n, dim)).astype(float) for n in (50, 7))
        planes = to_planes(c)
        assert (from_planes(planes, dim) == c).all()
        assert (scores(a, planes) == c.astype(np.int64).astype(object) @ a.astype(np.int64).astype(object).T).all()


def test_best_places_of_ties_and_large_scores():
    score = np.array([[5, 2**62], [7, -(2**62)], [5, 2**62], [7, 3]])
    allowed = np.array([[True, True], [True, True], [True, True], [False, False]])
    a, at = best_places(score, allowed, 2)
    assert sorted(zip(a.tolist(), at.tolist())) == [(0, 0), (0, 1), (1, 0), (1, 2)]
    a, at = best_places(score[:, :1], allowed[:, :1], 2)
    assert sorted(zip(a.tolist(), at.tolist())) == [(0, 0), (0, 1)]
