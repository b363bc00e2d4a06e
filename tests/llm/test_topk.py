import math
import random

import pytest

from riskloom.llm import topk
from riskloom.llm.topk import Search, top_k


def plain(rows, k, every, scale=1024):
    usable = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in usable]
    out = []
    for a, (i, q) in enumerate(whole):
        if i % every:
            continue
        scored = [
            (-min(max(sum(x * y for x, y in zip(q, v)), -(2**63)), 2**63 - 1), j)
            for b, (j, v) in enumerate(whole) if b != a and len(v) == len(q)
        ]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def made(n, seed=0, dim=5):
    rng = random.Random(seed)
    return [(k, [rng.choice([rng.uniform(-1, 1), 0.5, -0.25]) for _ in range(dim)]) for k in range(n)]


@pytest.mark.parametrize("search", [Search(every=7), Search(k=3, every=5, candidates_per_block=16, queries_per_block=4, bins=8)])
def test_equals_brute_force(spark, search):
    rows = made(300) + made(40, 1, dim=3)
    rows += [(1000 + k, [0.5] * 5) for k in range(150)]  # ties
    rows += [(1400, None), (1407, [0.1, None, 0.2, 0.3, 0.4]), (1414, [float("nan")] * 5), (1421, [float("inf")] * 5), (None, [0.5] * 5)]
    rows += [(0, rows[0][1]), (35, rows[35][1]), (3, rows[3][1])]  # repeated rows
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    got = sorted(map(tuple, top_k(df, search).collect()))
    import numpy as np

    narrow = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == plain(narrow, search.k, search.every)


def test_huge_components_and_empty_vectors(spark):
    rows = [(k, [1e300 if k % 2 else -3e5, float(k)]) for k in range(20)] + [(100, []), (101, []), (200, [])]
    rows += [(300, [2.0**45, 1.0]), (301, [2.0**46, 3.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Search(k=4)).collect()
    assert sorted(map(tuple, got)) == plain(rows, 4, 100)


def test_fewer_than_k_and_none(spark):
    rows = [(0, [1.0]), (1, [2.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert list(map(tuple, got)) == [(0, 1, 1, 1024 * 2048)]
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert top_k(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_no_key_holds_more_than_a_slice(spark):
    search = Search(every=5, candidates_per_block=8, blocks_per_slice=2, queries_per_block=16)
    df = spark.createDataFrame(made(400), "vec_id long, embedding array<float>").repartition(3)
    packed = topk.stage(topk.blocks(df, search, "vec_id", "embedding"))
    queries = topk.query_blocks(packed, search)
    met = topk._met(packed, topk._repeated(queries, packed.select("dim", "slice").distinct()))
    keys = [r["count"] for r in met.groupBy("slice").count().collect()]
    blocks, n = packed.count(), queries.count()
    assert met.count() == blocks * n and max(keys) <= search.blocks_per_slice * n
    assert len(keys) >= blocks / search.blocks_per_slice
