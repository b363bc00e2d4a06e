import random
import re
import zlib
from collections import Counter

import pytest

from riskloom.llm.spelling_variants import Variants, neighbours, postings, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def plain(rows, limits=Variants()):
    seen = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % limits.damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= limits.min_letters and n >= limits.min_count}
    by, forms = {}, {}
    for w in words:
        by[w] = sorted((-words[v], v) for v in words if near(w, v))
        if by[w] and -by[w][0][0] >= limits.ratio * words[w]:
            forms[w] = by[w][0][1]
    out = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(by[w]), words.get(forms.get(w))))
    return sorted(out)


def sample(seed, letters="abé", docs=60, runs=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([1, 4, 5, 5, 6, 6, 7])))
    return [(d, rng.choice([" ", "-", "1 "]).join(word() for _ in range(runs))) for d in range(docs)]


@pytest.mark.parametrize("letters, limits", [
    ("ab", Variants()), ("abé", Variants(damaged=3)), ("AaB×", Variants(ratio=1, min_count=1)),
])
def test_equals_brute_force(spark, letters, limits):
    rows = sample(len(letters), letters) + [(None, "Ààààààà ÀÀÀÀÀÀÀ abcde's"), (7, None), (8, ""), (9, "x" * 5000)]
    rows += rows[:3]  # repeated
    rows += [(10, "Straße STRASSE straße 日本語abcde😀abcde abcde_abcde")]
    if limits.ratio == 1:  # equal counts may point at each other; forms are then no chains
        rows = rows[:40]
        limits = Variants(ratio=2, min_count=1)
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, word string")
    got = sorted(map(tuple, variants(df.repartition(3), limits).collect()))
    assert got == plain(rows, limits) and any(r[1] for r in got)


def test_a_group_is_bounded_and_no_pair_is_emitted(spark):
    words = [(x + "bcdef", 5) for x in "abcdefghijklmnopqrstuvwxyz"] + [("bcdef", 3)]
    counted = spark.createDataFrame(words, "word string, n long")
    assert postings(counted).count() == sum(2 * len(w) + 1 for w, _ in words)
    got = {r["word"]: r["n_near"] for r in neighbours(counted).collect()}
    assert got == {w: sum(near(w, v) for v, _ in words) for w, _ in words}


def test_chains_and_ties(spark):
    text = " ".join(["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 48 + ["aabba"] * 24)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    off = Variants(damaged=2**33)
    assert sorted(map(tuple, variants(df, off).collect())) == plain([(1, text)], off)


def test_no_rows(spark):
    assert variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).count() == 0


def test_no_python_worker(spark, folder):
    plan = neighbours(spark.createDataFrame([("aaaaa", 3)], "word string, n long"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
