import random
from itertools import combinations

import pytest
import xxhash

from riskloom.llm import simhash


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, near):
    parent = list(range(len(items)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(items)), 2):
        if near(items[i], items[j]):
            parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(items))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["w%d" % k for k in range(400)]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 80, 200])))) for k in range(60)]
    for k in range(60, 110):  # near copies of copies
        parts = rows[rng.randrange(3, k)][1].split(" ")
        parts[rng.randrange(len(parts))] = "changed"
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(k, rows[7][1].upper()) for k in range(110, 150)]
    return rows + [(200, None), (201, ""), (202, " \n "), (203, "İ KÉ"), (None, rows[9][1]), (9, rows[9][1])]


def test_fingerprints_and_components(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", __import__("pyspark").sql.functions.lit("x"))
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (doc, _), root in zip(rows, roots):
        if doc is not None:
            least[root] = min(doc, least.get(root, doc))
    wanted = [(d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(rows, prints, roots)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(wanted, key=key)
    assert len({r for r in roots}) < len(rows) - 50
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))


def test_long_chain_of_close_fingerprints(spark):
    value, chain = 0, [0]
    rng = random.Random(1)
    for _ in range(300):
        for b in rng.sample(range(64), 3):
            value ^= 1 << b
        chain.append(value)
    chain += [rng.getrandbits(64) for _ in range(50)]
    chain = sorted(set(chain))
    signed = [x - (1 << 64) if x >> 63 else x for x in chain]
    tied = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    roots = {}
    for x, r in zip(signed, plain_components(chain, lambda a, b: (a ^ b).bit_count() <= 3)):
        roots.setdefault(r, []).append(x)
    wanted = {x: min(g) for g in roots.values() if len(g) > 1 for x in g}
    assert {r.node: r.root for r in tied} == wanted


def test_long_lists_look_up_near_words():
    import numpy as np

    rng = np.random.default_rng(0)
    low = np.unique(rng.integers(0, 1 << 24, 3000, dtype=np.uint32))
    small = [set(map(int, low[[r, *o]])) for r, o in simhash._forest(low)]
    plain = plain_components(list(map(int, low[:1500])), lambda a, b: (a ^ b).bit_count() <= 3)
    groups = {}
    for x, r in zip(low[:1500], plain):
        groups.setdefault(r, set()).add(int(x))
    assert all(any(g <= s for s in small) for g in groups.values() if len(g) > 1)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.one_of_each(docs).count() == 0


def test_one_of_each_when_splits_change_between_scans(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    own = [" ".join(rng.choices(["w%d" % k for k in range(400)], k=80)) for _ in range(8)]
    rows = [(k, own[k % 8]) for k in range(32)]
    for k in range(16):  # two rows a file
        spark.createDataFrame(rows[2 * k : 2 * k + 2], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs, real, name = spark.read.parquet(str(tmp_path / "docs")), simhash.groups, "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)

    def changed(prints):
        spark.conf.set(name, "4m")
        return real(prints)

    monkeypatch.setattr(simhash, "groups", changed)
    spark.conf.set(name, "128m")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        kept = sorted(map(tuple, simhash.one_of_each(docs).collect()))
    finally:
        spark.conf.set(name, before)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert kept == rows[:8]
