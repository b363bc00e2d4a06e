import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import simhash_similar as sim


def plain_sets(texts):
    out = []
    for t in texts:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        width = min(5, len(words)) or 1
        out.append({tuple(words[k : k + width]) for k in range(len(words) - width + 1)})
    return out


def plain_links(texts):
    sets = plain_sets(texts)
    return {(a, b) for a, b in combinations(range(len(texts)), 2)
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0}


def roots_of(n, links):
    root = list(range(n))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k
    for a, b in sorted(links):
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return [top(k) for k in range(n)]


def kept(spark, texts, parts=5):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    return {r.doc_id for r in sim.one_of_each(df).collect()}


def edited(rng, words, share):
    return [w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in words]


def test_what_stays_equals_brute_force(spark):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [None, "", "  ", "a b c", "A b  C", "a b d"]
    for _ in range(60):
        base = [word() for _ in range(rng.choice([8, 40, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 0.005, 0.015, 0.03]))))
    got, links = kept(spark, texts), plain_links(texts)
    roots = roots_of(len(texts), links)
    wanted = {k for k, r in enumerate(roots) if r == k}
    assert wanted <= got  # nothing below the limit is linked
    gone, found = len(texts) - len(wanted), len(texts) - len(got)
    assert gone > 60 and found >= 0.9 * gone
    assert len(got & {0, 1, 2}) == 1 and len(got & {3, 4}) == 1 and 5 in got


def test_links_are_found_at_every_similarity():
    """Pairs that reach the limit share a list and pass the bits: most from 0.8 on, nearly all from 0.85 on."""
    rng = random.Random(2)
    met = {0.8: [], 0.85: [], 0.9: []}
    for _ in range(1500):
        base = [str(rng.random()) for _ in range(300)]
        other = list(base)
        for k in rng.sample(range(300), rng.randrange(1, 9)):
            other[k] = str(rng.random())
        a, b = (sim.shingles(" ".join(x)) for x in (base, other))
        shared = len(np.intersect1d(a, b))
        similarity = shared / (len(a) + len(b) - shared)
        f, g = (np.array(sim.fingerprint(x), "<i8").view("<u8") for x in (a, b))
        same = f.view(np.uint8) == g.view(np.uint8)
        listed = same[sim._PLACES].all(axis=1).any()
        ok = listed and np.bitwise_count(f ^ g).sum() <= sim.MOST_BITS and np.bitwise_count(f[0] ^ g[0]) <= sim.MOST_SHORT_BITS
        for least in (0.9, 0.85, 0.8):
            if similarity >= least:
                met[least].append(ok)
                break
    share = {k: sum(v) / len(v) for k, v in met.items()}
    assert share[0.8] > 0.78 and share[0.85] > 0.9 and share[0.9] > 0.98, share


def test_a_large_group_and_clashing_columns(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = [(k, " ".join(edited(rng, base, 0.004)), "x", k, 1) for k in range(3000)]
    rows += [(5000 + k, " ".join(f"v{rng.randrange(3000)}" for _ in range(60)), "x", k, 1) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string, node long, row_id int").repartition(6)
    got = sim.one_of_each(df)
    assert got.columns == df.columns
    ids = {r.doc_id for r in got.collect()}
    sets = plain_sets([r[1] for r in rows[:3000]])
    centre = plain_sets([" ".join(base)])[0]
    tied = {k for k, s in enumerate(sets) if 5 * len(s & centre) >= 4 * len(s | centre)}
    assert len(ids & tied) <= 0.05 * len(tied) and set(range(5000, 5300)) <= ids and 0 in ids


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in sim.one_of_each(df).collect()))) == ["None", "None"]
    assert sim.one_of_each(df.filter(F.lit(False))).count() == 0


def test_every_component_is_whole(spark):
    """Links just above the limit, among them those of a large list, which a byte list's tree leaves out."""
    rng = random.Random(5)
    texts = []
    for _ in range(150):  # pairs from 0.75 to 0.85
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = list(base)
        for k in rng.sample(range(200), rng.randrange(4, 8)):
            other[k] = f"e{rng.randrange(10**6)}"
        texts += [" ".join(base), " ".join(other)]
    base = [f"v{rng.randrange(3000)}" for _ in range(150)]
    texts += [" ".join(edited(rng, base, 0.02)) for _ in range(300)]
    passage = [f"p{k}" for k in range(60)]
    texts += [" ".join([*passage, *(f"q{rng.randrange(10**6)}" for _ in range(90))]) for _ in range(200)]
    wanted = {k for k, r in enumerate(roots_of(len(texts), plain_links(texts))) if r == k}
    assert kept(spark, texts) == wanted


def test_prefixes_of_similar_sets_meet_in_any_order():
    rng = np.random.default_rng(6)
    for _ in range(400):
        both = np.unique(rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64))
        more = np.unique(rng.integers(0, 2**63, rng.integers(0, 16)).astype(np.uint64))
        cut = rng.integers(0, len(more) + 1)
        a, b = np.union1d(both, more[:cut]), np.union1d(both, more[cut:])
        known = np.sort(rng.permutation(np.union1d(a, b))[: rng.integers(0, 40)])
        counts = rng.integers(2, 6, len(known))
        shared = len(np.intersect1d(a, b))
        if 5 * shared >= 4 * (len(a) + len(b) - shared):
            assert len(np.intersect1d(sim.prefix(a, known, counts), sim.prefix(b, known, counts)))


def test_pairs_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    """Near copies about the limit: few pairs a text become rows, and no component is split."""
    made, beside = [], sim._beside

    def counted(pairs, texts, columns):
        made.append((pairs.count(), pairs.groupBy("u").count().agg(F.max("count")).first()[0]))
        return beside(pairs, texts, columns)

    monkeypatch.setattr(sim, "_beside", counted)
    rng = random.Random(7)
    base = [f"v{rng.randrange(3000)}" for _ in range(150)]
    texts = [" ".join(edited(rng, base, rng.choice([0.01, 0.015, 0.02]))) for _ in range(700)]
    wanted = {k for k, r in enumerate(roots_of(len(texts), plain_links(texts))) if r == k}
    assert kept(spark, texts) == wanted
    (byte_index, most), (prefix_lists, _) = made
    assert most <= sim.NEAREST and byte_index <= sim.NEAREST * len(texts)
    assert byte_index + prefix_lists <= 2 * sim.NEAREST * len(texts), made


def test_folded_parities_leave_out_no_link():
    rng = np.random.default_rng(8)
    for _ in range(300):
        both = rng.integers(0, 2**63, rng.integers(20, 400)).astype(np.uint64)
        more = rng.integers(0, 2**63, len(both) // 4).astype(np.uint64)
        cut = rng.integers(0, len(more) + 1)
        sets = [np.unique(np.concatenate(x)) for x in ((both, more[:cut]), (both, more[cut:]))]
        shared = len(np.intersect1d(*sets))
        n = np.array([len(x) for x in sets])
        order = np.argsort(n, kind="stable")
        odd = np.bitwise_xor.reduce(np.array([sim.parities(sets[k]) for k in order]).reshape(2, -1, sim.LIST_PARTS), axis=1)
        zero = np.zeros(2, np.int64)
        found = list(sim._crossed(zero, n[order], zero, np.arange(2), np.arange(2), *odd.T.copy()))
        if 5 * shared >= 4 * (n.sum() - shared):
            assert sum(b.num_rows for b in found) == 1
