import random
import re
import time
from itertools import combinations

from riskloom.llm import license_scan as ls


def test_longest_rising_run_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        pairs = list(enumerate(rng.sample(range(9), rng.randrange(0, 9))))
        best = max(n for n in range(len(pairs) + 1) if n == 0 or any(
            all(x[1] < y[1] for x, y in zip(c, c[1:])) for c in combinations(pairs, n)))
        got = ls.rising(pairs)
        assert len(got) == best and all(x < y and u < v for (x, u), (y, v) in zip(got, got[1:]))


def test_alignment_pairs_equal_words_in_order():
    rng = random.Random(2)
    for _ in range(300):
        b = rng.choices("abcdefghijklmnop", k=30)
        a = [w for w in b if rng.random() < 0.8]
        for _ in range(4):
            a.insert(rng.randrange(len(a)), "x")
        pairs = ls.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    assert ls.align(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)] and ls.align([], ["a"]) == []


def test_notices_are_found_where_they_stand(spark):
    rng = random.Random(3)
    rows, wanted = [], {}
    prose = lambda n: " ".join(rng.choices(["the", "of", "software", "is", "any", "river", "free", "use"], k=n))
    for k, (name, text) in enumerate(ls.NOTICES.items()):
        if len(text.split()) > 12:
            words = text.split()
            for _ in range(len(words) // 20):  # one word in twenty is changed, some are put in
                words[rng.randrange(len(words))] = "changed"
                words.insert(rng.randrange(1, len(words)), "new")
            text = " ".join(words).upper() if k % 2 else "\n * ".join(words)
        before = prose(rng.choice([0, 5, 4000]))
        rows.append((k, f"{before} Q.\n{text}. {prose(30)}"))
        wanted[k] = name
    rows += [(100, None), (101, ""), (102, prose(50_000)), (103, "All rights. Reserved all rights reserved; all RIGHTS reserved"), (None, "all rights reserved"), (1, rows[1][1])]
    got = ls.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for k, name in wanted.items():
        found = by_doc[k][0]
        assert {r.license for r in by_doc[k]} == {name} and found.coverage >= 0.8
        assert rows[k][1][: found.start].strip().endswith(("Q.", "* ", "changed")) or name in ("gpl-line",)
    assert len(by_doc[1]) == 2 and not {100, 101, 102} & set(by_doc)
    assert [(r.start, r.end) for r in by_doc[103]] == [m.span() for m in re.finditer(r"all rights\W+reserved", rows[-3][1], re.I)]


def test_prefilter_skips_no_finding():
    known = ls.notices()
    rng = random.Random(4)
    for name, words in known.words.items():
        spare = len(words) - known.scan.wanted(len(words))
        for _ in range(20):
            gone = set(rng.sample(range(len(words)), spare))
            kept = [w for k, w in enumerate(words) if k not in gone]
            assert next(known.needed.iter(" ".join(kept)), None) is not None, name


def without(text, *words):
    return " ".join(w for w in text.split() if w.lower() not in words)


def test_members_of_a_family_are_told_apart():
    known, notice = ls.notices(), ls.NOTICES
    one = lambda text: [(f[0], f[5]) for f in known.find(text)]
    clause = notice["bsd-3-clause"].replace("the copyright holder nor", "Example Ltd. nor")
    assert one(f"x {clause} y")[0][0] == "bsd-3-clause" and one(notice["bsd-2-clause"])[0][0] == "bsd-2-clause"
    gpl = notice["gpl-notice"]
    assert one(gpl) == [("gpl-notice", "3")] and one(gpl.replace("version 3", "version 2")) == [("gpl-notice", "2")]
    assert one(gpl.replace("General", "Affero General")) == [("agpl-notice", "3")]
    assert one(gpl.replace("General", "Lesser General")) == [("lgpl-notice", "3")]
    assert one(without(notice["lgpl-notice"], "lesser")) == [("gpl-notice", "2.1")]
    for kind in ("", "-SA", "-ND", "-NC", "-NC-SA", "-NC-ND"):
        assert one(f"a. Licensed under CC BY{kind} 4.0.") == [(f"cc-by{kind.lower()}-line", "4.0")]
        assert one(f"a. Licensed under CC BY{kind} by us.") == [(f"cc-by{kind.lower()}-line", None)]
    for kind in ("", "Lesser ", "Affero "):
        name = {"": "gpl", "Lesser ": "lgpl", "Affero ": "agpl"}[kind] + "-line"
        assert one(f"It is licensed under the GNU {kind}General Public License, version 2.1 or later") == [(name, "2.1")]
    assert one("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nint x;") == [
        ("spdx-line", "(MIT OR Apache-2.0) AND BSD-3-Clause")]
    assert one("Licensed under the Apache License, Version 2.0")[0] == ("apache-line", "2.0")


def test_findings_that_stay_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        found = []
        for _ in range(rng.randrange(12)):
            start = rng.randrange(40)
            found.append((rng.randrange(6), start, start + rng.randrange(1, 15), rng.choice("ab"), 3))
        kept = []
        for f in sorted(found, key=lambda f: (-f[0], f[1], f[3])):
            if all(f[2] <= k[1] or f[1] >= k[2] for k in kept):
                kept.append(f)
        assert ls.apart(found) == sorted(k[1:] for k in kept)


def test_many_findings_take_time_in_proportion():
    began = time.perf_counter()
    assert len(ls.notices().find("All rights reserved. " * 100_000)) == 100_000
    assert time.perf_counter() - began < 20


def test_a_column_of_a_clashing_name_is_not_read(spark):
    df = spark.createDataFrame([(1, "all rights reserved", "x", "mit")], "doc_id long, text string, start string, license string")
    assert [(r.license, r.start) for r in ls.find_licenses(df).collect()] == [("rights-reserved", 0)]


def test_empty_table(spark):
    assert ls.find_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
