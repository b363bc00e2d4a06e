import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.llm import quality_rules as qr

BLANK = "\t\n\x0b\x0c\r "


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    n, repeats = len(words), len(covered)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeats,
            n < 50 or 100 * repeats > 50 * n)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = ["the", "of", "a", "ñandú", "x#", "|", "***", "Word", "CAPS!!", "12", "end."]
    joins = [" ", "  ", "\n", "\t", "\r\n", "\x0b", " "]
    texts = ["".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.choice([0, 1, 3, 40, 60, 150]))) for _ in range(120)]
    vocabulary = ["".join(rng.choices("aeinorst", k=rng.randrange(2, 9))) for _ in range(500)]
    prose = [" ".join(rng.choices(vocabulary, k=100)).capitalize() + "." for _ in range(200)]
    junk = [" ".join(w + "***" for w in rng.choices(vocabulary, k=90)) for _ in range(20)]
    junk += [" | ".join(rng.choices(vocabulary, k=90)) for _ in range(20)]
    junk += [" ".join(w.upper() + "!!" for w in rng.choices(vocabulary, k=90)) for _ in range(20)]
    texts += ["", None, "\n\n", "a", "a b", "a b c a b c", "same line\n" * 40, "w " * 20_000, *prose, *junk]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [(None, texts[5]), (5, texts[5])], set(range(128, 328)), set(range(328, 388))


def test_base_measures_and_verdicts(spark, rows):
    rows, prose, junk = rows
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("quality"), F.lit("x").alias("votes"))
    got = qr.quality(docs).select("doc_id", "quality.*").collect()
    base = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(((r.doc_id, base(r)) for r in got), key=key) == sorted(((i, plain(t)) for i, t in rows), key=key)
    kept = {r.doc_id for r in got if r.kept}
    assert prose <= kept and not junk & kept
    stays = qr.good_documents(docs)
    assert stays.columns == docs.columns
    assert sorted(r.doc_id for r in stays.collect()) == sorted(r.doc_id for r in got if r.kept)


def plain_fit(patterns, limits):
    """The same rounds in plain numbers."""
    import math

    names = [r.name for r in qr.RULES]
    prior, good, bad = 0.5, dict.fromkeys(names, limits.start_good), dict.fromkeys(names, limits.start_bad)
    clip = lambda x, r: min(max(x, r[0]), r[1])
    for _ in range(limits.rounds):
        q = []
        for votes, _ in patterns:
            g, b = math.log(prior), math.log(1 - prior)
            for name, v in zip(names, votes):
                if v:
                    g += math.log(good[name] if v > 0 else 1 - good[name])
                    b += math.log(1 - bad[name] if v > 0 else bad[name])
            q.append(1 / (1 + math.exp(b - g)))
        total = sum(n for _, n in patterns)
        new_good, new_bad = {}, {}
        for k, name in enumerate(names):
            part = {(v, c): sum(n * (x if c else 1 - x) for (votes, n), x in zip(patterns, q) if votes[k] == v) for v in (1, -1) for c in (0, 1)}
            s = limits.smoothing
            new_good[name] = clip((part[1, 1] + s * limits.start_good) / (part[1, 1] + part[-1, 1] + s), limits.good_range)
            new_bad[name] = clip((part[-1, 0] + s * limits.start_bad) / (part[1, 0] + part[-1, 0] + s), limits.bad_range)
        new_prior = clip(sum(n * x for (_, n), x in zip(patterns, q)) / total, limits.prior_range)
        done = max(abs(new_prior - prior), *(abs(new_good[n] - good[n]) for n in names), *(abs(new_bad[n] - bad[n]) for n in names)) < 1e-6
        prior, good, bad = new_prior, new_good, new_bad
        if done:
            break
    return prior, good, bad


def test_fit_equals_plain_expectation_maximisation(spark):
    rng = random.Random(8)
    patterns = {}
    for _ in range(3000):
        fine = rng.random() < 0.8
        votes = tuple(rng.choice([0, 1]) if fine or rng.random() < 0.5 else -1 for _ in qr.RULES)
        patterns[votes] = patterns.get(votes, 0) + 1
    rows = [(v, n) for v, n in patterns.items()]
    fields = ", ".join(f"{r.name}: int" for r in qr.RULES)
    got = qr.fit(spark.createDataFrame(rows, f"votes struct<{fields}>, n long").coalesce(1))
    prior, good, bad = plain_fit(rows, qr.Limits())
    assert got.prior == pytest.approx(prior) and got.good == pytest.approx(good) and got.bad == pytest.approx(bad)
    assert 0.7 < prior < 0.9


def test_main_path_is_native(spark, rows):
    docs = spark.createDataFrame(rows[0], "doc_id long, text string")
    plan = qr.measured(docs, "text", "m")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert qr.quality(docs).count() == 0 and qr.good_documents(docs).count() == 0
