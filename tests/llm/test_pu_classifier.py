import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from riskloom.llm import pu_classifier as pu


def test_learning_needs_no_negative_labels():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (3000, len(pu.MEASURES))), rng.normal(-1, 1, (1000, len(pu.MEASURES)))
    x, y = np.vstack([good, bad]), np.r_[np.ones(3000), np.zeros(1000)]
    model = pu.learn(x, y)
    again = pu.learn(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97 and model.prior == 0.75
    assert (model.weights == again.weights).all()


def test_risk_never_goes_below_zero_for_long():
    """A model flexible enough to tell every row apart still keeps unlabelled positives."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, len(pu.MEASURES))), np.r_[np.ones(30), np.zeros(30)]
    scores = pu.learn(x, y, pu.Training(steps=3000, weight_decay=0)).score(x)
    assert np.isfinite(scores).all() and scores.mean() > 0.3


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in pu.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    known = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    tested = [(r["quality"], got[r["doc_id"]]) for r in known if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r.held_out for _, r in tested) and len(tested) > 50
    assert sum(r.predicted == q for q, r in tested) / len(tested) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(0)
    words = ["".join(rng.choices("aeionrst", k=rng.randrange(2, 9))) for _ in range(300)]
    return lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."


def test_labels_of_held_out_rows_do_not_matter(spark, prose):
    rows = [(k, prose(60) if k % 3 else "### $$$ " * 30, "x") for k in range(300)]
    rows += [(None, None, "x"), (1000, "", "x"), (1001, "long " * 100_000, "x"), (1, rows[1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    true = [(k, int(k % 3 > 0)) for k in range(300)] + [(None, 1), (5, None), (2, 1), (9999, 1)]
    turned = [(k, 1 - q if k is not None and q is not None and out(k) else q) for k, q in true]
    results = []
    for labels in (true, turned):
        df = spark.createDataFrame(labels, "doc_id long, quality int")
        results.append(sorted(map(tuple, pu.classify(docs, df).collect()), key=str))
    assert results[0] == results[1] and len(results[0]) == len(rows)
    kept = pu.accepted(docs, spark.createDataFrame(true, "doc_id long, quality int"))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(k for k in range(300) if k % 3) <= set(ids) and not set(k for k in range(300) if k % 3 == 0) & set(ids)


def test_empty_tables(spark, prose):
    no_docs = spark.createDataFrame([], "doc_id long, text string")
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert pu.classify(no_docs, no_labels).count() == 0
    docs = spark.createDataFrame([(1, prose(9))], "doc_id long, text string")
    assert [r.score for r in pu.classify(docs, no_labels).collect()] == [0.5]


def test_unlabelled_text_counts(spark, prose):
    """Bad text of a kind that no labelled row shows is learned from unlabelled rows alone."""
    rows = [(k, prose(60) if k < 300 or k % 2 else "### $$$ " * 30) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(300)], "doc_id long, quality int")
    model = pu.fit(pu.measured(docs), labels)
    good, bad = (model.score(np.array([pu.measures(t)]))[0] for t in (rows[301][1], rows[302][1]))
    assert good >= 0.3 > bad and model.prior < 0.85


def test_a_task_holds_few_texts_at_once(prose):
    """A batch of any size is measured in parts, each handed on before the next one is read."""
    texts = [None, "", *(prose(5 + k % 40) for k in range(3 * pu._TEXTS))]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    parts = pu._measured(iter([batch]))
    first = next(parts)
    assert first.num_rows == pu._TEXTS and first.column("id").to_pylist() == list(range(pu._TEXTS))
    rows = [r for part in [first, *parts] for r in part.to_pylist()]
    assert [r["id"] for r in rows] == list(range(len(texts)))
    assert [r["x"] for r in rows] == [pu.measures(t or "") for t in texts]


def test_measures_of_repeated_words():
    got = dict(zip(pu.MEASURES, pu.measures("b a a b c a a b")))
    assert (got["top_word"], got["adjacent_repeats"], got["distinct_pairs"]) == (0.5, 2 / 7, 5 / 7)
    assert got["distinct_words"] == 3 / 8 ** 0.8
