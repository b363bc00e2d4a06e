"""Each stage against what its operator says of the same documents."""

import pytest

import corpus_pipeline
from riskloom.llm import packing, pu_classifier, quality_rules, secrets
from .test_simhash_similar import plain_links, roots_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs[-1], FOLDER).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_order(chain):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "quality_classifier", "simhash_near_dedup", "secret_scan", "mixture_packing"
    ]
    assert all(df.columns == chain[0].columns for df in chain[:-1])
    assert all(0 < b.count() <= a.count() for a, b in zip(chain, chain[1:-1]))


def test_filters_follow_the_operators(spark, chain):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = quality_rules.quality(chain[0]).filter("quality.kept")
    assert ids(chain[1]) == ids(good)
    assert ids(chain[2]) == ids(pu_classifier.classify(chain[1], labels).filter("predicted = 1"))


def test_one_of_each_group_of_near_copies_stays(chain):
    texts = {r.doc_id: r.text for r in chain[2].collect()}
    order = sorted(texts)
    links = plain_links([texts[d] for d in order])
    first = {order[k] for k, r in enumerate(roots_of(len(order), links)) if r == k}
    got = set(ids(chain[3]))
    assert first <= got and len(order) - len(got) >= 0.9 * (len(order) - len(first)) > 0


def test_secrets_go_and_the_rest_stays(chain):
    before = {r.doc_id: r for r in chain[3].collect()}
    for r in chain[4].collect():
        found = secrets.spans(before[r.doc_id].text)
        assert r.text == secrets.redact(before[r.doc_id].text, found) and r.n_chars == len(r.text)
        assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)


def test_every_document_is_packed(chain):
    encode = packing.encoder(packing.Packing())
    texts = {r.doc_id: r.text for r in chain[4].collect()}
    packed = {}
    for r in chain[5].collect():
        packed.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert set(packed) == set(texts)
    for doc, pieces in packed.items():
        raw = b"".join(x for _, x in sorted(pieces))
        assert [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)] == [*encode(texts[doc]), 1]


def test_run_gives_the_last_stage(spark, chain):
    got = corpus_pipeline.run(spark, FOLDER)
    key = ["sequence_id", "offset", "doc_id", "ids_crc32"]
    rows = lambda df: sorted(map(tuple, df.select(*key).collect()))
    assert rows(got) == rows(chain[-1])


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 0
