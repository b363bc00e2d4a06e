import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm.packing import Packing, Rounds, encoder, pack

SMALL = Packing(sequence=64, quantum=16, window=64)


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = "the of token ñandú <|endoftext|> 12 x\n\n  ' don't 中文 \U0001f600".split(" ")
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60, 300]))) for _ in range(200)]
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in texts]
    rows = [(k, t, s) for k, (t, s) in enumerate(zip(texts, sources))]
    return rows + [(None, "no id", "a"), (3, rows[3][1], rows[3][2]), (900, None, "b"), (901, "x" * 5000, "d")]


def test_ids_equal_for_every_code_point(whole):
    encode = encoder(Packing())
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{chr(c)}a 1{chr(c)}1 {chr(c)} " for c in points[i : i + 40]) for i in range(0, len(points), 400)]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "a" * 9000, " " * 9000, ""]
    for t, e in zip(texts, whole.encode_batch_fast(texts, add_special_tokens=False)):
        assert encode(t) == e.ids


@pytest.mark.parametrize("targets", [None, {"a": 0.2, "b": 0.5}])
@pytest.mark.parametrize("packing", [SMALL, Packing(sequence=100, quantum=7, window=32, queues=3, tails=2)])
def test_every_id_lies_in_one_piece(spark, whole, rows, targets, packing):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).withColumn("n", __import__("pyspark").sql.functions.lit("x"))
    got = pack(docs, packing, targets).collect()
    wanted = defaultdict(list)
    for doc, text, _ in rows:
        wanted[doc].append([*whole.encode(text or "", add_special_tokens=False).ids, 1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
    assert set(by_doc) == set(wanted)
    for doc, copies in wanted.items():
        pieces = sorted(by_doc[doc], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == sum(map(len, copies))
        if len(copies) == 1:
            ids = np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist()
            assert ids == copies[0] and {r.doc_tokens for r in pieces} == {len(ids)}
            assert [r.start for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for number, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == packing.sequence or number == len(by_sequence) - 1 and at < packing.sequence


def test_windows_keep_the_mixture(spark):
    docs = spark.createDataFrame(
        [(k, "word " * 90, "a" if k % 4 else "b") for k in range(400)], "doc_id long, text string, source string"
    ).repartition(7)
    got = pack(docs, SMALL, {"a": 0.5, "b": 0.5}, with_ids=False).collect()
    total = sum(r.length for r in got if r.source == "b")
    shared = [r for r in got if r.sequence_id < 2 * total // SMALL.sequence - 2]
    for end in range(1, max(r.sequence_id for r in shared)):
        b = sum(r.length for r in shared if r.source == "b" and r.sequence_id < end)
        assert abs(b - end * SMALL.sequence / 2) <= 2 * SMALL.quantum


def test_positions_equal_round_robin_with_deficits():
    rng = random.Random(5)
    for _ in range(20):
        total = [rng.choice([0, 1, 15, 16, 17, 333, 1000]) for _ in range(6)]
        weight = [t / sum(total) if rng.random() < 0.7 else rng.random() for t in total]
        rounds = Rounds(total, weight, SMALL)
        left, handed, at, r, seen = list(total), [0] * 6, 0, 0, {}
        while any(left):
            r += 1
            for q in range(6):
                credit = int(rounds.credit[q]) * r + int(rounds.start[q]) >> 16
                while left[q] and handed[q] + min(SMALL.quantum, left[q]) <= credit:
                    seen[q, handed[q] // SMALL.quantum] = at
                    n = min(SMALL.quantum, left[q])
                    left[q], handed[q], at = left[q] - n, handed[q] + n, at + n
        queue, k = (np.array([x[i] for x in seen]) for i in (0, 1))
        assert rounds.position(queue, k).tolist() == list(seen.values())


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_a_target_on_the_smallest_of_many_sources_holds(spark):
    rows = [(k, "word " * (20 + k % 7), f"s{k % 2000:04d}") for k in range(4000)] + [(5000 + k, "tiny " * 30, "small") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    packing = Packing(sequence=256, quantum=16, window=256, queues=40, tails=8)
    got = pack(docs, packing, {"small": 0.25}, with_ids=False).collect()
    total = sum(r.length for r in got if r.source == "small")
    full = int(total / (0.25 * 256)) - 1
    assert full > 5
    for window in range(full):
        mine = sum(r.length for r in got if r.source == "small" and r.sequence_id == window)
        assert abs(mine - 64) <= 2 * packing.quantum
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in {r.doc_id: r for r in got}.values())


def test_every_window_holds_all_of_twenty_sources(spark):
    rows = [(k, "word and more of it " * 60, f"s{k % 20}") for k in range(1200)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), with_ids=False).collect()
    windows = max(r.sequence_id for r in got) - 2
    for window in range(windows):
        counts = {}
        for r in got:
            if r.sequence_id == window:
                counts[r.source] = counts.get(r.source, 0) + r.length
        assert len(counts) == 20 and max(counts.values()) <= 2048 / 20 + 2 * Packing().quantum
