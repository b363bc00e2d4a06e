"""Hard-negative mining with Four-Russians scoring.

For each anchor: its best rows of the same label are its positives, and for each positive the best rows
of other labels whose score lies between a share of the positive's score and that score. Scores are
integer inner products of components floor(scale * x).

Candidates are packed once into blocks. A component is held in two's complement, and each bit-plane of
eight neighbouring dimensions is one byte. For a block of anchors the sums over all 256 subsets of each
eight dimensions are tabulated by doubling; a plane's part of a score is then a sum of lookups, one for
each byte, and planes are put together by shift and add, the highest one negative. So a score takes
planes x dimensions / 8 lookups, no multiplication, and is exact.

Every anchor block meets every candidate slice through an equi-join on the slice: anchors, a hundredth
of the rows, are repeated for each slice, candidates are not repeated, and no key holds more
than a slice of them. A task keeps the best few of each anchor while blocks pass, so that a slice
reports a few rows for each anchor however many scores tie. Positives are found in a first pass, negatives in a
second one that knows the bounds.

Rows with a null label, id or vector or with null or non-finite components take no part. Only vectors of the
anchor's own length are scored. What scaling makes infinite counts as the largest double; scores beyond 64 bits are held at the
ends of a long. Repeated rows are candidates each on its own, a copy of the anchor too; ties go to the smaller id, and rows
that tie in both are equal. Positives with negative scores have no negatives, by the bounds. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.frames import column
from riskloom.plans.staging import stage

_LOW, _HIGH = -(2**63), 2**63 - 1  # the ends of a score


@dataclass(frozen=True)
class Mining:
    scale: float = 256.0
    every: int = 100
    positives: int = 5
    negatives: int = 5
    #: a negative's score is at least this many hundredths of the positive's, at most all of it
    least_percent: int = 80
    candidates_per_block: int = 1024
    blocks_per_slice: int = 64
    anchors_per_block: int = 128
    #: anchor blocks whose best rows a task keeps before it reports them
    kept_blocks: int = 512


def relabelled(label, vec_id):
    """The label that mining goes by: the next of ten where the id is divisible by 7."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


# --- packing --------------------------------------------------------------------
def _whole(x: np.ndarray) -> np.ndarray:
    """Whole-number doubles as integers, Python's where 64 bits are too few."""
    if not x.size or np.abs(x).max() < 2.0**62:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def to_planes(x: np.ndarray) -> np.ndarray:
    """Bytes [plane, group, row] of whole-number doubles [row, dimension], lowest plane first; the
    last plane is the sign's."""
    whole = _whole(x)
    size = max((int(v) if v >= 0 else ~int(v) for v in (whole.max(initial=0), whole.min(initial=0))))
    planes = size.bit_length() + 1
    out = np.zeros((planes, -(-x.shape[1] // 8), len(x)), np.uint8)
    for p in range(planes):
        bits = ((whole >> p) & 1).astype(np.uint8)
        out[p] = np.packbits(bits, axis=1, bitorder="little").T
    return out


def from_planes(planes: np.ndarray, dim: int) -> np.ndarray:
    """The doubles of ``to_planes``."""
    kind = np.int64 if len(planes) <= 63 else object
    whole = np.zeros((planes.shape[2], dim), kind)
    for p in range(len(planes) - 1, -1, -1):
        bits = np.unpackbits(planes[p].T, axis=1, count=dim, bitorder="little").astype(kind)
        whole = 2 * whole + (-bits if p == len(planes) - 1 else bits)
    return whole.astype(np.float64)


_BLOCK = pa.schema([
    ("slice", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()),
    ("labels", pa.binary()), ("planes", pa.binary()),
])
_BLOCK_KINDS = "slice long, dim int, n int, rows binary, ids binary, labels binary, planes binary"


def candidate_blocks(vectors: DataFrame, mining: Mining, id_column: str, vector: str, label: str) -> DataFrame:
    """Packed rows in order of id, numbered by slices of neighbouring blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, first = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            rows, ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            lists = batch.column(3)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = np.floor(mining.scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            flat = np.nan_to_num(flat)
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                own = own[np.argsort(ids[own], kind="stable")]
                for at in range(0, len(own), mining.candidates_per_block):
                    part = own[at : at + mining.candidates_per_block]
                    x = flat[starts[part][:, None] + np.arange(dim)[None, :]]
                    yield pa.RecordBatch.from_pydict({
                        "slice": [first + made // mining.blocks_per_slice], "dim": [int(dim)], "n": [len(part)],
                        "rows": [rows[part].astype("<i8").tobytes()], "ids": [ids[part].astype("<i8").tobytes()],
                        "labels": [labels[part].astype("<i8").tobytes()], "planes": [to_planes(x).tobytes()],
                    }, schema=_BLOCK)
                    made += 1

    x = column(vector)
    # NaN compares above and equal to itself in Spark, so one test covers it and infinities
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    usable = vectors.select(
        F.monotonically_increasing_id().alias("row"), column(id_column).cast("long").alias("id"),
        relabelled(column(label).cast("long"), column(id_column).cast("long")).alias("label"), x.alias("x"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", odd))
    return usable.mapInArrow(run, _BLOCK_KINDS)


class _Candidates:
    def __init__(self, b: dict):
        self.rows, self.ids, self.labels = (np.frombuffer(b[c], "<i8") for c in ("rows", "ids", "labels"))
        groups = -(-b["dim"] // 8)
        planes = np.frombuffer(b["planes"], np.uint8)
        count = len(planes) // (groups * b["n"]) if groups else 1
        self.planes = planes.reshape(count, groups, b["n"])


_ANCHORS = pa.schema([
    ("dim", pa.int32()), ("n", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()),
    ("vectors", pa.binary()),
])
_ANCHOR_KINDS = "dim int, n int, rows binary, ids binary, labels binary, vectors binary"


def _anchor_record(dim: int, parts: list[np.ndarray]) -> pa.RecordBatch:
    rows, ids, labels, vectors = parts
    return pa.RecordBatch.from_pydict({
        "dim": [dim], "n": [len(rows)], "rows": [rows.tobytes()], "ids": [ids.tobytes()],
        "labels": [labels.tobytes()], "vectors": [vectors.astype("<f8").tobytes()],
    }, schema=_ANCHORS)


def anchor_blocks(packed: DataFrame, mining: Mining) -> DataFrame:
    """The rows whose id is divisible by ``mining.every``, dealt evenly and packed; ``block`` numbers
    the blocks."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                of = _Candidates(b)
                for at in np.flatnonzero(of.ids % mining.every == 0):
                    x = from_planes(of.planes[:, :, at : at + 1], b["dim"])
                    yield _anchor_record(b["dim"], [a[at : at + 1] for a in (of.rows, of.ids, of.labels)] + [x])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_dim: dict[int, list] = {}
            for b in batch.to_pylist():
                parts = [np.frombuffer(b[c], "<i8") for c in ("rows", "ids", "labels")]
                by_dim.setdefault(b["dim"], []).append(parts + [np.frombuffer(b["vectors"], "<f8").reshape(1, -1)])
            for dim, found in by_dim.items():
                whole = [np.concatenate(p) for p in zip(*found)]
                for at in range(0, len(whole[0]), mining.anchors_per_block):
                    yield _anchor_record(dim, [p[at : at + mining.anchors_per_block] for p in whole])

    single = stage(packed.mapInArrow(pick, _ANCHOR_KINDS))
    dealt = single.repartition(max(1, -(-single.count() // mining.anchors_per_block)), F.xxhash64("rows"))
    return stage(dealt.mapInArrow(gather, _ANCHOR_KINDS).withColumn("block", F.monotonically_increasing_id()))


# --- scoring ----------------------------------------------------------------------
def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables [group, subset, anchor]: sums over each subset of eight neighbouring dimensions."""
    k, dim = anchors.shape
    groups = -(-dim // 8)
    padded = np.zeros((k, groups * 8), anchors.dtype)
    padded[:, :dim] = anchors
    tables = np.zeros((groups, 256, k), anchors.dtype)
    for g in range(groups):
        for j in range(8):
            half = 1 << j
            tables[g, half : 2 * half] = tables[g, :half] + padded[:, 8 * g + j]
    return tables


def scores(anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products [candidate, anchor] from table lookups, held at the ends of a long."""
    size = max(float(np.abs(anchors).max(initial=0)), 1.0) * max(1, anchors.shape[1])
    bound = int(size) << len(planes)
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object
    tables = subset_sums(_whole(anchors).astype(kind))
    total = np.zeros((planes.shape[2], len(anchors)), kind)
    looked = np.empty_like(total)
    for p in range(len(planes) - 1, -1, -1):
        total *= 2
        for g in range(len(tables)):
            np.take(tables[g], planes[p, g], axis=0, out=looked, mode="clip")
            if p == len(planes) - 1:
                total -= looked
            else:
                total += looked
    if kind is object:
        return np.array([min(max(v, _LOW), _HIGH) for v in total.ravel()], np.int64).reshape(total.shape)
    return total.astype(np.int64)


def best_places(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, candidate) places of each anchor's k highest scores among those allowed; ties go to
    the earlier candidate."""
    n = len(score)
    if not n or not score.shape[1]:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if max(-int(score.min()), int(score.max())) < 2**62 // n:
        # one number for score and place; numbers differ, so the k-th is exact
        joint = np.where(allowed, score * n + (n - 1 - np.arange(n))[:, None], _LOW).T
        top = joint if n <= k else np.partition(joint, n - k, axis=1)[:, n - k :]
        anchor, at = np.nonzero(top != _LOW)
        return anchor, n - 1 - top[anchor, at] % n
    anchors, places = [], []
    for a in range(score.shape[1]):
        at = np.flatnonzero(allowed[:, a])
        order = at[np.lexsort((at, ~score[at, a]))][:k]  # ~s falls as s rises, without overflow
        anchors.append(np.full(len(order), a))
        places.append(order)
    return np.concatenate(anchors), np.concatenate(places)


_FOUND = pa.schema([(c, pa.int64()) for c in ("block", "anchor", "rival", "anchor_id", "vec_id", "score")])
_FOUND_KINDS = ", ".join(f"{f.name} long" for f in _FOUND)


class _Kept:
    """The best rows of each (anchor, rival) of one anchor block while candidates pass."""

    def __init__(self, k: int):
        self.k, self.parts = k, []

    def add(self, anchor, rival, vec_id, score) -> None:
        self.parts.append(np.stack([anchor, rival, vec_id, score]))
        if sum(p.shape[1] for p in self.parts) > 1 << 16:
            self.parts = [self.best()]

    def best(self) -> np.ndarray:
        anchor, rival, vec_id, score = whole = np.concatenate(self.parts, axis=1)
        whole = whole[:, np.lexsort((vec_id, ~score, rival, anchor))]
        starts = np.flatnonzero(np.any(np.diff(whole[:2], axis=1, prepend=-1), axis=0))
        place = np.arange(whole.shape[1]) - np.repeat(starts, np.diff(np.append(starts, whole.shape[1])))
        return whole[:, place < self.k]


def _pass(mining: Mining, k: int, search: Callable):
    """``search(b, candidates, score)`` yields (rival, anchors, candidates' places) to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}

        def report(block: int) -> pa.RecordBatch:
            state, ids = kept.pop(block)
            anchor, rival, vec_id, score = state.best()
            return pa.RecordBatch.from_pydict({
                "block": np.full(len(anchor), block), "anchor": anchor, "rival": rival, "anchor_id": ids[anchor],
                "vec_id": vec_id, "score": score,
            }, schema=_FOUND)

        for batch in batches:
            for at in range(batch.num_rows):
                b = batch.slice(at, 1).to_pylist()[0]
                of = _Candidates(b)
                b |= {c: np.frombuffer(b[c], "<i8") for c in ("a_rows", "a_ids", "a_labels")}
                anchors = np.frombuffer(b["a_vectors"], "<f8").reshape(b["a_n"], b["dim"])
                score = scores(anchors, of.planes)
                if b["block"] not in kept:
                    if len(kept) >= mining.kept_blocks:
                        yield report(next(iter(kept)))
                    kept[b["block"]] = (_Kept(k), b["a_ids"])
                for rival, anchor, place in search(b, of, score):
                    kept[b["block"]][0].add(anchor, np.full(len(anchor), rival), of.ids[place], score[place, anchor])
        for block in list(kept):
            yield report(block)

    return run


def _met(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each candidate block beside each anchor block of its length, joined on the slice."""
    slices = candidates.groupBy("dim").agg(F.collect_set("slice").alias("slices"))
    repeated = anchors.withColumnsRenamed(
        {c: f"a_{c}" for c in ("n", "rows", "ids", "labels", "vectors")}
    ).join(F.broadcast(slices), "dim").withColumn("slice", F.explode("slices")).drop("slices")
    return candidates.join(repeated, ["slice", "dim"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("block", "anchor", "rival").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, mining: Mining = Mining(), id_column: str = "vec_id", vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    packed = stage(candidate_blocks(vectors, mining, id_column, vector, label))
    anchors = anchor_blocks(packed, mining)

    def same_label(b, of, score):
        allowed = (of.labels[:, None] == b["a_labels"]) & (of.rows[:, None] != b["a_rows"])
        yield 0, *best_places(score, allowed, mining.positives)

    first = _met(packed, anchors).mapInArrow(_pass(mining, mining.positives, same_label), _FOUND_KINDS)
    positives = stage(_ranked(first, mining.positives))

    def in_bounds(b, of, score):
        other = of.labels[:, None] != b["a_labels"]
        for rank in range(1, mining.positives + 1):
            least, most = np.full(b["a_n"], _HIGH), np.full(b["a_n"], _LOW)
            for w in b["wanted"]:
                if w["rank"] == rank:
                    most[w["anchor"]] = w["score"]
                    least[w["anchor"]] = -(-w["score"] * mining.least_percent // 100)
            yield rank, *best_places(score, other & (score >= least) & (score <= most), mining.negatives)

    # at most positives x anchors_per_block in a list
    wanted = positives.groupBy("block").agg(F.collect_list(F.struct("anchor", "rank", "score")).alias("wanted"))
    second = _met(packed, anchors.join(wanted, "block"))
    negatives = _ranked(second.mapInArrow(_pass(mining, mining.negatives, in_bounds), _FOUND_KINDS), mining.negatives)
    of = positives.select(
        "block", "anchor", F.col("rank").cast("long").alias("rival"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return negatives.join(of, ["block", "anchor", "rival"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
