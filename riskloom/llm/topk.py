"""Exact top-k search by inner product with distributed histogram selection.

Vectors are packed into blocks of a few thousand rows, some neighbouring blocks being a slice. Every
block of queries meets every block of candidates through an equi-join on the slice: queries, a hundredth
of the rows, are repeated for each slice, candidates are not repeated, and no key holds more than
a slice of them. Each pair of blocks is scored by one matrix product. The first passes score everything and count the scores of each query
in a histogram over the whole possible range; the bin that holds the k-th best score becomes the
next range, until bins are one wide and the k-th score is known exactly. The last pass keeps the
scores above it, and of those equal to it the smallest ids. A block reports a histogram only from
its top down to its own k-th score and at most k ties, which loses nothing: what lies
below cannot be among the best k. So each query moves a few numbers per block, however many
scores tie, and a vector that a third of the rows repeat costs no more than any other.

Scores are integers: component x counts as floor(scale * x) in double precision. Products are
exact as long as they stay below 2^53 in size; beyond that they are taken in whole numbers and
scores are held at the ends of a 64-bit integer. Only vectors of a query's own length are its
candidates. Vectors or ids that are null, and vectors with null or non-finite components, take no
part. Repeated rows are candidates each on its own, and a repeated query row is a query of its own
to which its copy is a candidate; ties between equal ids are equal rows. An empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from riskloom.llm.frames import column
from riskloom.plans.staging import broadcast_side, stage

_EXACT = 2.0**53
_LOW, _HIGH = -(2**63), 2**63 - 1  # the ends of a score


@dataclass(frozen=True)
class Search:
    k: int = 10
    scale: float = 1024.0
    every: int = 100
    candidates_per_block: int = 4096
    blocks_per_slice: int = 16
    queries_per_block: int = 1024
    bins: int = 4096


_BLOCK = pa.schema([
    ("dim", pa.int32()), ("n", pa.int32()), ("most", pa.float64()),
    ("rows", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary()),
])
_BLOCK_KINDS = "dim int, n int, most double, rows binary, ids binary, vectors binary"
_SLICED = _BLOCK.insert(0, pa.field("slice", pa.int64()))


def _packed(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(ids), size):
        v = np.ascontiguousarray(vectors[at : at + size])
        yield pa.RecordBatch.from_pydict({
            "dim": [v.shape[1]], "n": [len(v)], "most": [float(np.abs(v).max()) if v.size else 0.0],
            "rows": [rows[at : at + size].astype("<i8").tobytes()],
            "ids": [ids[at : at + size].astype("<i8").tobytes()], "vectors": [v.astype("<f8").tobytes()],
        }, schema=_BLOCK)


def blocks(vectors: DataFrame, search: Search, id_column: str, vector: str) -> DataFrame:
    """Packed rows: row numbers, ids and scaled components, numbered by slices of neighbouring blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, first = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            lists, ids = batch.column(2), batch.column(1).to_numpy(zero_copy_only=False)
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = np.floor(search.scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            flat = np.nan_to_num(flat)  # what scaling made infinite is held at the largest double
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths):
                own = lengths == dim
                of = flat[(starts[own][:, None] + np.arange(dim)[None, :])]
                for block in _packed(rows[own], ids[own], of, search.candidates_per_block):
                    number = pa.array([first + made // search.blocks_per_slice], pa.int64())
                    yield pa.RecordBatch.from_arrays([number, *block.columns], schema=_SLICED)
                    made += 1

    x = column(vector)
    # NaN compares above and equal to itself in Spark, so one test covers it and infinities
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    usable = vectors.select(
        F.monotonically_increasing_id().alias("row"), column(id_column).cast("long").alias("id"), x.alias("x")
    ).filter(F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", odd))
    return usable.mapInArrow(run, f"slice long, {_BLOCK_KINDS}")


def _unpacked(b: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, ids = (np.frombuffer(b[c], "<i8") for c in ("rows", "ids"))
    return rows, ids, np.frombuffer(b["vectors"], "<f8").reshape(b["n"], b["dim"])


def query_blocks(packed: DataFrame, search: Search) -> DataFrame:
    """The blocks' rows whose id is a multiple of ``search.every``, dealt evenly over partitions and
    packed again; ``block`` numbers them."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                rows, ids, vectors = _unpacked(b)
                own = ids % search.every == 0
                yield from _packed(rows[own], ids[own], vectors[own], 1)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_dim: dict[int, list] = {}
            for b in batch.to_pylist():
                by_dim.setdefault(b["dim"], []).append(_unpacked(b))
            for parts in by_dim.values():
                yield from _packed(*(np.concatenate(x) for x in zip(*parts)), search.queries_per_block)

    single = stage(packed.mapInArrow(pick, _BLOCK_KINDS))
    dealt = single.repartition(max(1, -(-single.count() // search.queries_per_block)), F.xxhash64("rows"))
    return stage(dealt.mapInArrow(gather, _BLOCK_KINDS).withColumn("block", F.monotonically_increasing_id()))


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers."""
    size = lambda a: float(np.abs(a).max()) if a.size else 0.0
    if queries.shape[1] * size(queries) * size(candidates) < _EXACT:
        return (queries @ candidates.T).astype(np.int64)
    whole = lambda a: np.array([[int(x) for x in row] for row in a], object).reshape(a.shape)
    exact = whole(queries) @ whole(candidates).T
    return np.array([[min(max(int(s), _LOW), _HIGH) for s in row] for row in exact], np.int64).reshape(exact.shape)


def _met(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Each candidate block beside each query block of its slice."""
    own = candidates.select("slice", "dim", *(F.col(c).alias(f"c_{c}") for c in ("n", "rows", "ids", "vectors")))
    return own.join(queries, ["slice", "dim"])


def _repeated(queries: DataFrame, slices: DataFrame) -> DataFrame:
    """Query blocks, each once for every slice with vectors of its length."""
    return queries.join(slices, "dim")


def _both(b: dict):
    c = {"dim": b["dim"], **{k[2:]: v for k, v in b.items() if k.startswith("c_")}}
    q_rows, q_ids, q = _unpacked(b)
    c_rows, c_ids, of = _unpacked(c)
    own = q_rows[:, None] == c_rows[None, :]
    return q_rows, q_ids, c_ids, _scores(q, of), own


_COUNTS = pa.schema([("block", pa.int64()), ("query", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])


def _histogram(search: Search):
    """Counts per query and bin of the scores in [low, low + bins * width), the top bin also taking
    all above. Bins go from the top; counting ends with the bin of the block's own k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                b = batch.slice(at, 1).to_pylist()[0]
                _, _, _, scores, own = _both(b)
                low = np.frombuffer(b["low"], "<i8")
                # Python's integers: the range of a query may be wider than 64 bits
                if all(-(2**61) < a.min(initial=0) and a.max(initial=0) < 2**61 for a in (low, scores)):
                    bins = (scores - low[:, None]) // b["width"]
                else:
                    shift = scores.astype(object) - low.astype(object)[:, None]
                    bins = np.clip(shift // b["width"], -1, search.bins).astype(np.int64)
                bins = np.clip(bins, -1, search.bins - 1)
                bins[own] = -1
                place = (bins + 1 + np.arange(len(low))[:, None] * (search.bins + 1)).ravel()
                counts = np.bincount(place, minlength=len(low) * (search.bins + 1)).reshape(len(low), -1)[:, 1:]
                above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
                query, bin_ = np.nonzero((counts > 0) & (above < search.k))
                yield pa.RecordBatch.from_pydict({
                    "block": np.full(len(query), b["block"]), "query": query.astype(np.int32),
                    "bin": bin_.astype(np.int32), "n": counts[query, bin_].astype(np.int64),
                }, schema=_COUNTS)

    return run


def _narrowed(queries: DataFrame, counts: DataFrame, search: Search) -> DataFrame:
    """``queries`` with each query's range replaced by the bin that holds its k-th best score. Bins
    keep the top one open, so scores above stay counted; with fewer than k scores in all, the
    range's start stays, and so does every score."""
    summed = counts.groupBy("block", "query", "bin").agg(F.sum("n").alias("n"))
    from_top = Window.partitionBy("block", "query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    reached = summed.withColumn("seen", F.sum("n").over(from_top)).filter(F.col("seen") >= search.k)
    found = reached.groupBy("block", "query").agg(F.max("bin").alias("bin"))
    listed = found.groupBy("block").agg(F.collect_list(F.struct("query", "bin")).alias("found"))

    def step(low, width, found):
        moved = np.frombuffer(low, "<i8").copy()
        for f in found if found is not None else ():
            moved[f["query"]] = int(moved[f["query"]]) + f["bin"] * width
        return moved.astype("<i8").tobytes()

    moved = F.udf(step, BinaryType())("low", "width", "found")
    return queries.join(listed, "block", "left").withColumn("low", moved).drop("found")


_BEST = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _best(search: Search):
    """Scores above each query's k-th one, and the k smallest ids of those equal to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                b = batch.slice(at, 1).to_pylist()[0]
                q_rows, q_ids, c_ids, scores, own = _both(b)
                kth = np.frombuffer(b["low"], "<i8")
                order = np.argsort(c_ids, kind="stable")
                scores, own = scores[:, order], own[:, order]
                equal = (scores == kth[:, None]) & ~own
                taken = ((scores > kth[:, None]) & ~own) | (equal & (np.cumsum(equal, axis=1) <= search.k))
                query, of = np.nonzero(taken)
                yield pa.RecordBatch.from_pydict({
                    "row": q_rows[query], "query_id": q_ids[query], "vec_id": c_ids[order][of],
                    "score": scores[query, of],
                }, schema=_BEST)

    return run


def top_k(
    vectors: DataFrame, search: Search = Search(), id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query."""
    packed = stage(blocks(vectors, search, id_column, vector))
    most = packed.agg(F.max("most")).first()[0] or 0.0
    queries = query_blocks(packed, search)
    widest = queries.agg(F.max(F.col("dim") * F.col("most"))).first()[0] or 0.0
    least, span = _LOW, 2**64
    if widest * most < 2.0**61:
        least, span = -int(widest * most) - 1, 2 * int(widest * most) + 3
    # two numbers for some 65,536 vectors; broadcast only if that is small
    slices = broadcast_side(packed.select("dim", "slice").distinct())
    low = F.udf(lambda n: np.full(n, least, "<i8").tobytes(), BinaryType())("n")
    queries = queries.withColumn("low", low)
    while span > 1:
        width = -(-span // search.bins)
        ranged = queries.withColumn("width", F.lit(width).cast("long"))
        counts = _met(packed, _repeated(ranged, slices)).mapInArrow(_histogram(search), "block long, query int, bin int, n long")
        queries, span = stage(_narrowed(ranged, counts, search).drop("width")), width
    kept = _met(packed, _repeated(queries, slices)).mapInArrow(_best(search), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= search.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
