"""Near-duplicates by SimHash, found with an inverted index over positional bytes.

A fingerprint has eight bytes. Two fingerprints that differ in at most three bits differ in at
most three bytes, so at least five bytes agree in value and position: the guaranteed minimum of
matches. Posting lists of single bytes would hold every 256th fingerprint and pairs tallied from
them grow with the square of the table, so the index posts each fingerprint under each of its
56 choices of five positional bytes: a pair stands together in a list exactly if its tally of
shared bytes reaches the minimum. Members of a list can differ only in the other three bytes, so
a list never has more than 2^24 distinct members, whatever the data; each list is read in sorted
order by one task, which verifies the bits and passes on a spanning forest of the links instead of
all pairs. Copies collapse to one fingerprint before the index. Components come from alternating
star contractions, each checkpointed.

Empty and null texts have fingerprint zero, which links like any other. Rows without an id get
the component of their fingerprint. Repeated rows are copies. An empty table gives no rows.
Only the columns named are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.frames import column, per_batch, rows_of, spare_name, texts_of
from riskloom.plans.staging import stage

WORDS = 3
SEED = 42
BITS = 3
#: shingles hashed at a time, which bounds the memory of a long text
BLOCK = 1 << 16

#: eight positional bytes, the five indexed ones first; a little-endian word's first byte is its lowest
_ORDERS = np.array(
    [[b for b in range(8) if b not in c] + list(c) for c in combinations(range(8), 8 - BITS)]
)
_BACK = np.argsort(_ORDERS, axis=1)
_REST = 8 * BITS
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_BYTE_PLACE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str) -> int:
    """The 64 bits of a text as a signed integer."""
    words = text.encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    digest = xxhash.xxh64_digest
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width))))
        seen = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
        by_value = np.bincount((seen + _BYTE_PLACE).ravel(), minlength=2048).reshape(8, 256)
        ones += by_value @ _BIT_OF_BYTE
    return int(np.packbits(2 * ones.ravel() > n).view(">i8")[0])


def fingerprints(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", row: str | None = None
) -> DataFrame:
    """doc_id, row_id (the column ``row``, else a number of the row in this scan) and fp of every
    row, staged."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_id", pa.int64()), ("fp", pa.int64())])

    def make():
        def columns(batch):
            return {
                "doc_id": rows_of(batch, "doc_id"), "row_id": rows_of(batch, "row_id"),
                "fp": [fingerprint(t) for t in texts_of(batch, "text")],
            }
        return columns

    number = column(row) if row else F.monotonically_increasing_id()
    rows = docs.select(
        column(id_column).cast("long").alias("doc_id"), number.alias("row_id"), column(text).alias("text"),
    )
    return stage(rows.mapInArrow(per_batch(make, schema), "doc_id long, row_id long, fp long"))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype("<u8")
        for at in range(0, len(fps), 4096):
            by_byte = fps[at : at + 4096].view(np.uint8).reshape(-1, 8)
            turned = np.ascontiguousarray(by_byte[:, _ORDERS]).view("<i8").reshape(-1)
            lists = np.tile(np.arange(len(_ORDERS), dtype=np.int8), len(by_byte))
            yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(turned)], ["list", "turned"])


def _turned_back(lists: np.ndarray, turned: np.ndarray) -> np.ndarray:
    by_byte = np.ascontiguousarray(turned, "<i8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(np.take_along_axis(by_byte, _BACK[lists], 1)).view("<i8").reshape(-1)


def _near_masks() -> np.ndarray:
    bits = [np.uint32(1 << k) for k in range(_REST)]
    return np.array([sum(c) for r in range(1, BITS + 1) for c in combinations(bits, r)], np.uint32)


_MASKS = _near_masks()


def _forest(low: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Groups of the sorted ``low`` linked at BITS or fewer bits: (first, the others' places).

    Short lists are compared directly. Long ones look up the 2,324 words near each member, so
    that the work is in proportion to the list however dense it is."""
    unseen = np.ones(len(low), bool)
    for root in range(len(low)):
        if not unseen[root]:
            continue
        unseen[root] = False
        front, found = np.array([root]), []
        while len(front):
            step, front = front[:256], front[256:]
            if len(low) <= 2048:
                rest = np.flatnonzero(unseen)
                near = np.bitwise_count(low[rest][None, :] ^ low[step][:, None]) <= BITS
                new = rest[near.any(axis=0)]
            else:
                wanted = (low[step][:, None] ^ _MASKS[None, :]).ravel()
                at = np.minimum(np.searchsorted(low, wanted), len(low) - 1)
                new = np.unique(at[(low[at] == wanted) & unseen[at]])
            unseen[new] = False
            found.append(new)
            front = np.concatenate([front, new])
        others = np.concatenate(found)
        if len(others):
            yield root, others


def _first_list(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of the first list in which each pair stands together."""
    same = (np.ascontiguousarray(a ^ b, "<i8").view(np.uint8).reshape(-1, 8) == 0)
    together = same[:, _ORDERS[:, BITS:]].all(axis=2)
    return together.argmax(axis=1)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of the lists in ``batches``, which are sorted by list and turned bytes."""
    lists, turned = np.empty(0, np.int8), np.empty(0, np.int64)

    def of(lists: np.ndarray, turned: np.ndarray):
        ends = np.flatnonzero((np.diff(lists) != 0) | (np.diff(turned >> _REST) != 0)) + 1
        starts, ends = np.concatenate([[0], ends]), np.concatenate([ends, [len(lists)]])
        size = ends - starts
        first = starts[size == 2]
        near = np.bitwise_count(turned[first] ^ turned[first + 1]) <= BITS
        first = first[near]
        a, b = (_turned_back(lists[first], turned[k]) for k in (first, first + 1))
        own = _first_list(a, b) == lists[first]
        left, right = [a[own]], [b[own]]
        for s, e in zip(starts[size > 2], ends[size > 2]):
            low = (turned[s:e] & ((1 << _REST) - 1)).astype(np.uint32)
            whole = _turned_back(lists[s:e], turned[s:e])
            for root, others in _forest(low):
                left.append(np.full(len(others), whole[root]))
                right.append(whole[others])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"]
        )

    for batch in batches:
        lists = np.concatenate([lists, batch.column(0).to_numpy(zero_copy_only=False)])
        turned = np.concatenate([turned, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(lists):
            continue
        open_ = (lists == lists[-1]) & (turned >> _REST == turned[-1] >> _REST)
        cut = int(np.argmax(open_))  # the last list may go on in the next batch
        if cut:
            yield of(lists[:cut], turned[:cut])
            lists, turned = lists[cut:], turned[cut:]
    if len(lists):
        yield of(lists, turned)


def links(fps: DataFrame) -> DataFrame:
    """Links u > v that connect all fingerprints of ``fps`` (a distinct column fp) at BITS or
    fewer differing bits: a spanning forest of each list, not every pair."""
    posted = fps.select("fp").mapInArrow(_postings, "list byte, turned long")
    dealt = posted.repartition("list", F.shiftright("turned", _REST)).sortWithinPartitions("list", "turned")
    return dealt.mapInArrow(_links, "u long, v long").distinct()


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction of edges u > v. Larger: each node ties its greater neighbours to the
    smallest node it knows. Otherwise: each node ties its smaller neighbours and itself to it."""
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return tied.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of all nodes that ``edges`` u > v touch.

    Contractions repeat until nothing moves; each is checkpointed, so lost executors cost
    one step at most and plans stay short."""
    edges, seen = stage(edges), None
    while True:
        now = edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))
        ).first()
        if now == seen or not now[0]:
            break
        seen = now
        edges = stage(_stars(_stars(edges, True), False))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def groups(prints: DataFrame) -> DataFrame:
    """fp, first_id and first (the smallest doc_id and the smallest (doc_id, row_id) in the
    component) for each distinct fingerprint of ``fingerprints``."""
    fps = stage(prints.groupBy("fp").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "row_id")).alias("row")
    ))
    tied = components(links(fps))
    rooted = fps.join(tied, fps.fp == tied.node, "left").select(
        "fp", "doc_id", "row", F.coalesce("root", "fp").alias("root")
    )
    firsts = rooted.groupBy("root").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("first"))
    return rooted.select("fp", "root").join(firsts, "root").select("fp", "first_id", "first")


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    prints = fingerprints(docs, text, id_column)
    return prints.join(groups(prints), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first_id").alias("component_id"),
    )


def one_of_each(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without all but the first of each component, all columns.

    Rows are told apart by a number that is staged with them: a second scan may be split
    otherwise and would number them anew."""
    row = spare_name(docs, "row_id")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    prints = fingerprints(numbered, text, id_column, row)
    others = prints.join(groups(prints), "fp").filter(
        ~F.struct("doc_id", "row_id").eqNullSafe(F.col("first"))
    ).select(F.col("row_id").alias(row))
    return numbered.join(others, row, "left_anti").drop(row)
