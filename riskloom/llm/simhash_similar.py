"""Near-duplicates at a similarity of five-word shingles, found with SimHash over positional bytes.

Three bits of 64, the limit of ``simhash``, reach copies of some 0.97 similarity. Here a fingerprint has
256 bits, taken over a text's distinct shingles, so 32 positional bytes; texts of similarity 0.8 differ in some 39
bits and share some nine bytes. The index posts each fingerprint under ``LISTS`` fixed choices of three positional
bytes: a pair stands together in a list if its tally of shared bytes reaches three, on one of the choices. In a list, up to
``SMALL`` texts are compared pair by pair; of more, each is paired with the list's smallest node. Of all its pairs with
smaller nodes a text keeps the ``NEAREST`` by their first 64 bits. They are retained if sizes and bits allow the
similarity (``MOST_BITS``), and verified on the whole sets of shingles. So this index ties nearly all near copies, a group
of any size by so many pairs a text, but it may miss links.

What it misses is found exactly, by common prefixes. All shingles have one order, in which those found often in a sample
come last (``common``; the sample decides on the cost alone, any order gives the same links). Two sets of
similarity 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of each, so every link stands together in the list of such a
shingle. Of a list, all pairs are verified that sizes, places in the two sets and parities of their shingles allow and that
are not yet tied by verified links. Most are ruled out inside the list, by ``LIST_PARTS`` words of parities that travel with
the row, before they become rows. So nothing below the limit is linked, and every component is whole.

Texts of equal shingle sets collapse before both. A byte list takes one in 2^24 of unlike texts; tables of far more than
10^8 distinct texts want a fourth byte (``BYTES``) and more lists. Pairs in one prefix list that are not tied are compared
one by one inside the list: that is few, unless very many texts are alike at about the limit. Those near it also become rows.

Words are those of ``simhash``. Texts of fewer than five words are one shingle; empty and null texts have none and are
copies of each other. Repeated rows are copies; of equal ones the smallest doc_id stays, null ids first. An
empty table gives no rows. Other columns are carried along and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from riskloom.llm.frames import column, per_batch, rows_of, spare_name, texts_of
from riskloom.llm.simhash import components
from riskloom.plans.staging import fresh_path, stage

WORDS, SEED = 5, 42
#: least similarity as a fraction
NUMERATOR, DENOMINATOR = 4, 5
PARTS, EVEN_PARTS, LIST_PARTS = 4, 16, 4
BYTES, LISTS = 3, 128
MOST_BITS = 60
#: bits of the first 64 that may differ inside a list
MOST_SHORT_BITS = 20
SMALL, WINDOW = 8, 512
#: pairs of a text that the byte index keeps; what ties they leave out, the prefix lists find
NEAREST = 16
#: one text in so many is sampled for common shingles, of which so many are known at most
SAMPLED, COMMON = 32, 1 << 18
#: bits of the map that tells most rows that a join need not see
MAP_BITS, CHUNK_BITS = 25, 16
#: bits of a prefix posting
KEY_BITS, PLACE_BITS = 44, 16

_PLACES = np.array([np.sort(np.random.default_rng(k).choice(8 * PARTS, BYTES, replace=False)) for k in range(LISTS)])
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_PLACE = (np.arange(8) * 256).astype(np.int64)


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = text.encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    width = min(WORDS, len(words))
    digest = xxhash.xxh64_digest
    joined = b"".join([digest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(width))))])
    return np.unique(np.frombuffer(joined, ">u8").astype(np.uint64))


def _same(hashes: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(hashes.tobytes(), SEED), "big", signed=True)


def _mixed(x: np.ndarray, part: int) -> np.ndarray:
    """64 fresh bits of each hash for each part, by shifts and odd factors."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (part + 1) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray) -> list[int]:
    """256 bits as four signed integers; a bit on which the shingles are even is the smallest one's."""
    out = []
    for part in range(PARTS):
        if not len(hashes):
            out.append(0)
            continue
        by_byte = _mixed(hashes, part).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts = np.bincount((by_byte + _BYTE_PLACE).ravel(), minlength=2048).reshape(8, 256)
        ones = 2 * (counts @ _BIT_OF_BYTE).ravel()
        least = np.unpackbits(by_byte[0], bitorder="little").astype(bool)
        bits = (ones > len(hashes)) | ((ones == len(hashes)) & least)
        out.append(int(np.packbits(bits, bitorder="little").view("<i8")[0]))
    return out


def parities(hashes: np.ndarray) -> list[int]:
    """Whether each of 64 * ``EVEN_PARTS`` classes of hashes has an odd number of the set's, as signed integers. Sets
    that differ in d shingles differ in d classes at most."""
    odd = np.bincount((hashes % np.uint64(64 * EVEN_PARTS)).astype(np.int64), minlength=64 * EVEN_PARTS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").tolist()


_FPS = [f"f{k}" for k in range(PARTS)]
_ODD = [f"odd{k}" for k in range(EVEN_PARTS)]
_PRINT = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("same", pa.int64()), ("n", pa.int64())]
                   + [(f, pa.int64()) for f in _FPS + _ODD])


def prints(rows: DataFrame) -> DataFrame:
    """doc_id, node, same (a hash of the whole set of shingles), n (its size), fingerprint and parities of rows
    (doc_id, node, text), staged."""

    def make():
        def columns(batch):
            out: dict[str, list] = {name: [] for name in _PRINT.names}
            out["doc_id"], out["node"] = rows_of(batch, "doc_id"), rows_of(batch, "node")
            for text in texts_of(batch, "text"):
                hashes = shingles(text)
                out["n"].append(len(hashes))
                out["same"].append(_same(hashes))
                for name, x in zip(_FPS + _ODD, fingerprint(hashes) + parities(hashes)):
                    out[name].append(x)
            return out
        return columns

    kinds = ", ".join(f"{name} long" for name in _PRINT.names)
    return stage(rows.mapInArrow(per_batch(make, _PRINT), kinds))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = (1 << (8 * np.arange(BYTES))).astype(np.int64)
    for batch in batches:
        nodes = batch.column(0).to_numpy(zero_copy_only=False)
        fps = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(PARTS)], axis=1)
        for at in range(0, len(nodes), 2048):
            part = np.ascontiguousarray(fps[at : at + 2048], "<i8")
            keys = part.view(np.uint8).reshape(len(part), -1)[:, _PLACES].astype(np.int64) @ weights
            keys += np.arange(LISTS) << (8 * BYTES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(part[:, 0], LISTS)),
                 pa.array(np.repeat(nodes[at : at + 2048], LISTS))], ["key", "short", "node"])


def _paired(keys: np.ndarray, short: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    """Candidate pairs u > v of whole lists, sorted by key, and in how many of the first 64 bits they differ."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    size = np.diff(np.append(starts, len(keys)))
    small = np.repeat(size <= SMALL, size)
    left, right, apart = [], [], []

    def near(a: np.ndarray, b: np.ndarray) -> None:
        bits = np.bitwise_count((short[a] ^ short[b]).view(np.uint64))
        own = (bits <= MOST_SHORT_BITS) & (nodes[a] != nodes[b])
        left.append(nodes[a[own]])
        right.append(nodes[b[own]])
        apart.append(bits[own].astype(np.int64))

    for step in range(1, SMALL):
        first = np.flatnonzero(small[:-step] & (keys[:-step] == keys[step:]))
        near(first, first + step)
    for s, m in zip(starts[size > SMALL], size[size > SMALL]):
        of = np.arange(s, s + m)
        near(of, np.full(m, s + nodes[of].argmin()))
    a, b = np.concatenate(left), np.concatenate(right)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(np.concatenate(apart))], ["u", "v", "bits"])


def _by_list(of_lists, width: int):
    """A function for ``mapInArrow`` that hands whole lists, sorted by their key in the first of ``width``
    columns of longs, to ``of_lists``; the last list of a batch may go on in the next one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * width
        for batch in batches:
            held = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
            if len(held[0]):
                cut = int(np.searchsorted(held[0], held[0][-1]))
                if cut:
                    yield from of_lists(*(h[:cut] for h in held))
                    held = [h[cut:] for h in held]
        if len(held[0]):
            yield from of_lists(*held)
    return run


def _pairs(keys: np.ndarray, short: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield _paired(keys, short, nodes)


def candidates(texts: DataFrame) -> DataFrame:
    """Distinct pairs u > v of ``texts`` (node, n, fingerprint) that the byte index retains: of the ``NEAREST`` v of each
    u, those of which sizes and bits allow the similarity. Links that these leave out are found by ``prefix_lists`` and
    ``untied``."""
    posted = texts.select("node", *_FPS).mapInArrow(_postings, "key long, short long, node long")
    dealt = posted.repartition("key").sortWithinPartitions("key", "short")
    pairs = dealt.mapInArrow(_by_list(_pairs, 3), "u long, v long, bits long").repartition("u").distinct()
    rank = F.row_number().over(Window.partitionBy("u").orderBy("bits", "v"))
    nearest = pairs.withColumn("rank", rank).filter(F.col("rank") <= NEAREST).select("u", "v")
    return _beside(nearest, texts, _FPS + _ODD).filter(
        (DENOMINATOR * F.least("n_u", "n_v") >= NUMERATOR * F.greatest("n_u", "n_v"))
        & (_differing(_FPS) <= MOST_BITS) & _even_enough()
    ).select("u", "v")


def _beside(pairs: DataFrame, texts: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs u, v with n and ``columns`` of both, named after their side."""
    side = lambda name: texts.select(
        F.col("node").alias(name), *(F.col(f).alias(f"{f}_{name}") for f in ["n", *columns]))
    return pairs.join(side("u"), "u").join(side("v"), "v")


def _differing(columns: list[str]):
    return sum((F.bit_count(F.col(f"{f}_u").bitwiseXOR(F.col(f"{f}_v"))) for f in columns), F.lit(0))


def common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in two or more of a sample of the texts, sorted, and in how many; the commonest ``COMMON``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))], ["h"])

    sample = rows.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).distinct()
    found = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    top = found.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    hashes, counts = top["h"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prefix(hashes: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order, as many as any set of the similarity must meet."""
    n = len(hashes)
    first = n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0
    if not len(known):
        return hashes[:first]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    often = known[at] == hashes
    rare = hashes[~often][:first]
    if len(rare) == first:
        return rare
    return np.concatenate([rare, hashes[often][np.argsort(counts[at[often]], kind="stable")][: first - len(rare)]])


def _met(keys: np.ndarray, places: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Lists of two or more rows."""
    joined = np.diff(keys) == 0
    met = np.r_[joined, False] | np.r_[False, joined]
    yield pa.RecordBatch.from_arrays([pa.array(c[met]) for c in (keys, places, nodes)], ["key", "place", "node"])


def prefix_lists(rows: DataFrame) -> DataFrame:
    """key, place and node of the ``rows`` that share a shingle of their prefixes with another one. Keys are
    ``KEY_BITS`` of the shingle's hash, places from ``2 ** PLACE_BITS`` on count as the last one below: both add pairs only."""
    known = rows.sparkSession.sparkContext.broadcast(common(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys = [prefix(shingles(t), *known.value) for t in texts_of(part, "text")]
                sizes = list(map(len, keys))
                places = np.minimum(np.concatenate([np.arange(k) for k in sizes]), (1 << PLACE_BITS) - 1)
                packed = (np.concatenate(keys) & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64) << PLACE_BITS | places
                nodes = np.repeat(np.array(rows_of(part, "node")), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(packed), pa.array(nodes)], ["packed", "node"])

    key = F.shiftright("packed", PLACE_BITS)
    posted = rows.select("node", "text").mapInArrow(run, "packed long, node long")
    dealt = posted.repartition(key).sortWithinPartitions("packed")
    lists = dealt.select(key.alias("key"), F.expr(f"packed & {(1 << PLACE_BITS) - 1}").alias("place"), "node")
    return lists.mapInArrow(_by_list(_met, 3), "key long, place long, node long")


def _crossed(keys: np.ndarray, n: np.ndarray, place: np.ndarray, nodes: np.ndarray, roots: np.ndarray, *odd: np.ndarray):
    """Pairs u > v of whole lists, sorted by key and n, of different roots whose sizes, places and folded parities allow
    the similarity."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def allowed(a, b):
        most = np.minimum(n[a] - place[a], n[b] - place[b])
        return (roots[a] != roots[b]) & ((NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (n[a] + n[b]))

    def even(a, b):
        """The pairs that ``_even_enough`` would let pass on these parities."""
        differing = np.zeros(len(a), np.int64)
        for x in odd:
            differing += np.bitwise_count((x[a] ^ x[b]).view(np.uint64))
        own = (DENOMINATOR + NUMERATOR) * differing <= (DENOMINATOR - NUMERATOR) * (n[a] + n[b])
        return a[own], b[own]

    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    size = np.diff(np.append(starts, len(keys)))
    small = np.repeat(size <= SMALL, size)
    for step in range(1, SMALL):
        a = np.flatnonzero(small[:-step] & (keys[:-step] == keys[step:]))
        a = a[allowed(a, a + step)]
        a, b = even(a, a + step)
        left.append(a)
        right.append(b)
    for s, m in zip(starts[size > SMALL], size[size > SMALL]):
        e = s + m
        if (roots[s:e] == roots[s]).all():
            continue
        for at in range(s, e, WINDOW):
            rows_ = np.arange(at, min(at + WINDOW, e))
            upto = s + int(np.searchsorted(n[s:e], n[rows_[-1]] * DENOMINATOR // NUMERATOR, "right"))
            for to in range(at, upto, 4 * WINDOW):
                others = np.arange(to, min(to + 4 * WINDOW, upto))
                a, b = np.nonzero(allowed(rows_[:, None], others[None, :]) & (rows_[:, None] < others[None, :]))
                a, b = even(rows_[a], others[b])
                yield _batch(nodes[a], nodes[b])
    a, b = np.concatenate(left), np.concatenate(right)
    yield _batch(nodes[a], nodes[b])


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])


def untied(lists: DataFrame, tied: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct pairs u > v of ``prefix_lists`` that sizes, places and parities allow and that ``tied`` (node, root)
    leaves apart."""
    # hashes' classes modulo 64 * LIST_PARTS: parities of classes that fall together add up
    folded = [reduce(Column.bitwiseXOR, map(F.col, _ODD[k::LIST_PARTS])).alias(f"part{k}") for k in range(LIST_PARTS)]
    names = [f"part{k}" for k in range(LIST_PARTS)]
    roots = texts.join(tied, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), *folded)
    rooted = lists.join(roots, "node").select("key", "n", "place", "node", "root", *names)
    dealt = rooted.repartition("key").sortWithinPartitions("key", "n")
    pairs = dealt.mapInArrow(_by_list(_crossed, 5 + LIST_PARTS), "u long, v long").distinct()
    return _beside(pairs, texts, _ODD).filter(_even_enough()).select("u", "v")


def _even_enough():
    """Sets of the similarity differ in (denominator - numerator) / (denominator + numerator) of their sizes' sum at
    most, so in no more parities."""
    return (DENOMINATOR + NUMERATOR) * _differing(_ODD) <= (DENOMINATOR - NUMERATOR) * (F.col("n_u") + F.col("n_v"))


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The ``pairs`` that reach the similarity on their whole sets of shingles, staged. Texts travel, which are compressed
    where hashes are not; texts that are in no pair do not, but for the few that the map lets pass."""
    pairs = stage(pairs)
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    paired = rows.select("node", "text").filter(_in_map(nodes)(F.col("node")))
    side = lambda name: paired.select(F.col("node").alias(name), F.col("text").alias(f"of_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                of = {name: [shingles(t) for t in texts_of(part, f"of_{name}")] for name in "uv"}
                shared = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(of["u"], of["v"])]
                # shared / (total - shared) >= numerator / denominator
                near = [(NUMERATOR + DENOMINATOR) * k >= NUMERATOR * (len(a) + len(b))
                        for k, a, b in zip(shared, of["u"], of["v"])]
                yield part.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "of_u", "of_v")
    return stage(both.mapInArrow(run, "u long, v long"))


def links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links u > v that connect all ``texts`` of the similarity: those of ``candidates``, and every one between
    texts that these leave in different components."""
    found = _verified(candidates(texts), rows)
    return found.union(_verified(untied(prefix_lists(rows), components(found), texts), rows))


def _in_map(nodes: DataFrame):
    """A condition on a column of nodes that all ``nodes`` meet, and few others: one bit of a map of fixed size."""
    spark, size = nodes.sparkSession, 1 << CHUNK_BITS
    bit = lambda node: F.pmod(F.xxhash64(node), F.lit(1 << MAP_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            bits = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in np.unique(bits >> CHUNK_BITS).tolist():
                set_ = chunks.setdefault(chunk, np.zeros(size, bool))
                set_[bits[bits >> CHUNK_BITS == chunk] & (size - 1)] = True
        if chunks:
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array(list(chunks), pa.int64()), "bits": [np.packbits(x).tobytes() for x in chunks.values()]})

    bits = nodes.select(bit(F.col("node")).alias("bit"))
    dealt = bits.repartition(F.shiftright("bit", CHUNK_BITS))
    whole = np.zeros((1 << (MAP_BITS - CHUNK_BITS), size // 8), np.uint8)
    for r in dealt.mapInArrow(run, "chunk long, bits binary").collect():
        whole[r.chunk] = np.frombuffer(bytes(r.bits), np.uint8)
    shared = spark.sparkContext.broadcast(whole.ravel())

    @F.arrow_udf("boolean")
    def inside(bits: pa.Array) -> pa.Array:
        at = bits.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    return lambda node: inside(bit(node))


def one_of_each(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without all but the first of each component of links, all columns."""
    row = spare_name(docs, "row_id")
    path = fresh_path(docs.sparkSession, "numbered")  # Parquet, as whole texts are compressed there
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path, compression="zstd")
    numbered = docs.sparkSession.read.schema(StructType([*docs.schema.fields, StructField(row, LongType())])).parquet(path)
    rows = numbered.select(
        column(id_column).cast("long").alias("doc_id"), F.col(row).alias("node"), column(text).alias("text"))
    every = prints(rows)
    texts = stage(every.groupBy("same", "n").agg(
        F.min(F.struct("doc_id", "node")).alias("first"), *(F.first(f).alias(f) for f in _FPS + _ODD)
    ).withColumn("node", F.col("first.node")))
    tied = stage(components(links(rows, texts)))
    # texts tied to others, and the first of each component
    rooted = texts.select("node", "first").join(tied, "node")
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    beaten = rooted.join(heads, "root").filter(F.col("node") != F.col("head.node")).select("node")
    copies = every.join(texts.select("same", "n", F.col("node").alias("kept")), ["same", "n"]).filter("node != kept")
    gone = stage(beaten.union(copies.select("node")).withColumnRenamed("node", row))
    in_map = _in_map(gone.withColumnRenamed(row, "node"))(F.col(row))
    return numbered.filter(~in_map).unionByName(numbered.filter(in_map).join(gone, row, "left_anti")).drop(row)
