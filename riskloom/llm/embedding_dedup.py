"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Vectors link if their labels are equal and their cosine reaches a limit. Equal vectors of a label collapse to
one row with a count. A rotation is learnt on a bounded sample (``Limits.sample`` distinct vectors): the
leading axes of the centred vectors are turned again and again so that signs lose least, which gives balanced
binary codes. Codes are cut into substrings and each vector is posted in one Hamming table for each substring.

Retrieval is exact, not only likely. The turned vectors x, y of a link are no farther apart than the link's
largest distance d, so in at least one of m tables their parts are within d^2 / m. A bit in which the codes differ
there is flipped on the side where its component is smaller; such flips of both sides have squares
that sum up to d^2 / 4m at most. Hence each vector is posted under all substrings that it reaches by flipping bits
of so small a sum, and every link meets in an entry. Squares are held in 250ths of the limit, rounded down, so all tasks decide alike.

Entries are read twice. First with codes alone: of n bits in which the two codes of a link differ, at most k can have a
square above d^2 / (k + 1) on either side, which three masks of each code tell; only members with a possible partner go on, a
handful unless vectors are near. Then these are reranked: the cosine of the original vectors decides in double precision,
and a link counts in the first table where it meets, under the one key that flips every bit on its smaller side. Entries report counts and a spanning
forest of their links, never pairs.

Hot groups. Where an entry holds far more vectors than balanced codes would give it, their mean becomes the centre of a ball: all
vectors within half the link's angle of it link with each other by the triangle inequality, so their links are
counted in one sum and the rest of the search leaves them out. Entries above ``Limits.cell`` vectors are cut
into cells by ball, after counts of every sixteenth vector; a cell meets the vectors of other cells, but not those of its own ball.
So a group of near copies costs in proportion to its size.

Vectors that crowd round the centre, or that lie outside what the sample spans, have more flips, 2^13 a table at
most: that costs time, loses nothing, and is done in bounded pieces.

Vectors that are null, zero or hold null or non-finite components, and rows without a label, have no links and
are their own component; vectors of different length do not link. Copies link with each other. A component's id is its
smallest id; rows that share it by repeating an id are all kept, and rows without an id are kept if their whole
component has none. Ties cannot arise. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.frames import column
from riskloom.llm.simhash import components
from riskloom.plans.staging import broadcast_side, stage

#: flipping bits is allowed up to this sum of weights; a weight is 255 at most
_BUDGET = 250
#: of the bits with a square above d^2 / (k + 1) at most k differ between the ends of a link
_LEVELS = (0, 3, 9)
_PAIRS = 1 << 14
_CENTRE = 0.3
#: sets of flips held at a time
_SETS = 1 << 18


@dataclass(frozen=True)
class Limits:
    cosine: float = 0.98
    #: bits of a code, as far as vectors have components
    bits: int = 64
    bits_per_table: int = 13
    #: distinct vectors that the rotation is learnt from, and rounds of learning
    sample: int = 8192
    rounds: int = 50
    #: an entry is hot with so many vectors, if that is also so many times what balanced codes give it
    hot: int = 128
    hot_times: int = 16
    #: vectors of one entry that a task compares with all others of the entry at a time, and the share of
    #: vectors (one in so many) whose postings tell which entries are larger
    cell: int = 2048
    counted: int = 16

    def tables(self, dim: int) -> int:
        return -(-min(self.bits, dim) // self.bits_per_table)


# --- codes --------------------------------------------------------------------------
def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; they are scaled first, so that squares neither vanish nor overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def any_rotation(dim: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A fixed rotation for lengths that the sample does not hold."""
    turned = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]
    return np.zeros(dim), turned[:, :bits]


def thinned(x: np.ndarray, cosine: float) -> np.ndarray:
    """Unit rows without those near an earlier one, so that a hot group weighs no more than one vector."""
    kept = x[:0]
    for at in range(0, len(x), 256):
        block = x[at : at + 256]
        block = block[(block @ kept.T < cosine).all(axis=1)]
        near, keep = block @ block.T >= cosine, np.zeros(len(block), bool)
        for k in range(len(block)):
            keep[k] = not (near[k] & keep).any()
        kept = np.concatenate([kept, block[keep]])
    return kept


def learn(x: np.ndarray, bits: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centre and rotation by iterative quantisation of unit rows. The centre is their mean, at most
    ``_CENTRE`` long: no unit vector comes so near it that all its bits could flip."""
    dim = x.shape[1]
    bits = min(bits, dim)
    if len(x) < 2:
        return any_rotation(dim, bits)
    mean = x.mean(axis=0)
    mean *= min(1.0, _CENTRE / max(np.sqrt(mean @ mean), 1e-9))
    axes = np.linalg.eigh((x - mean).T @ (x - mean))[1][:, ::-1][:, :bits]
    projected = (x - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(0).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        signs = np.where(projected @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ projected)
        turn = (left @ right).T
    return mean, axes @ turn


def _bits(marks: np.ndarray) -> np.ndarray:
    """Rows of marks as 64-bit words."""
    whole = np.zeros((len(marks), 64), np.uint8)
    whole[:, : marks.shape[1]] = marks
    return np.packbits(whole, axis=1, bitorder="little").view("<u8").ravel()


class Coder:
    """Codes and weights of unit rows, for any length."""

    def __init__(self, limits: Limits, learnt: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.limits, self.learnt = limits, dict(learnt)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, weights [row, table, bit], masks [row, level]): the weight of a bit is its square in parts
        of the budget that a link has for flips in one table; a mask has the bits of which at most ``_LEVELS`` can differ."""
        dim, per = x.shape[1], self.limits.bits_per_table
        if dim not in self.learnt:
            self.learnt[dim] = any_rotation(dim, min(self.limits.bits, dim))
        mean, axes = self.learnt[dim]
        turned = (x - mean) @ axes
        tables = self.limits.tables(dim)
        farthest = (2 - 2 * self.limits.cosine) * (1 + 1e-6) + 1e-12
        squares = turned * turned
        weights = np.full((len(x), tables * per), 255, np.uint8)
        weights[:, : turned.shape[1]] = np.minimum(squares * (4 * tables * _BUDGET / farthest), 255)
        masks = np.stack([_bits(squares > farthest / (level + 1)) for level in _LEVELS], axis=1)
        return _bits(turned >= 0), weights.reshape(len(x), tables, per), masks


def flips(weights: np.ndarray, first: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row + first, mask, sum) of every set of bits whose weights [row, bit] sum up to the budget at most,
    for some rows at a time, the empty sets first."""
    row, mask, total = np.arange(len(weights)), np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64)
    for bit in range(weights.shape[1]):
        more = total + weights[row, bit]
        ok = more <= _BUDGET
        row, mask, total = (
            np.concatenate(pair) for pair in ((row, row[ok]), (mask, mask[ok] | 1 << bit), (total, more[ok]))
        )
        if len(row) > _SETS and len(weights) > 1:
            half = len(weights) // 2
            yield from flips(weights[:half], first)
            yield from flips(weights[half:], first + half)
            return
    for at in range(0, len(row), _PAIRS):
        part = slice(at, at + _PAIRS)
        yield row[part] + first, mask[part], total[part]


def _fitted(nodes: DataFrame, limits: Limits) -> Coder:
    """A rotation for the most common length."""
    common = nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return Coder(limits, {})
    own = nodes.filter(F.col("dim") == common["dim"])
    picked = own.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(limits.sample).collect()
    apart = thinned(unit(np.array([r[0] for r in picked])), limits.cosine)
    return Coder(limits, {common["dim"]: learn(apart, limits.bits, limits.rounds)})


_CODED = pa.schema([
    ("node", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("n", pa.int64()), ("code", pa.int64()),
    ("masks", pa.binary()), ("weights", pa.binary()), ("x", pa.binary()),
])
_CODED_KINDS = "node long, label long, dim int, n long, code long, masks binary, weights binary, x binary"


def coded(nodes: DataFrame, coder: Coder) -> DataFrame:
    """Code, weights and the packed vector of each node."""
    kind = "<f4" if nodes.schema["vector"].dataType.elementType.typeName() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                x = flat[starts[own][:, None] + np.arange(dim)[None, :]].astype(kind)
                codes, weights, masks = coder(unit(x))
                taken = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([
                    taken.column(0), taken.column(1), pa.array(np.full(len(own), dim), pa.int32()), taken.column(2),
                    pa.array(codes.view("<i8")),
                    *(pa.array([v.tobytes() for v in part], pa.binary()) for part in (masks, weights, x)),
                ], schema=_CODED)

    return nodes.select("node", "label", "n", "vector").mapInArrow(run, _CODED_KINDS)


def _matrix(values: pa.Array, kind: str) -> np.ndarray:
    """Binary values of one length as rows."""
    return np.frombuffer(b"".join(values.to_pylist()), kind).reshape(len(values), -1)


# --- entries ------------------------------------------------------------------------
def own_entries(points: DataFrame, limits: Limits) -> DataFrame:
    """``points`` (with dim and code) once for each table, with the entry ``slot`` of its own substring."""
    per = limits.bits_per_table
    tables = F.ceil(F.least(F.lit(limits.bits), F.col("dim")) / per).cast("int")
    numbered = points.withColumn("table", F.explode(F.sequence(F.lit(0), tables - 1)))
    part = F.expr(f"shiftrightunsigned(code, cast(table * {per} as int)) & {(1 << per) - 1}L")
    return numbered.withColumn("slot", (part + F.col("table").cast("long") * (1 << per)).cast("int")).drop("table")


_ENTRY = ["label", "dim", "slot"]


def balls(points: DataFrame, limits: Limits) -> DataFrame:
    """node and ball of vectors within half the link's angle of the centre of a hot entry."""
    own = own_entries(points, limits)
    members = points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("members"))
    counted = own.groupBy(*_ENTRY).agg(F.count(F.lit(1)).alias("entries")).filter(F.col("entries") >= limits.hot)
    usual = F.col("members") * (limits.hot_times / (1 << limits.bits_per_table))
    hot = broadcast_side(counted.join(members, ["label", "dim"]).filter(F.col("entries") >= usual).select(*_ENTRY))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def told():
            keys = list(sums)
            return pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.int32()),
                pa.array([sums[k].tolist() for k in keys], pa.list_(pa.float64())),
            ], ["label", "dim", "slot", "part"])

        for batch in batches:
            label, dim, slot = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            packed = batch.column(3)
            order = np.lexsort((slot, dim, label))
            cuts = np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(dim[order]) != 0) | (np.diff(slot[order]) != 0))
            for own_rows in np.split(order, cuts + 1):
                at = own_rows[0]
                x = _packed_units(packed.take(pa.array(own_rows)), int(dim[at]))
                key = (int(label[at]), int(dim[at]), int(slot[at]))
                sums[key] = sums.get(key, 0.0) + x.sum(axis=0)
            if len(sums) > 4096:
                yield told()
                sums.clear()
        if sums:
            yield told()

    parts = own.join(hot, _ENTRY).select(*_ENTRY, "x").mapInArrow(
        add, "label long, dim int, slot int, part array<double>"
    )
    summed = parts.select(*_ENTRY, F.posexplode("part").alias("place", "value")).groupBy(*_ENTRY, "place").agg(
        F.sum("value").alias("value")
    )
    centres = summed.groupBy(*_ENTRY).agg(  # as many numbers as a vector has
        F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("centre")
    )
    centres = broadcast_side(stage(centres).withColumn("ball", F.monotonically_increasing_id()))
    nearest = np.cos(np.arccos(limits.cosine) / 2 - 1e-6)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(3).offsets.to_numpy())
            for dim in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                centre = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                length = np.sqrt(np.einsum("ij,ij->i", centre, centre))
                x = _packed_units(part.column(2), int(dim))
                ok = np.einsum("ij,ij->i", x, centre) >= nearest * np.maximum(length, 1e-9)
                yield pa.RecordBatch.from_arrays(
                    [c.filter(pa.array(ok)) for c in (part.column(0), part.column(1))], ["node", "ball"]
                )

    near = own.join(centres, _ENTRY).select("node", "ball", "x", "centre").mapInArrow(inside, "node long, ball long")
    return near.groupBy("node").agg(F.min("ball").alias("ball"))


def _packed_units(values: pa.Array, dim: int) -> np.ndarray:
    width = len(values[0].as_py()) // dim if len(values) else 8
    return unit(_matrix(values, f"<f{width}"))


_POSTED = ["label", "dim", "slot", "node", "ball", "code", "spent", "mask0", "mask1", "mask2"]
_POSTED_KINDS = (
    "label long, dim int, slot int, node long, ball long, code long, spent short, mask0 long, mask1 long, mask2 long"
)


def postings(points: DataFrame, limits: Limits) -> DataFrame:
    """The code and masks of each of ``points`` under all entries that its flips reach."""
    per = limits.bits_per_table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                dims, codes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 4))
                masks = _matrix(batch.column(5), "<i8")
                for dim in np.unique(dims):
                    own = np.flatnonzero(dims == dim)
                    tables = limits.tables(int(dim))
                    weights = _matrix(batch.column(6).take(pa.array(own)), "u1").reshape(len(own), tables, per)
                    for table in range(tables):
                        for row, mask, spent in flips(weights[:, table]):
                            base = _part(codes[own[row]], table, per)
                            of = own[row]
                            taken = batch.take(pa.array(of))
                            yield pa.RecordBatch.from_arrays([
                                taken.column(0), taken.column(1), pa.array(((table << per) + (base ^ mask)).astype(np.int32)),
                                taken.column(2), taken.column(3), taken.column(4), pa.array(spent.astype(np.int16)),
                                *(pa.array(masks[of, k]) for k in range(3)),
                            ], _POSTED)

    return points.select("label", "dim", "node", "ball", "code", "masks", "weights").mapInArrow(run, _POSTED_KINDS)


def _part(codes: np.ndarray, table, per: int) -> np.ndarray:
    """The substring of a table."""
    return ((codes.view("<u8") >> np.asarray(table * per, "<u8")) & np.uint64((1 << per) - 1)).astype(np.int64)


def _cells(points: DataFrame, limits: Limits) -> DataFrame:
    """For entries of more than ``limits.cell`` vectors, by the count of one in ``limits.counted``: the cells
    of each ball, after those (k0) of vectors in none."""
    some = points.filter(F.pmod(F.xxhash64("node"), F.lit(limits.counted)) == 0)
    by_ball = postings(some, limits).groupBy(*_ENTRY, "ball").agg((F.count(F.lit(1)) * limits.counted).alias("members"))
    whole = Window.partitionBy(*_ENTRY)
    before = whole.orderBy(F.col("ball").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    free = F.when(F.col("ball").isNull(), F.col("k"))
    sized = by_ball.withColumns(
        {"k": F.ceil(F.col("members") / limits.cell), "all": F.sum("members").over(whole)}
    ).filter(F.col("all") > limits.cell).withColumns({
        "k0": F.coalesce(F.sum(free).over(whole), F.lit(1)),
        "ahead": F.coalesce(F.sum(F.when(F.col("ball").isNotNull(), F.col("k"))).over(before), F.lit(0)),
    })
    listed = F.when(F.col("ball").isNotNull(), F.struct("ball", (F.col("k0") + F.col("ahead")).alias("first"), "k"))
    return sized.groupBy(*_ENTRY).agg(F.first("k0").alias("k0"), F.collect_list(listed).alias("cells"))


def _dealt(posted: DataFrame, cells: DataFrame) -> DataFrame:
    """Postings with their cell and whether they are resident there. Vectors of later cells pass through
    earlier ones, but no vector passes through a cell of its own ball."""
    own = F.expr(
        "coalesce(get(transform(filter(cells, s -> s.ball = ball), s -> s.first + pmod(xxhash64(node), s.k)), 0), "
        "pmod(xxhash64(node), k0))"
    )
    to = F.expr(
        "concat(filter(sequence(0L, k0 - 1), c -> c < own), flatten(transform(filter(cells, s -> not (s.ball <=> ball)), "
        "s -> filter(sequence(s.first, s.first + s.k - 1), c -> c < own))), array(own))"
    )
    spread = posted.join(broadcast_side(cells), _ENTRY, "left").withColumn("own", F.when(F.col("k0").isNotNull(), own))
    one = F.array(F.lit(0).cast("long"))
    met = spread.withColumn("cell", F.explode(F.when(F.col("k0").isNull(), one).otherwise(to)))
    resident = F.col("own").isNull() | (F.col("cell") == F.col("own"))
    return met.select(*_ENTRY, "cell", resident.alias("resident"), *_POSTED[3:])


# --- links --------------------------------------------------------------------------
class _Rows:
    """Columns of rows of vectors of one length, in the order of their cells, residents first."""

    def __init__(self, columns: dict):
        self.__dict__ = columns

    def take(self, at) -> "_Rows":
        return _Rows({k: v[at] for k, v in self.__dict__.items()})

    def joined(self, other: "_Rows") -> "_Rows":
        return _Rows({k: np.concatenate([v, other.__dict__[k]]) for k, v in self.__dict__.items()})

    def starts(self) -> np.ndarray:
        moved = (np.diff(self.label) != 0) | (np.diff(self.slot) != 0) | (np.diff(self.cell) != 0)
        return np.concatenate([[0], np.flatnonzero(moved) + 1])

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.ball[i] != self.ball[j]) | (self.ball[i] < 0)


def _plain(batch: pa.RecordBatch, names: list[str]) -> dict:
    """Columns as arrays, a missing ball as -1."""
    found = {}
    for name in names:
        values = batch.column(batch.schema.get_field_index(name))
        found[name] = (values.fill_null(-1) if name == "ball" else values).to_numpy(zero_copy_only=False)
    found["resident"] = found["resident"].astype(bool)
    return found


class _Possible:
    """The first reading: members with a possible partner, by codes and masks alone."""

    names = [*_ENTRY, "cell", "resident", *_POSTED[3:]]

    def __init__(self, limits: Limits):
        self.limits = limits

    def rows(self, batch: pa.RecordBatch) -> _Rows:
        found = _plain(batch, self.names)
        return _Rows(found | {"told": np.zeros(batch.num_rows, bool)})

    def _near(self, rows: _Rows, i, j) -> np.ndarray:
        differ = rows.code[i] ^ rows.code[j]
        near = rows.spent[i] + rows.spent[j] <= _BUDGET
        for mask, level in zip((rows.mask0, rows.mask1, rows.mask2), _LEVELS):
            for side in (i, j):
                near &= np.bitwise_count(differ & mask[side]) <= level
        return near

    def pairs(self, rows: _Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._near(rows, i, j)

    def block(self, rows: _Rows, a: slice, b: slice) -> np.ndarray:
        i, j = np.arange(a.start, a.stop)[:, None], np.arange(b.start, b.stop)[None, :]
        return self._near(rows, i, j)

    def told(self, rows: _Rows, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Each member once, however many partners it may have."""
        new = np.zeros(len(rows.node), bool)
        new[i] = new[j] = True
        new &= ~rows.told
        rows.told |= new
        at = np.flatnonzero(new)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows.__dict__[c][at]) for c in _MEMBER], _MEMBER
            )


_MEMBER = ["slot", "cell", "resident", "node"]
_MEMBER_KINDS = "slot int, cell long, resident boolean, node long"


class _Links:
    """The second reading: links by the cosine of the original vectors."""

    names = [*_ENTRY, "cell", "resident", "node", "ball", "n", "code"]

    def __init__(self, limits: Limits):
        self.limits = limits

    def rows(self, batch: pa.RecordBatch) -> _Rows:
        found = _plain(batch, self.names)
        dim = int(found["dim"][0])
        tables, per = self.limits.tables(dim), self.limits.bits_per_table
        weights, x = (batch.column(batch.schema.get_field_index(c)) for c in ("weights", "x"))
        return _Rows(found | {
            "weights": _matrix(weights, "u1").reshape(-1, tables, per), "x": _packed_units(x, dim),
        })

    def pairs(self, rows: _Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", rows.x[i], rows.x[j]) >= self.limits.cosine

    def block(self, rows: _Rows, a: slice, b: slice) -> np.ndarray:
        return rows.x[a] @ rows.x[b].T >= self.limits.cosine

    def counts_here(self, rows: _Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the entry at hand is the one where each pair counts."""
        per, tables = self.limits.bits_per_table, rows.weights.shape[1]
        differ = np.unpackbits((rows.code[i] ^ rows.code[j]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        differ = np.pad(differ, ((0, 0), (0, max(0, tables * per - 64))))[:, : tables * per].reshape(len(i), tables, per)
        by_i, by_j = rows.weights[i], rows.weights[j]
        meets = np.where(differ, np.minimum(by_i, by_j), 0).sum(axis=2, dtype=np.int32) <= _BUDGET
        here, table = np.arange(len(i)), rows.slot[i] >> per
        first = meets[here, table] & ~(meets & (np.arange(tables) < table[:, None])).any(axis=1)
        by_i, by_j = by_i[here, table], by_j[here, table]
        flipped = (differ[here, table] > 0) & ((by_i < by_j) | ((by_i == by_j) & (rows.node[i] < rows.node[j])[:, None]))
        mask = flipped @ (1 << np.arange(per))
        return first & (_part(rows.code[i], table, per) ^ mask == rows.slot[i] & ((1 << per) - 1))

    def told(self, rows: _Rows, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts and a forest of the pairs that count here."""
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            keep = self.counts_here(rows, a, b)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            size = len(rows.n)
            # whole numbers below 2^53 add exactly
            links = np.bincount(a, rows.n[b], size) + np.bincount(b, rows.n[a], size)
            point, root = _roots(a, b)
            yield pa.RecordBatch.from_arrays([
                pa.array(rows.node[point]), pa.array(rows.node[root]), pa.array(links[point].astype(np.int64)),
            ], schema=_LINKS)


def _roots(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, root) of all points that the links i, j touch: the smallest of each component."""
    points, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j, root = at[: len(i)], at[len(i) :], np.arange(len(points))
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new[new]]
        if (new == root).all():
            return points, points[root]
        root = new


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


def _scan(limits: Limits, reading):
    """Pairs of rows of one cell, one of them resident, given to ``reading`` where it holds them near."""

    def small(rows: _Rows, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs at every distance inside short cells, many cells at a time. ``ends``: of each row's cell."""
        found, place, step = [], np.flatnonzero(rows.resident), 1
        while True:
            place = place[place + step < ends[place]]
            if not len(place):
                break
            for at in range(0, len(place), _PAIRS):
                i = place[at : at + _PAIRS]
                i = i[rows.apart(i, i + step)]
                near = reading.pairs(rows, i, i + step)
                found.append((i[near], i[near] + step))
            step += 1
        if found:
            yield from reading.told(rows, *(np.concatenate(side) for side in zip(*found)))

    def large(rows: _Rows, met: bool = False) -> Iterator[pa.RecordBatch]:
        """Residents of one long cell against all rows after them, or only against those that pass by."""
        residents = int(rows.resident.sum())
        for a in range(0, residents, 512):
            some = slice(a, min(a + 512, residents))
            for b in range(residents if met else a, len(rows.node), 2048):
                near = reading.block(rows, some, slice(b, min(b + 2048, len(rows.node))))
                i, j = np.nonzero(near)
                i, j = i + a, j + b
                ok = (i < j) & rows.apart(i, j)
                yield from reading.told(rows, i[ok], j[ok])

    def compared(rows: _Rows) -> Iterator[pa.RecordBatch]:
        starts = rows.starts()
        sizes = np.diff(np.append(starts, len(rows.node)))
        short = np.repeat(sizes <= 64, sizes)
        if short.any():
            own = rows.take(short)
            kept = sizes[sizes <= 64]
            yield from small(own, np.repeat(np.cumsum(kept), kept))
        for at, size in zip(starts[sizes > 64], sizes[sizes > 64]):
            yield from large(rows.take(slice(at, at + size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Rows | None = None  # of the last cell, which may go on
        met = False  # only its residents are held, and have met all before
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for part in np.split(np.arange(len(dims)), np.flatnonzero(np.diff(dims)) + 1):
                if not len(part):
                    continue
                rows = reading.rows(batch.slice(part[0], len(part)))
                if held is not None and held.dim[0] == rows.dim[0]:
                    rows = held.joined(rows)
                else:
                    if held is not None and not met:
                        yield from compared(held)
                    met = False
                starts = rows.starts()
                if met:
                    passing = rows.take(slice(0, starts[1] if len(starts) > 1 else None))
                    yield from large(passing, met)
                    if len(starts) == 1:
                        held = passing.take(passing.resident)
                        continue
                    rows, met = rows.take(slice(starts[1], None)), False
                    starts = rows.starts()
                if starts[-1]:
                    yield from compared(rows.take(slice(0, starts[-1])))
                held = rows.take(slice(starts[-1], None))
                if len(held.node) > 4 * limits.cell and not held.resident[-1]:
                    # all residents are here; what passes by need not be held
                    yield from large(held)
                    kept = held.take(held.resident)
                    held, met = (kept, True) if len(kept.node) else (None, False)
        if held is not None and not met:
            yield from compared(held)

    return run


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_ENTRY, "cell").sortWithinPartitions(*_ENTRY, "cell", F.desc("resident"))


def links(points: DataFrame, limits: Limits) -> DataFrame:
    """u, v and links: partial link counts of u, with links u-v that span all components; staged."""
    first, second = _Possible(limits), _Links(limits)
    dealt = _by_cell(_dealt(postings(points, limits), _cells(points, limits)))
    members = stage(dealt.select(*first.names).mapInArrow(_scan(limits, first), _MEMBER_KINDS))
    with_vectors = _by_cell(members.join(points, "node"))
    return stage(with_vectors.select(*second.names, "weights", "x").mapInArrow(
        _scan(limits, second), "u long, v long, links long"
    ))


def near_duplicates(
    vectors: DataFrame, limits: Limits = Limits(), id_column: str = "vec_id", vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """The id, n_links, component_id and kept of every row."""
    rows = vectors.select(
        column(id_column).alias("id"), column(label).cast("long").alias("label"), column(vector).alias("vector")
    )
    # NaN compares above and equal to itself in Spark, so one test covers it and infinities
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    usable = rows.filter(
        F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", odd)
        & F.exists("vector", lambda c: c != 0)
    )
    nodes = stage(usable.groupBy("label", "vector").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.size("vector").alias("dim")
    ).withColumn("node", F.monotonically_increasing_id()))
    packed = stage(coded(nodes, _fitted(nodes, limits)))
    in_ball = stage(balls(packed, limits))
    points = stage(packed.join(in_ball, "node", "left"))
    found = links(points, limits)

    by_ball = points.filter(F.col("ball").isNotNull()).groupBy("ball").agg(
        F.sum("n").alias("in_ball"), F.min("node").alias("hub")
    )
    mates = stage(points.select("node", "n", "ball").join(by_ball, "ball"))
    edges = found.filter("u <> v").select("u", "v").unionByName(
        mates.filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    ).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    counts = found.select("u", "links").unionByName(
        mates.select(F.col("node").alias("u"), (F.col("in_ball") - F.col("n")).alias("links"))
    ).groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    rooted = nodes.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = rooted.join(firsts, "root").join(counts, "node", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id",
        F.lit(True).alias("known"),
    )
    whole = rows.join(known, ["label", "vector"], "left").select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).cast("long").alias("component_id"),
    )
    return whole.withColumn("kept", column(id_column).eqNullSafe(F.col("component_id")))
