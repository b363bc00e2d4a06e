"""Mixture-controlled packing of tokenised documents into sequences.

Each source is a queue of tokens. In every round a queue is credited its target share of one
window's tokens and hands out whole quanta (``quantum`` tokens) as long as its credit lasts; what
is left over is its deficit, carried into the next round. The credit of a queue after r rounds
is the integer part of r times its share and a first part of a quantum, so the round in which a quantum is served, and how
much every other queue has handed out before it, follow from the queues' totals alone. Any task
can therefore place any document's tokens without knowing the other documents: deficits carry
across windows and partitions by arithmetic, no task sees a whole queue, and a source with a
third of all rows is spread like any other.

The served quanta in order fill sequence after sequence to the brim; only the last one is short.
A queue that runs dry stops earning credit; the others go on at their own shares.

Documents are tokenised once, into a staged table; positions inside a queue come from running
totals per scan partition plus offsets from the table of (partition, source) totals.

Null texts count as empty; every document ends with one end token, so each has a piece. A null
source is a queue of its own. Every source with a target has a queue, and so have the largest others, ``queues -
tails`` in all if targets are fewer; smaller ones share ``tails`` queues by hash, which bounds what the driver reads: together
they keep to their share, among themselves they come in order. No document is dropped. A source of share s gets s x
``window`` tokens in each window, up to one quantum carried to the next; shares below quantum / window
take turns. Repeated rows and null ids
are packed like any other; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.frames import column, per_batch, rows_of, texts_of
from riskloom.plans.staging import fits_broadcast, stage, stage_counted

_FRACTION = 16  # bits after the point of a credit per round


@dataclass(frozen=True)
class Packing:
    sequence: int = 2048
    #: tokens handed out at a time: below the share of a window that a twentieth of all tokens has
    quantum: int = 96
    #: tokens credited to all queues together in one round
    window: int = 2048
    end_token: int = 1
    queues: int = 1024
    tails: int = 64
    #: the vocabulary as ``tokenizers`` reads it, and the same one as ranks
    vocabulary: str = public_tokenizers.path("byte_bpe_50k.json")
    ranks: str = public_tokenizers.path("byte_bpe_50k.tiktoken")
    special: str = "<|endoftext|>"


@lru_cache(maxsize=2)
def encoder(packing: Packing):
    """text -> ids of ``tokenizers`` with ``packing.vocabulary`` and add_special_tokens=False.

    Texts are encoded from the ranks of the same vocabulary, which gives the same ids in a fifth
    of the time (held equal by tests over all code points); those that spell a special token go
    through ``tokenizers`` itself."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(packing.ranks, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    whole: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if packing.special not in text:
            return fast.encode_ordinary(text)
        if not whole:
            whole.append(Tokenizer.from_file(packing.vocabulary))
        return whole[0].encode(text, add_special_tokens=False).ids

    return encode


def tokenised(docs: DataFrame, packing: Packing, text: str, id_column: str, source: str) -> DataFrame:
    """Staged: doc_id, part, source, start (tokens of that source before it in its partition),
    n and ids (little-endian, 16 bits). Running totals hold one number per source."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("part", pa.int32()), ("source", pa.string()),
        ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()),
    ])

    def make():
        encode, before, part = encoder(packing), {}, TaskContext.get().partitionId()

        def columns(batch):
            out = {"doc_id": rows_of(batch, "doc_id"), "source": rows_of(batch, "source")}
            ids = [
                np.array([*encode(t), packing.end_token], "<u2").tobytes() for t in texts_of(batch, "text")
            ]
            starts = []
            for s, x in zip(out["source"], ids):
                starts.append(before.get(s, 0))
                before[s] = starts[-1] + len(x) // 2
            return out | {"part": [part] * len(ids), "start": starts, "n": [len(x) // 2 for x in ids], "ids": ids}

        return columns

    rows = docs.select(
        column(id_column).cast("long").alias("doc_id"), column(source).cast("string").alias("source"),
        column(text).alias("text"),
    )
    kinds = "doc_id long, part int, source string, start long, n long, ids binary"
    return stage(rows.mapInArrow(per_batch(make, schema), kinds))


def queued(tokens: DataFrame, packing: Packing, targets: dict[str, float] | None):
    """The staged (part, source) table with each row's queue and offset there, and the queues'
    (total, weight). Weights are the targets; queues without one share, by size, what the
    targets leave of the whole; without targets all shares are the queues' shares of all tokens."""
    spark = tokens.sparkSession
    parts = stage(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")))
    totals = parts.groupBy("source").agg(F.sum("n").alias("n"))
    # every source with a target has a queue of its own, then the largest of the others
    targeted = F.coalesce(F.col("source").isin(list(targets or {})), F.lit(False))
    if None in (targets or {}):
        targeted |= F.col("source").isNull()
    most = max(packing.queues - packing.tails, len(targets or {}))
    own = totals.orderBy(F.desc(targeted), F.desc("n"), "source").limit(most).collect()
    named = spark.createDataFrame(
        [(k, r.source) for k, r in enumerate(sorted(own, key=lambda r: (r.source is not None, r.source or "")))],
        "queue int, named string",
    )
    tail = F.lit(len(own)) + F.pmod(F.xxhash64("source"), F.lit(packing.tails)).cast("int")
    with_queue = parts.join(F.broadcast(named), parts.source.eqNullSafe(named.named), "left").select(
        "source", "part", "n", F.coalesce("queue", tail).alias("queue")
    )
    earlier = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    placed, rows = stage_counted(with_queue.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    sizes = placed.groupBy("queue").agg(F.sum("n").alias("n"), F.min("source").alias("source")).collect()
    total, weight = [0] * (len(own) + packing.tails), [0.0] * (len(own) + packing.tails)
    given = targets or {}
    free = sum(r.n for r in sizes if r.queue >= len(own) or r.source not in given)
    rest = max(0.0, 1 - sum(given.values()))
    for r in sizes:
        total[r.queue] = r.n
        listed = r.queue < len(own) and r.source in given
        weight[r.queue] = given[r.source] if listed else (rest if given else 1.0) * r.n / max(1, free)
    placed = placed.drop("n")
    # a row per source and partition: mostly small enough to spare the token ids a shuffle
    return F.broadcast(placed) if fits_broadcast(placed, rows) else placed, total, weight


class Rounds:
    """Where the quanta of the queues come to lie."""

    def __init__(self, total: list[int], weight: list[float], packing: Packing):
        self.total, self.quantum = np.array(total, np.int64), packing.quantum
        whole = sum(weight) or 1.0
        self.credit = np.array(
            [max(1, int(packing.window * w / whole * (1 << _FRACTION))) for w in weight], np.int64
        )
        # queues start with a part of a quantum each, so that small shares take turns and do not all wait
        turns = (np.arange(len(self.total)) * 0.6180339887498949) % 1
        self.start = (turns * packing.quantum * (1 << _FRACTION)).astype(np.int64)

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue (column) has handed out by the end of each of ``rounds``."""
        credit = (rounds[:, None] * self.credit[None, :] + self.start[None, :]) >> _FRACTION
        handed = np.where(credit >= self.total, self.total, credit // self.quantum * self.quantum)
        return np.where(rounds[:, None] > 0, handed, 0)

    def position(self, queue: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number of tokens served before quantum ``k`` of ``queue``."""
        need = np.minimum((k + 1) * self.quantum, self.total[queue])
        rounds = np.maximum(1, -((self.start[queue] - (need << _FRACTION)) // self.credit[queue]))
        at = np.arange(len(self.total))
        before = np.where(at[None, :] < queue[:, None], self.served(rounds), self.served(rounds - 1))
        before[np.arange(len(queue)), queue] = k * self.quantum
        return before.sum(axis=1)


def pieces_of(queue: np.ndarray, start: np.ndarray, n: np.ndarray, rounds: Rounds, sequence: int):
    """(document, start in it, length, position) arrays of the pieces of documents that hold
    tokens start .. start + n of their queues, by document and start."""
    q = rounds.quantum
    count = (start + n - 1) // q - start // q + 1
    doc = np.repeat(np.arange(len(n)), count)
    k = start[doc] // q + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    low, high = np.maximum(start[doc], k * q), np.minimum((start + n)[doc], (k + 1) * q)
    at = np.concatenate([
        rounds.position(queue[doc[i : i + 4096]], k[i : i + 4096]) for i in range(0, len(doc), 4096)
    ] or [np.empty(0, np.int64)]) + low - k * q
    # runs that follow each other without a gap are one; then cut at the sequences' ends
    joined = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + (high - low)[:-1])][: len(doc)])
    length = np.add.reduceat(high - low, joined) if len(doc) else high
    doc, low, at = doc[joined], low[joined], at[joined]
    cuts = (at + length - 1) // sequence - at // sequence + 1
    each = np.repeat(np.arange(len(doc)), cuts)
    turn = np.arange(len(each)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin = np.maximum(at[each], (at[each] // sequence + turn) * sequence)
    end = np.minimum((at + length)[each], (at[each] // sequence + turn + 1) * sequence)
    return doc[each], low[each] + begin - at[each] - start[doc[each]], end - begin, begin


_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("source", pa.string()), ("ids", pa.binary()),
])


def pack(
    docs: DataFrame, packing: Packing = Packing(), targets: dict[str, float] | None = None,
    text: str = "text", id_column: str = "doc_id", source: str = "source", with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    source and, if wanted, the piece's ids (little-endian, 32 bits)."""
    tokens = tokenised(docs, packing, text, id_column, source)
    placed, total, weight = queued(tokens, packing, targets)
    schema = _PIECES if with_ids else _PIECES.remove(_PIECES.get_field_index("ids"))

    def make():
        rounds = Rounds(total, weight, packing)

        def columns(batch):
            number = lambda c: np.array(rows_of(batch, c), np.int64)
            ids, docs_, sources = (rows_of(batch, c) for c in ("ids", "doc_id", "source"))
            n = number("n")
            doc, start, length, at = pieces_of(
                number("queue"), number("start") + number("offset"), n, rounds, packing.sequence
            )
            wide = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in ids]
            cut = [wide[d][4 * s : 4 * (s + x)] for d, s, x in zip(doc.tolist(), start.tolist(), length.tolist())]
            out = {
                "doc_id": [docs_[d] for d in doc], "start": start, "length": length,
                "ids_crc32": [zlib.crc32(x) for x in cut], "doc_tokens": n[doc],
                "sequence_id": at // packing.sequence, "offset": at % packing.sequence,
                "source": [sources[d] for d in doc], "ids": cut,
            }
            return out if with_ids else {k: v for k, v in out.items() if k != "ids"}

        return columns

    same = tokens.source.eqNullSafe(placed.source) & (tokens.part == placed.part)
    rows = tokens.join(placed, same).select(
        "doc_id", tokens.source, "start", "n", "ids", "queue", "offset"
    )
    kinds = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long, source string" + ", ids binary" * with_ids
    )
    return rows.mapInArrow(per_batch(make, schema), kinds)
