"""SentencePiece encoding and decoding by a max-plus parallel scan.

Encoding picks one way through a text's lattice of pieces: for a "unigram" vocabulary the way with
the largest sum of scores, for a "bpe" one the way that merging neighbours by rank ends in. The
latter is the only way of which each two neighbouring pieces, taken by themselves, are encoded as
these two pieces (a merge across a boundary would depend on its two sides alone); such a pair adds 0
to a sum, any other minus infinity, so both kinds are a largest sum.

A giant text is split into chunks that tasks work on apart. All that a chunk has to know of the
text before it is its state: how far the last piece reaches over the cut and, for bpe, how long it
is. So a chunk is a matrix: an entry holds the best sum of a way from one state at its start to one
at its end. Matrices multiply associatively in (max, +); the products from the left give each
chunk the best sums of its start states. From these every chunk, on its own again, traces its best
ways back from each end state: they share one trunk and differ in a few last pieces. Which end state
is taken follows from the chunks' (end to start) maps, read from the right.

No piece of the vocabulary goes on after a letter with a new word's mark, so a state is forgotten
where a word begins and whole words in between are split on their own; a vocabulary that has such
pieces is scanned character by character. Characters outside the vocabulary become the
pieces of their UTF-8 bytes; in sums they count less than any piece. Of equal sums the way whose
last piece is longest is taken, then the last but one, and so on; sums are exact, as scores are whole
numbers in doubles. Tests hold ids equal to the library's for both kinds.

A null text counts as empty and has no pieces. Very long texts are read whole; a text is one row
and so at most 2 GB, which bounds its chunks' matrices to a few hundred MB. Repeated rows are encoded
each on its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from riskloom.llm.frames import column, per_batch, rows_of
from riskloom.plans.staging import stage

MARK = "▁"
_NONE = float("-inf")


@dataclass(frozen=True)
class Scan:
    model: str = public_tokenizers.path("piece_bpe_32k.model")
    chunk: int = 32_768  # characters; no less than the longest piece
    remembered: int = 300_000  # words and pairs within a task


class Vocabulary:
    """Pieces, scores and the split of short strings."""

    def __init__(self, scan: Scan):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(scan.model, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model.trainer_spec
        if kinds.model_type not in (kinds.UNIGRAM, kinds.BPE):
            raise ValueError("the vocabulary is neither unigram nor bpe")
        self.by_rank = kinds.model_type == kinds.BPE
        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=scan.model)
        size = range(sp.get_piece_size())
        plain = [k for k in size if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) or sp.is_byte(k))]
        self.pieces = [sp.id_to_piece(k) for k in size]
        self.ids = {self.pieces[k]: k for k in plain}
        self.scores = {self.pieces[k]: float(sp.get_score(k)) for k in plain}
        self.bytes = {int(self.pieces[k][1:-1], 16): k for k in size if sp.is_byte(k)}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.unknown = sp.unk_id()
        self.silent = {k for k in size if sp.is_control(k)}
        self.odd = {self.unknown, *self.byte_of, *self.silent}  # not decoded to their own text
        self.unknown_score = min(self.scores.values(), default=0.0) - 10.0
        self.longest = max(map(len, self.scores), default=1)
        #: score of each piece; None for what only begins one
        self.table = {p[:k]: None for p in self.scores for k in range(1, len(p))} | self.scores
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.scores)
        self.word = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if self.by_word else None
        self.limit, self.known = scan.remembered, {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def normal(self, text: str) -> str:
        """Blanks as marks, with one in front."""
        return MARK + text.replace(" ", MARK) if text else ""

    def forward(self, s: str, size: int, entry: dict[int, float]) -> tuple[list[float], list[int]]:
        """Best sums at the places of ``s`` reached from ``entry`` by pieces that begin before
        ``size``, and where the last piece there begins."""
        n = len(s)
        best, back = [_NONE] * (n + 1), [-1] * (n + 1)
        for at, x in entry.items():
            best[at] = x
        table, longest = self.table, self.longest
        for at in range(size):
            so_far = best[at]
            if so_far == _NONE:
                continue
            single = False
            for end in range(at + 1, min(n, at + longest) + 1):
                score = table.get(s[at:end], False)
                if score is None:
                    continue
                if score is False:
                    break
                if end == at + 1:
                    single = True
                # earlier starts come first, so at equal sums the longer last piece stays
                if so_far + score > best[end]:
                    best[end], back[end] = so_far + score, at
            if not single and so_far + self.unknown_score > best[at + 1]:
                best[at + 1], back[at + 1] = so_far + self.unknown_score, at
        return best, back

    def of_piece(self, piece: str) -> list[int]:
        k = self.ids.get(piece)
        if k is not None:
            return [k]
        return [self.bytes.get(b, self.unknown) for b in piece.encode()] if self.bytes else [self.unknown]

    def merged(self, s: str) -> list[str]:
        """The pieces that merging neighbours ends in: highest score first, then leftmost."""
        scores, n = self.scores, len(s)
        if n <= 256:  # for words a list is quicker than a heap
            parts = list(s)
            gains = [scores.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
            while gains and (most := max(gains)) > _NONE:
                k = gains.index(most)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                del gains[k]
                if k < len(gains):
                    gains[k] = scores.get(parts[k] + parts[k + 1], _NONE)
                if k:
                    gains[k - 1] = scores.get(parts[k - 1] + parts[k], _NONE)
            return parts
        ends = list(range(1, n + 1))  # of the piece that begins at a place; 0 once it is merged away
        begins = list(range(-1, n - 1))  # of the piece before
        heap = [(-scores[s[k : k + 2]], k, k + 2) for k in range(n - 1) if s[k : k + 2] in scores]
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            middle = ends[at]
            if not middle or middle >= n or ends[middle] != end or middle == end:
                continue
            ends[at], ends[middle] = end, 0
            if end < n:
                begins[end] = at
                if (score := scores.get(s[at : ends[end]])) is not None:
                    heapq.heappush(heap, (-score, at, ends[end]))
            if (before := begins[at]) >= 0 and (score := scores.get(s[before:end])) is not None:
                heapq.heappush(heap, (-score, before, end))
        out, at = [], 0
        while at < n:
            out.append(s[at : ends[at]])
            at = ends[at]
        return out

    def fit(self, a: str, b: str) -> bool:
        """Whether pieces a and b stay as they are beside each other."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def split(self, s: str) -> tuple[float, list[int]]:
        """Best sum and ids of a whole string."""
        if self.by_rank:
            return 0.0, [k for p in self.merged(s) for k in self.of_piece(p)]
        best, back = self.forward(s, len(s), {0: 0.0})
        at, pieces = len(s), []
        while at > 0:
            pieces.append(s[back[at] : at])
            at = back[at]
        return best[len(s)], [k for p in reversed(pieces) for k in self.of_piece(p)]

    def words(self, s: str) -> list[tuple[float, list[int]]]:
        """The split of ``s``, which begins and ends where words do, in one or more parts.

        Merging by rank inside such a stretch is left to the library. Its sums of scores are in
        single precision, so those are made here, word by word."""
        if self.by_rank and self.by_word and s[:1] == MARK:
            return [(0.0, self.library.encode(s[1:]))]  # it puts the first mark back
        if self.word is None:
            return [self.split(s)] if s else []
        out, known = [], self.known
        for w in self.word.findall(s):
            got = known.get(w)
            if got is None:
                got = self.split(w)
                if len(w) <= 64:
                    if len(known) >= self.limit:
                        known.clear()
                    known[w] = got
            out.append(got)
        return out

    def encode(self, text: str) -> list[int]:
        return [k for _, ids in self.words(self.normal(text)) for k in ids]

    def decode(self, ids) -> str:
        if self.odd.isdisjoint(ids):
            text = "".join(map(self.pieces.__getitem__, ids)).replace(MARK, " ")
            return text[1:] if text[:1] == " " else text
        out, held = [], bytearray()
        for k in ids:
            if k in self.byte_of:
                held.append(self.byte_of[k])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append("" if k in self.silent else self.pieces[k] if k != self.unknown else " ⁇ ")
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text[:1] == " " else text

    # A chunk is given with ``lead`` characters before its own ``size`` ones, and with some after
    # them, each as many as a piece may reach. A state is (place, length of the piece that ends
    # there); the length is 0 where it does not matter.
    def _steps(self, s: str, at: int, lengths):
        """(length before, end, length, score) of the pieces that may go on from a place."""
        single = False
        for end in range(at + 1, min(len(s), at + self.longest) + 1):
            piece = s[at:end]
            score = self.table.get(piece, False)
            if isinstance(score, float) or self.by_rank and end == at + 1:
                single |= end == at + 1
                if not self.by_rank:
                    yield 0, end, 0, score
                elif self.fit("", piece):
                    for n in lengths:
                        if not n or self.fit(s[at - n : at], piece):
                            yield n, end, end - at, 0.0
            if score is False:
                break
        if not single and not self.by_rank:
            yield 0, at + 1, 0, self.unknown_score

    def _word_starts(self, s: str, lead: int, size: int) -> tuple[int, int]:
        """First and last place of the chunk behind its start where a word begins; (size, size) if none."""
        if self.word is None:
            return size, size
        begins = lambda k: s[lead + k] == MARK and s[lead + k - 1] != MARK
        first = next((k for k in range(1, size) if begins(k)), size)
        last = next((k for k in range(size - 1, first, -1) if begins(k)), first)
        return first, last

    def _reach(self, s: str, lead: int, low: int, high: int, values: dict[tuple[int, int], np.ndarray]) -> dict:
        """Sums, for each start at once, of the states at or after ``high`` reached from ``values``."""
        by_place: dict[int, dict[int, np.ndarray]] = {}
        for (at, n), x in values.items():
            by_place.setdefault(at, {})[n] = x
        for at in range(low, high):
            here = by_place.pop(at, None)
            if not here:
                continue
            for before, end, n, score in self._steps(s, lead + at, here):
                there = by_place.setdefault(end - lead, {})
                x = here[before] + score
                there[n] = np.maximum(there[n], x) if n in there else x
        return {(at, n): x for at, states in by_place.items() for n, x in states.items()}

    def starts(self, s: str, lead: int, size: int) -> list[tuple[int, int]]:
        """Every state that the text before may leave at the chunk's start."""
        if not lead:
            return [(0, 0)]
        over = range(min(self.longest, len(s) - lead + 1))
        if not self.by_rank:
            return [(i, 0) for i in over]
        return [
            (i, n) for i in over for n in range(max(1, i), min(self.longest, lead + i) + 1)
            if (n > i or not i) and (n == 1 or s[lead + i - n : lead + i] in self.scores) and self.fit("", s[lead + i - n : lead + i])
        ]

    def matrix(self, s: str, lead: int, size: int) -> np.ndarray:
        """Rows (start place, start length, end place, end length, best sum)."""
        states = self.starts(s, lead, size)
        unit = np.where(np.eye(len(states), dtype=bool), 0.0, _NONE)
        first, last = self._word_starts(s, lead, size)
        found = self._reach(s, lead, 0, first, {state: unit[k] for k, state in enumerate(states)})
        if first < size:
            # all ways meet at the first word's start; states past it are none of a real text
            met = [x for (at, _), x in found.items() if at == first]
            if not met:
                return np.empty((0, 5))
            inner = 0.0 if self.by_rank else sum(score for score, _ in self.words(s[lead + first : lead + last]))
            tail = self._reach(s, lead, last, size, {(last, 0): np.zeros(1)})
            head = np.max(met, axis=0) + inner
            found = {state: head + x[0] for state, x in tail.items()}
        return np.array([
            (*states[k], at - size, n, x[k]) for (at, n), x in found.items() for k in np.flatnonzero(x > _NONE)
        ]).reshape(-1, 5)

    def _trace(self, s: str, lead: int, low: int, high: int, values: dict[tuple[int, int], float]):
        """Best sums of all states reached from ``values``, and the state before each."""
        best, back, by_place = dict(values), {}, {}
        for at, n in values:
            by_place.setdefault(at, []).append(n)
        for at in range(low, high):
            for before, end, n, score in self._steps(s, lead + at, by_place.get(at, ())) if at in by_place else ():
                state, x = (end - lead, n), best[at, before] + score
                if state not in best:
                    by_place.setdefault(end - lead, []).append(n)
                if x > best.get(state, _NONE):
                    best[state], back[state] = x, (at, before)
        return best, back

    def paths(self, s: str, lead: int, size: int, entry: dict[tuple[int, int], float]):
        """The ids that all best ways from ``entry`` share, and for each end state its start
        state and the ids that come after the shared ones."""
        first, last = self._word_starts(s, lead, size)

        def walk(back, state):
            places = [state]
            while places[-1] in back:
                places.append(back[places[-1]])
            return places[::-1]

        ids = lambda w: [k for (a, _), (b, _) in zip(w, w[1:]) for k in self.of_piece(s[lead + a : lead + b])]
        trunk, begin = [], None
        if first < size:
            best, back = self._trace(s, lead, 0, first, entry)
            way = walk(back, max((x for x in best if x[0] == first), key=lambda x: best[x]))
            trunk, begin = ids(way), way[0]
            trunk += [k for _, w in self.words(s[lead + first : lead + last]) for k in w]
            best, back = self._trace(s, lead, last, size, {(last, 0): best[way[-1]]})
        else:
            best, back = self._trace(s, lead, 0, size, entry)
        walks = {state: walk(back, state) for state in best if state[0] >= size}
        if begin is None and walks:
            shared = set.intersection(*map(set, walks.values()))
            meet = max((p for p in shared if p[0] <= size), default=None)
            if meet is not None:
                common = next(iter(walks.values()))
                common = common[: common.index(meet) + 1]
                trunk, begin = ids(common), common[0]
                walks = {state: w[w.index(meet) :] for state, w in walks.items()}
        return trunk, {(at - size, n): (begin or w[0], ids(w)) for (at, n), w in walks.items()}


@lru_cache(maxsize=2)
def vocabulary(scan: Scan = Scan()) -> Vocabulary:
    return Vocabulary(scan)


def chunks_of(s: str, scan: Scan, longest: int) -> Iterator[tuple[int, int, int, str]]:
    """(number, lead, size, characters with what a piece may reach on either side)."""
    for number, at in enumerate(range(0, len(s), scan.chunk)):
        lead, size = min(at, longest), min(scan.chunk, len(s) - at)
        yield number, lead, size, s[at - lead : at + size + longest]


def entries(matrices: list[np.ndarray]) -> list[dict[tuple[int, int], float]]:
    """Best sums of each chunk's start states: the products of the matrices before it."""
    out, now = [], {(0, 0): 0.0}
    for m in matrices:
        out.append(now)
        after: dict[tuple[int, int], float] = {}
        for i, before, o, n, score in m.tolist():
            x = now.get((i, before), _NONE) + score
            if x > after.get((o, n), _NONE):
                after[int(o), int(n)] = x
        # only differences matter inside a text, and small numbers stay exact
        top = max(after.values(), default=0.0)
        now = {state: x - top for state, x in after.items()}
    return out


def joined(parts) -> list[int]:
    """The ids of a text from its chunks' paths: end states are read from the right, where
    the last piece ends with the text."""
    out, state = [], None
    for trunk, exits in reversed(parts):
        if state is None:
            state = next(x for x in exits if x[0] == 0)
        state, tail = exits[state]
        out.append([*trunk, *tail])
    return [k for ids in reversed(out) for k in ids]


_IDS = pa.list_(pa.int32())


#: characters of short texts that are encoded before their rows are sent on
_AT_A_TIME = 1 << 21


def _long(docs: DataFrame, scan: Scan, finish, kinds: str) -> DataFrame:
    """What ``finish(doc_id, text, ids)`` makes of each text of ``docs``, by the scan. Row numbers only
    tell apart the chunks of one staged table, which carry all that is known of their row."""
    names = ("number", "lead", "size", "s")
    cut_schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int32()) for c in names[:3]), ("s", pa.string()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(scan)
        for batch in batches:
            for row, doc, text in zip(*(rows_of(batch, c) for c in ("row", "doc_id", "text"))):
                # chunks hold the text as it is, so that it can be told from what the pieces decode to
                parts = list(chunks_of(" " + text if text else "", scan, known.longest))
                for at in range(0, len(parts), 256):
                    some = parts[at : at + 256]
                    columns = {c: [p[k] for p in some] for k, c in enumerate(names)}
                    yield pa.RecordBatch.from_pydict(
                        {"row": [row] * len(some), "doc_id": [doc] * len(some), **columns}, schema=cut_schema
                    )

    def chunks(batch):
        for s, lead, size in zip(*(rows_of(batch, c) for c in ("s", "lead", "size"))):
            yield s.replace(" ", MARK), lead, size

    def matrices():
        known = vocabulary(scan)
        return lambda batch: {
            "row": rows_of(batch, "row"), "number": rows_of(batch, "number"),
            "m": [known.matrix(*chunk).astype("<f8").tobytes() for chunk in chunks(batch)],
        }

    def scanned(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number")
        found = entries([np.frombuffer(m, "<f8").reshape(-1, 5) for m in group["m"]])
        group["entry"] = [np.array([(*state, x) for state, x in e.items()], "<f8").tobytes() for e in found]
        return group[["row", "number", "entry"]]

    def traced():
        known = vocabulary(scan)

        def columns(batch):
            trunks, exits = [], []
            for chunk, e in zip(chunks(batch), rows_of(batch, "entry")):
                entry = {(int(i), int(n)): x for i, n, x in np.frombuffer(e, "<f8").reshape(-1, 3).tolist()}
                trunk, ways = known.paths(*chunk, entry)
                trunks.append(np.array(trunk, np.int32))
                exits.append([{"end": [*end], "start": [*start], "ids": ids} for end, (start, ids) in ways.items()])
            own = [s[lead : lead + size] for s, lead, size in zip(*(rows_of(batch, c) for c in ("s", "lead", "size")))]
            kept = {c: rows_of(batch, c) for c in ("row", "doc_id", "number")}
            return kept | {"own": own, "trunk": trunks, "exits": exits}

        return columns

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number")
        parts = [
            (list(t), {tuple(map(int, x["end"])): (tuple(map(int, x["start"])), list(x["ids"])) for x in ways})
            for t, ways in zip(group["trunk"], group["exits"])
        ]
        doc = group["doc_id"].iloc[0]
        return finish(None if pd.isna(doc) else int(doc), "".join(group["own"])[1:], joined(parts))

    # dealt by chunk: one giant text occupies as many tasks as it has chunks
    cut_kinds = "row long, doc_id long, number int, lead int, size int, s string"
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    pieces = stage(numbered.mapInArrow(cut, cut_kinds).repartition("row", "number"))
    m_schema = pa.schema([("row", pa.int64()), ("number", pa.int32()), ("m", pa.binary())])
    made = pieces.mapInArrow(per_batch(matrices, m_schema), "row long, number int, m binary")
    entry = made.groupBy("row").applyInPandas(scanned, "row long, number int, entry binary")
    way = pa.struct([("end", _IDS), ("start", _IDS), ("ids", _IDS)])
    t_schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("number", pa.int32()), ("own", pa.string()), ("trunk", _IDS),
        ("exits", pa.list_(way)),
    ])
    ways = pieces.join(entry, ["row", "number"]).mapInArrow(
        per_batch(traced, t_schema),
        "row long, doc_id long, number int, own string, trunk array<int>, "
        "exits array<struct<end: array<int>, start: array<int>, ids: array<int>>>",
    )
    return ways.groupBy("row").applyInPandas(whole, kinds)


def _told_apart(docs: DataFrame, scan: Scan, text: str, id_column: str) -> tuple[DataFrame, DataFrame]:
    """doc_id and text of the short texts and of the giant ones."""
    rows = docs.select(
        column(id_column).cast("long").alias("doc_id"),
        F.coalesce(column(text).cast("string"), F.lit("")).alias("text"),
    )
    giant = F.length("text") >= scan.chunk
    return rows.filter(~giant), rows.filter(giant)


def _each(docs: DataFrame, scan: Scan, text: str, id_column: str, schema: pa.Schema, kinds: str, of) -> DataFrame:
    """The columns of ``schema`` that ``of(doc_id, text, ids)`` gives for each row, by name."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(scan)
        for batch in batches:
            out, held = [], 0
            for doc, t in zip(batch.column(0), batch.column(1)):
                t = t.as_py()
                out.append(of(doc.as_py(), t, known.encode(t)))
                held += len(t)
                if held >= _AT_A_TIME:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    short, giant = _told_apart(docs, scan, text, id_column)
    finish = lambda *row: pd.DataFrame({k: pd.Series([x], dtype=object) for k, x in of(*row).items()})
    return short.mapInArrow(made, kinds).unionByName(_long(giant, scan, finish, kinds))


def encode(docs: DataFrame, scan: Scan = Scan(), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, text (a null one empty) and ids of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ids", _IDS)])
    of = lambda doc, t, ids: {"doc_id": doc, "text": t, "ids": np.array(ids, np.int32)}
    return _each(docs, scan, text, id_column, schema, "doc_id long, text string, ids array<int>", of)


def decode(pieces: DataFrame, scan: Scan = Scan(), ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``pieces`` with the text of its column ``ids``."""
    def of(lists: pd.Series) -> pd.Series:
        known = vocabulary(scan)
        return lists.map(lambda x: None if x is None else known.decode(x))

    return pieces.withColumn(text, F.pandas_udf(of, StringType())(column(ids)))


def digests(docs: DataFrame, scan: Scan = Scan(), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_pieces, ids_crc32 (unsigned 32-bit ids, little-endian), decodes (whether
    the pieces decode to the text), the ids and the decoded text."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decodes", pa.bool_()),
        ("ids", _IDS), ("decoded", pa.string()),
    ])

    def of(doc, t, ids):
        back, ids = vocabulary(scan).decode(ids), np.array(ids, "<u4")
        return {
            "doc_id": doc, "n_pieces": len(ids), "ids_crc32": zlib.crc32(ids.tobytes()), "decodes": back == t,
            "ids": ids.astype(np.int32), "decoded": back,
        }

    kinds = "doc_id long, n_pieces long, ids_crc32 long, decodes boolean, ids array<int>, decoded string"
    return _each(docs, scan, text, id_column, schema, kinds, of)
