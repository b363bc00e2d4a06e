"""Quality classifier learned from trusted positives and unlabelled text.

Non-negative PU learning: with prior p, the risk of calling unlabelled text bad is corrected by
p times the same risk on trusted positives; where the corrected part would fall below zero, the
step goes the other way, so the model cannot win by declaring every positive unlike itself.
The score is a logistic function of some twenty measures of the whole text (shares of kinds of
characters, word and line lengths, repetition) and their squares.

Every document is measured once, into a staged table. All documents, labelled or not, are the
unlabelled set, as they are what is scored; labels of training rows are withheld there. Mean, spread,
prior and the risk with its first and second derivatives are sums over all of them, made on Spark and
renewed every ``Training.refresh`` steps; in between the risk is taken on as a quadratic. The positives
among the labelled training rows are trusted, at most ``Training.sample`` of them (those with the
smallest hash); other labels are not used. The prior is estimated from the two sets.

Null texts count as empty; empty texts have all measures zero and get a score like any other. A
document without label is scored only; several labels of one document count once, by their
mean. Without any training positives every score is the prior's starting value. Repeated rows are
scored each on its own; an empty table gives no rows. Row ids, languages, sources and labels are
no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.frames import column, rows_of, spare_name, texts_of
from riskloom.plans.staging import stage

MEASURES = (
    "log_words", "log_chars", "chars_per_word", "word_spread", "long_words", "one_char_words", "distinct_words",
    "letters", "capitals", "digits", "marks", "symbols", "letterless", "stops", "commas",
    "log_words_per_line", "distinct_lines", "adjacent_repeats", "top_word", "distinct_pairs", "empty",
)
_LETTERS, _CAPITALS = re.compile(r"[^\W\d_]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_DIGITS, _SYMBOLS = re.compile(r"[0-9]+"), re.compile(r"[#*$%&|<>{}\\^~=_@]+")
_MARKS = re.compile(r"[!-/:-@\[-`{-~]+")
_LETTERLESS = re.compile(r"(?:(?<=\s)|^)[!-@\[-`{-~]+(?=\s|$)")


def _covered(expression: re.Pattern, text: str) -> int:
    return sum(map(len, expression.findall(text)))


def measures(text: str) -> list[float]:
    """The values of MEASURES for one text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(MEASURES) - 1) + [1.0]
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = int(lengths.sum())
    index: dict[str, int] = {}
    ids = np.fromiter(map(index.setdefault, words, range(n)), np.int64, n)  # each word's first place
    counts = np.bincount(ids)
    pairs = np.unique(ids[1:] * n + ids[:-1])
    lines = [x for x in text.split("\n") if x.strip()]
    letters = _covered(_LETTERS, text)
    return [
        float(np.log(n)), float(np.log(chars)), chars / n, float(lengths.std()), float((lengths > 15).mean()),
        float((lengths == 1).mean()), len(index) / n ** 0.8,
        letters / chars, _covered(_CAPITALS, text) / max(1, letters),
        _covered(_DIGITS, text) / chars, _covered(_MARKS, text) / chars, _covered(_SYMBOLS, text) / chars,
        len(_LETTERLESS.findall(text)) / n, (text.count(".") + text.count("?") + text.count("!")) / n,
        text.count(",") / n, float(np.log(n / len(lines))), len(set(lines)) / len(lines),
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, float(counts.max()) / n,
        len(pairs) / max(1, n - 1), 0.0,
    ]


@dataclass(frozen=True)
class Training:
    #: trusted positives read at most; the bound of what the driver holds
    sample: int = 20_000
    folds: int = 5
    threshold: float = 0.3
    steps: int = 600
    #: steps from one pass over the unlabelled documents to the next
    refresh: int = 10
    rate: float = 0.05
    weight_decay: float = 1e-4
    prior_range: tuple[float, float] = (0.05, 0.95)


@dataclass(frozen=True)
class Model:
    prior: float
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last one is the constant

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.inputs(x) @ self.weights)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([z, z * z, np.ones((len(x), 1))])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _minimised(passed, good: np.ndarray, start: np.ndarray, decay: float) -> np.ndarray:
    """Weights that tell the trusted positives from the unlabelled rows, by damped Newton steps.
    ``passed(w)`` gives the mean over the unlabelled rows of the logistic loss of calling them
    bad, its gradient and its second derivatives."""
    kept = np.r_[np.ones(len(start) - 1), 0]

    def at(w):
        loss, slope, bend = passed(w)
        g = good @ w
        own = _sigmoid(g)
        value = loss + _softplus(-g).mean() + decay / 2 * float(kept @ (w * w))
        slope = slope - good.T @ (1 - own) / len(good) + decay * kept * w
        bend = bend + (good.T * (own * (1 - own))) @ good / len(good) + np.diag(decay * kept + 1e-9)
        return value, slope, bend

    w, length = start, 1.0
    value, slope, bend = at(w)
    for _ in range(20):  # passes over the unlabelled rows
        move = -np.linalg.lstsq(bend, slope, rcond=None)[0]
        if -slope @ move < 1e-5 or length < 1 / 64:
            break
        move = move * min(1.0, 5.0 / np.abs(move).max())
        there = w + length * move
        now = at(there)
        if now[0] < value:
            w, (value, slope, bend), length = there, now, min(1.0, 2 * length)
        else:
            length /= 2
    return w


def _descended(passed, good: np.ndarray, start: np.ndarray, prior: float, training: Training) -> np.ndarray:
    """Weights after ``training.steps`` steps of Adam on the non-negative PU risk. The unlabelled rows'
    part is ``passed(w)`` of ``_minimised`` with its second-order terms around the last of these
    passes, which come every ``training.refresh`` steps; the trusted positives' part is exact."""
    w, kept = start.copy(), np.r_[np.ones(len(start) - 1), 0]
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, training.steps + 1):
        if t % training.refresh == 1 or training.refresh == 1:
            here, (loss, slope, bend) = w.copy(), passed(w)
        off, g_good = w - here, good @ w
        turned = bend @ off
        as_bad = loss + slope @ off + off @ turned / 2 - prior * _softplus(g_good).mean()
        of_bad = slope + turned - prior * good.T @ _sigmoid(g_good) / len(good)
        of_good = -prior * good.T @ _sigmoid(-g_good) / len(good)
        grad = (of_good + of_bad if as_bad >= 0 else -of_bad) + training.weight_decay * kept * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w = w - training.rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def _bends(model: Model, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows: count, loss, gradient and second derivatives, in one array."""
    z = model.inputs(x)
    g = z @ w
    p = _sigmoid(g)
    return np.r_[len(x), _softplus(g).sum(), z.T @ p, ((z.T * (p * (1 - p))) @ z).ravel()]


def _means(total: np.ndarray, width: int):
    n = max(1.0, total[0])
    return total[1] / n, total[2 : 2 + width] / n, total[2 + width :].reshape(width, width) / n


def _start(prior: float) -> np.ndarray:
    return np.r_[np.zeros(2 * len(MEASURES)), np.log(prior / (1 - prior))]


def learn(x: np.ndarray, y: np.ndarray, training: Training = Training()) -> Model:
    """The same on rows in memory that serve as unlabelled ones too; ``y``: 1 marks the trusted
    positives, whose share is the prior."""
    prior = float(np.clip(y.mean() if len(y) else 0.5, *training.prior_range))
    width = len(MEASURES)
    mean = x.mean(axis=0) if len(x) else np.zeros(width)
    spread = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(width)
    model = Model(prior, mean, spread, _start(prior))
    if not (y == 1).any():
        return model
    passed = lambda w: _means(_bends(model, x, w), len(w))
    w = _descended(passed, model.inputs(x[y == 1]), model.weights, prior, training)
    return Model(prior, mean, spread, w)


def _added(rows: DataFrame, of) -> np.ndarray:
    """The sum of ``of(x)`` over blocks of ``rows``, added in the order of partitions."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                part = of(values.reshape(-1, len(MEASURES)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "v": [total.astype("<f8").tobytes()],
            })

    parts = sorted(rows.select("x").mapInArrow(run, "part int, v binary").collect())
    return sum(np.frombuffer(bytes(r.v), "<f8") for r in parts) if parts else np.zeros(0)


def _prior(rows: DataFrame, n: int, good: np.ndarray, model: Model, training: Training) -> float:
    """The share of positives among the unlabelled rows: least ratio of the shares of unlabelled
    and of trusted rows above a score that tells one from the other, learned on every second
    trusted row and read off the rest; scores reached by few rows are held back by their error."""
    if len(good) < 4:
        return 0.5
    width = 2 * len(MEASURES) + 1
    passed = lambda w: _means(_added(rows, lambda x: _bends(model, x, w)), width)
    w = _minimised(passed, model.inputs(good[::2]), np.zeros(width), 1e-3)
    own = np.sort(model.inputs(good[1::2]) @ w)
    cuts = np.unique(np.quantile(own, np.linspace(0, 1, 201)[:-1], method="lower"))
    above = lambda s: len(s) - np.searchsorted(np.sort(s), cuts)
    q_good = above(own) / len(own)
    q_all = _added(rows, lambda x: above(model.inputs(x) @ w).astype(float)) / n
    error = np.sqrt(np.log(40) / 2 / n) + np.sqrt(np.log(40) / 2 / len(own))
    at = int(np.argmin((q_all + 1.01 * error) / q_good))
    return float(np.clip(q_all[at] / q_good[at], *training.prior_range))


def held_out(id_, folds: int):
    """The rows whose labels are never learned from: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == 0, F.lit(False))


#: texts that a task holds as Python strings at once
_TEXTS = 256
_MEASURED = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float64()))])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and measures of rows (id, text), so many at a time that a task never holds a whole batch as strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, _TEXTS):
            part = batch.slice(at, _TEXTS)
            yield pa.RecordBatch.from_pydict({
                "id": rows_of(part, "id"), "x": [measures(t) for t in texts_of(part, "text")],
            }, schema=_MEASURED)


def measured(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Staged: id and x, the measures, of every row."""
    texts = docs.select(column(id_column).cast("long").alias("id"), column(text).alias("text"))
    return stage(texts.mapInArrow(_measured, "id long, x array<double>"))


def fit(
    rows: DataFrame, labels: DataFrame, training: Training = Training(), id_column: str = "doc_id",
    label: str = "quality",
) -> Model:
    """A model from the documents of ``measured`` and the training rows of ``labels``."""
    known = labels.select(column(id_column).cast("long").alias("id"), column(label).alias("y")).filter(
        "id is not null and y is not null"
    )
    known = stage(known.filter(~held_out(F.col("id"), training.folds)).groupBy("id").agg(
        (F.avg("y") >= 0.5).cast("double").alias("y")
    ))
    sample = stage(known.filter("y = 1").orderBy(F.xxhash64("id"), "id").limit(training.sample))
    read = rows.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("x").alias("x"))
    good = np.array([r.x for r in sorted(read.collect())], float).reshape(-1, len(MEASURES))
    # in a fixed order, so that sums and with them scores come out the same each time
    free = stage(rows.coalesce(1024).sortWithinPartitions("id", "x"))
    width = len(MEASURES)
    total = _added(free, lambda x: np.r_[len(x), x.sum(axis=0)])
    if not len(good) or not len(total):
        return Model(0.5, np.zeros(width), np.ones(width), _start(0.5))
    n, mean = total[0], total[1:] / total[0]
    spread = np.maximum(np.sqrt(_added(free, lambda x: ((x - mean) ** 2).sum(axis=0)) / n), 1e-3)
    model = Model(0.5, mean, spread, _start(0.5))
    prior = _prior(free, int(n), good, model, training)
    passed = lambda w: _means(_added(free, lambda x: _bends(model, x, w)), 2 * width + 1)
    w = _descended(passed, model.inputs(good), _start(prior), prior, training)
    return Model(prior, mean, spread, w)


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the column ``score``."""

    def of(texts: pa.Array) -> pa.Array:
        done = [np.empty(0)]
        for at in range(0, len(texts), _TEXTS):
            x = [measures(t or "") for t in texts.slice(at, _TEXTS).to_pylist()]
            done.append(model.score(np.array(x, float)))
        return pa.array(np.concatenate(done))

    return docs.withColumn(score, F.arrow_udf(of, "double")(column(text)))


def classify(
    docs: DataFrame, labels: DataFrame, training: Training = Training(), text: str = "text",
    id_column: str = "doc_id", label: str = "quality",
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = measured(docs, text, id_column)
    model = fit(rows, labels, training, id_column, label)

    def of(x: pa.Array) -> pa.Array:
        return pa.array(model.score(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES))))

    return rows.select(F.col("id").alias("doc_id"), F.arrow_udf(of, "double")("x").alias("score")).select(
        "doc_id", held_out(F.col("doc_id"), training.folds).alias("held_out"), "score",
        (F.col("score") >= training.threshold).cast("int").alias("predicted"),
    )


def accepted(
    docs: DataFrame, labels: DataFrame, training: Training = Training(), text: str = "text",
    id_column: str = "doc_id", label: str = "quality",
) -> DataFrame:
    """The rows of ``docs`` that the model holds to be good, all columns."""
    score = spare_name(docs, "score")
    done = scored(docs, fit(measured(docs, text, id_column), labels, training, id_column, label), text, score)
    return done.filter(column(score) >= training.threshold).drop(column(score))
