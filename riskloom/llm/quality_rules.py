"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes for (1) or against (-1) a document or abstains (0). The votes of all documents
are counted by pattern: nine rules have at most 3^9 = 19,683 patterns, whatever the table's
size. Expectation-maximisation over these counts estimates how common good documents are and,
for each rule, how often its votes are right on good and on bad documents; a document stays if
its posterior probability of being good reaches the threshold and it passes the base rules.

A null text counts as empty. Empty texts have no words and fail the base rules. Repeated rows
are judged each on its own; an empty table gives an empty result. Windows of three words are
compared by their 64-bit hash within one text (one chance in 10^11 of a false match in a text
of 20,000 words). Other columns pass through untouched: measures live in one struct column
whose name is chosen so that it clashes with none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.frames import column, spare_name
from riskloom.plans.staging import stage

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Votes -1 where ``value`` lies outside ``bad``, 1 inside ``good``, else abstains.
    Bounds are inclusive."""

    name: str
    value: str
    good: tuple[float, float]
    bad: tuple[float, float]

    def vote(self, measures: Column) -> Column:
        x = measures[self.value]
        outside = (x < F.lit(self.bad[0])) | (x > F.lit(self.bad[1]))
        return (
            F.when(outside, -1).when(x.between(*map(F.lit, self.good)), 1).otherwise(0).cast("int")
        )


INF = float("inf")
RULES = (
    Rule("length", "n_words", (60.0, INF), (50.0, INF)),
    Rule("word_length", "chars_per_word", (2.5, 9.0), (1.8, 13.0)),
    Rule("symbols", "symbols_per_word", (0.0, 0.06), (0.0, 0.25)),
    Rule("marks", "marks_per_char", (0.0, 0.12), (0.0, 0.25)),
    Rule("letters", "letterless_share", (0.0, 0.1), (0.0, 0.3)),
    Rule("capitals", "capitals_per_char", (0.0, 0.12), (0.0, 0.35)),
    Rule("repeats", "repeat_share", (0.0, 0.25), (0.0, 0.5)),
    Rule("lines", "dup_line_share", (0.0, 0.25), (0.0, 0.5)),
    Rule("sentences", "stops_per_word", (0.01, 0.5), (0.002, 1.2)),
)


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    threshold: float = 0.5
    rounds: int = 30
    #: how often votes are right before the first round: rules seldom speak against good
    #: documents, and a bad document offends some of the rules only
    start_good: float = 0.97
    start_bad: float = 0.3
    #: a vote never tells less than these, which keeps "good" and "bad" apart
    good_range: tuple[float, float] = (0.8, 0.999)
    bad_range: tuple[float, float] = (0.02, 0.999)
    prior_range: tuple[float, float] = (0.02, 0.98)
    smoothing: float = 1.0


@dataclass(frozen=True)
class Fitted:
    """Share of good documents; by rule, the share of right votes on good and on bad ones."""

    prior: float
    good: dict[str, float]
    bad: dict[str, float]


def measured(docs: DataFrame, text: str, into: str) -> DataFrame:
    """``docs`` with a struct column ``into`` of counts and ratios over the whole text."""
    names = [spare_name(docs, f"{into}_{k}") for k in ("text", "words", "lines", "grams", "places")]
    whole, words, lines, grams, places = map(column, names)
    kept = [column(c) for c in docs.columns]
    with_text = docs.select(*kept, F.coalesce(column(text), F.lit("")).alias(names[0]))
    with_words = with_text.select(
        *kept, whole, F.array_remove(F.split(whole, BLANKS), "").alias(names[1]),
        F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(names[2]),
    )
    n = F.size(words)
    with_grams = with_words.select(
        *kept, whole, words, lines,
        F.when(
            n >= 3,
            F.sort_array(F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i")),
            )),
        ).alias(names[3]),
    )
    same = lambda g, k: (g["h"] == F.get(grams, k - 1)["h"]) | (g["h"] == F.get(grams, k + 1)["h"])
    with_places = with_grams.select(
        *kept, whole, words, lines,
        F.sort_array(F.transform(
            F.filter(grams, lambda g, k: F.coalesce(same(g, k), F.lit(False))), lambda g: g["i"]
        )).alias(names[4]),
    )
    # words covered: a window starting at i adds what the windows before it have not covered
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(
            (i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n")
        ),
        lambda a: a["n"],
    )
    n_words, n_lines = n.cast("long"), F.size(lines).cast("long")
    # exploding an array of one keeps the optimizer from repeating the counts in each later use
    counts = with_places.select(*kept, F.explode(F.array(F.struct(
        n_words.alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        n_lines.alias("n_lines"),
        (n_lines - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(whole, F.lit(r"[.?!]")).cast("long").alias("n_stops"),
        F.regexp_count(whole, F.lit(r"[^\p{L}\s]")).cast("long").alias("n_marks"),
        F.regexp_count(whole, F.lit(r"(?<!\S)[^\p{L}\s]+(?!\S)")).cast("long").alias("n_letterless"),
    ))).alias(into))
    m = column(into)
    share = lambda a, b: F.coalesce(F.try_divide(m[a].cast("double"), m[b].cast("double")), F.lit(0.0))
    ratios = {
        "chars_per_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
        "capitals_per_char": ("n_capitals", "word_chars"), "repeat_share": ("n_repeat_words", "n_words"),
        "dup_line_share": ("n_dup_lines", "n_lines"), "stops_per_word": ("n_stops", "n_words"),
        "marks_per_char": ("n_marks", "word_chars"), "letterless_share": ("n_letterless", "n_words"),
    }
    return counts.withColumn(into, _with(m, {k: share(*of) for k, of in ratios.items()}))


def _with(record: Column, fields: dict[str, Column]) -> Column:
    for name, value in fields.items():
        record = record.withField(name, value)
    return record


def base_failed(measures: Column, limits: Limits) -> Column:
    return (measures["n_words"] < limits.min_words) | (
        100 * measures["n_repeat_words"] > limits.max_repeat_percent * measures["n_words"]
    )


def votes(measures: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.struct(*[r.vote(measures).alias(r.name) for r in rules])


def posterior(pattern: Column, fitted: Fitted, rules: tuple[Rule, ...] = RULES) -> Column:
    """Probability of a good document: prior odds times the odds of each vote."""
    score = F.lit(math.log(fitted.prior / (1 - fitted.prior)))
    for r in rules:
        good, bad = fitted.good[r.name], fitted.bad[r.name]
        score = score + (
            F.when(pattern[r.name] == 1, math.log(good / (1 - bad)))
            .when(pattern[r.name] == -1, math.log((1 - good) / bad)).otherwise(0.0)
        )
    return 1 / (1 + F.exp(-score))


def fit(patterns: DataFrame, limits: Limits = Limits(), rules: tuple[Rule, ...] = RULES) -> Fitted:
    """Expectation-maximisation over ``patterns`` (a struct ``votes`` and a count ``n``, one row
    per pattern). Each round is one aggregation to a single row."""
    fitted = Fitted(0.5, {r.name: limits.start_good for r in rules}, {r.name: limits.start_bad for r in rules})
    clip = lambda x, low, high: min(max(x, low), high)
    s = limits.smoothing
    for _ in range(limits.rounds):
        q, n = posterior(F.col("votes"), fitted, rules), F.col("n").cast("double")
        sums = [F.sum(n).alias("n_"), F.sum(n * q).alias("good_")]
        for k, r in enumerate(rules):
            for sign, name in ((1, "for"), (-1, "against")):
                cast = F.when(F.col("votes")[r.name] == sign, n).otherwise(0.0)
                sums += [F.sum(cast * q).alias(f"{name}_good_{k}"), F.sum(cast * (1 - q)).alias(f"{name}_bad_{k}")]
        got = patterns.agg(*sums).first()
        if not got["n_"]:
            return fitted
        rate = lambda right, wrong, start: (got[right] + s * start) / (got[right] + got[wrong] + s)
        new = Fitted(
            clip(got["good_"] / got["n_"], *limits.prior_range),
            {r.name: clip(rate(f"for_good_{k}", f"against_good_{k}", limits.start_good), *limits.good_range)
             for k, r in enumerate(rules)},
            {r.name: clip(rate(f"against_bad_{k}", f"for_bad_{k}", limits.start_bad), *limits.bad_range)
             for k, r in enumerate(rules)},
        )
        moved = max(abs(a - b) for a, b in zip(
            [new.prior, *new.good.values(), *new.bad.values()],
            [fitted.prior, *fitted.good.values(), *fitted.bad.values()],
        ))
        fitted = new
        if moved < 1e-6:
            break
    return fitted


def counted_patterns(measures: DataFrame, into: str, limits: Limits, rules: tuple[Rule, ...]) -> DataFrame:
    """Vote patterns of the documents that pass the base rules, in one small sorted partition."""
    ours = measures.filter(~base_failed(column(into), limits))
    counted = ours.groupBy(votes(column(into), rules).alias("votes")).agg(F.count(F.lit(1)).alias("n"))
    return stage(counted.coalesce(1).sortWithinPartitions("votes"))


def judged(measures: DataFrame, into: str, fitted: Fitted, limits: Limits, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds to the struct ``into``: base_failed, p_good and kept."""
    m = column(into)
    failed, p = base_failed(m, limits), posterior(votes(m, rules), fitted, rules)
    kept = ~failed & (p >= limits.threshold)
    return measures.withColumn(into, _with(m, {"base_failed": failed, "p_good": p, "kept": kept}))


def quality(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    limits: Limits = Limits(), rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per document: the columns ``keep`` and the struct ``quality``.

    The measures, a few numbers per document, are staged, so that texts are read once."""
    narrow = stage(measured(docs.select(*map(column, dict.fromkeys([*keep, text]))), text, "quality")
                   .select(*map(column, keep), "quality"))
    fitted = fit(counted_patterns(narrow, "quality", limits, rules), limits, rules)
    return judged(narrow, "quality", fitted, limits, rules)


def good_documents(
    docs: DataFrame, text: str = "text", limits: Limits = Limits(), rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Texts are measured twice, for the fit and for
    the verdict, which needs no join of the texts."""
    into = spare_name(docs, "quality")
    narrow = measured(docs.select(column(text)), text, "quality")
    fitted = fit(counted_patterns(narrow, "quality", limits, rules), limits, rules)
    done = judged(measured(docs, text, into), into, fitted, limits, rules)
    return done.filter(column(into)["kept"]).drop(column(into))
