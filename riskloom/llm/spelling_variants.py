"""Grouping of spelling variants with permuterm rotations.

Words are the maximal runs of letters of all texts, A-Z lower-cased; a fixed one in 97 of all (document, run)
pairs, chosen by checksum, loses one letter first. Words that are long and frequent enough enter the index.

Two words are near if one inserted, deleted or replaced letter tells them apart. Each word, marked with a
terminator, is rotated in all ways. A word that reads *a c b*, where c is one letter, has the rotation *b$a* + c: the
words that replace c share its prefix *b$a*, one letter follows, and the word *ab* without c has *b$a* itself as
a rotation. So each rotation is posted under itself and under its prefix without the last letter, and the
words sorted under one such key are all near each other. A key fixes all but one letter, hence holds at most
one word for each letter of the alphabet and one more, whatever the data: no group grows with the input.
Groups are scanned in order of frequency: every member's best neighbour there is the first, or the second for the
first itself. A pair that replaces a letter meets under one key only; one that drops a letter of a
run, as in *aab* and *ab*, meets once for each letter of the run and counts under the key of the run's first letter. So no pairs are
emitted, one row for each posting at most. Everything is DataFrame functions.

Null texts hold no words, a null id counts as an empty one, whole texts are read however long, and repeated rows count
each. The form of a word is its near word with the largest count (ties: first in code-point order) if that
count is ``ratio`` times its own at least; counts so grow along forms, chains are at most as long as the
logarithm of the row count, and roots come by doubling steps. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.frames import column
from riskloom.plans.staging import stage

#: letters of words, as a class of regular expressions
LETTERS = r"A-Za-zÀ-ÿ"
#: no letter, so it marks where a word ends
END = "$"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Variants:
    min_letters: int = 5
    min_count: int = 3
    ratio: int = 2
    #: one in so many (document, run) pairs loses a letter
    damaged: int = 97


def words(docs: DataFrame, limits: Variants = Variants(), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """word and n of all words that are long and frequent enough."""
    runs = docs.select(
        F.coalesce(column(id_column).cast("string"), F.lit("")).alias("id"),
        # a run is maximal, so shorter ones never match; losing a letter makes none longer
        F.explode(F.regexp_extract_all(column(text), F.lit(f"[{LETTERS}]{{{limits.min_letters},}}"), F.lit(0))).alias("run"),
    ).select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    found = runs.select(F.when(h % limits.damaged == 0, cut).otherwise(F.col("run")).alias("word"))
    return (
        found.filter(F.length("word") >= limits.min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= limits.min_count)
    )


def postings(counted: DataFrame) -> DataFrame:
    """key, word, n and the letter left out (null: the rotation itself), for every rotation of every word."""
    place = F.col("at")
    split = counted.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    before, after = F.substring("word", F.lit(1), place), F.substring(F.col("word"), place + 1, F.length("word"))
    rest = F.substring(F.col("word"), place + 2, F.length("word"))
    letter = F.substring(F.col("word"), place + 1, F.lit(1))
    last = F.col("at") == F.length("word")
    ways = F.array(
        F.struct(F.concat(after, F.lit(END), before).alias("key"), F.lit(None).cast("string").alias("letter")),
        F.struct(F.when(~last, F.concat(rest, F.lit(END), before)).alias("key"), letter.alias("letter")),
    )
    return split.select("word", "n", F.explode(ways).alias("way")).select("way.key", "word", "n", "way.letter").filter(
        F.col("key").isNotNull()
    )


def _first_of_run(key: Column, letter: Column) -> Column:
    """Whether the letter before the left-out one, the key's last, is another one."""
    return ~F.endswith(key, letter)


def neighbours(counted: DataFrame) -> DataFrame:
    """word, n_near and best (n, word of the near word with the largest count) of words that have any."""
    whole = Window.partitionBy("key")
    order = whole.orderBy(F.desc("n"), "word")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ext = F.col("letter").isNotNull()
    counted_drop = ext & _first_of_run(F.col("key"), F.col("letter"))
    other = F.struct("n", "word")
    scanned = postings(counted).select(
        "key", "word", "n", "letter",
        F.count(F.lit(1)).over(whole).alias("members"),
        F.count(F.when(ext, 1)).over(whole).alias("longer"),
        F.count(F.when(counted_drop, 1)).over(whole).alias("drops"),
        F.row_number().over(order).alias("place"),
        F.nth_value(other, 1).over(everything).alias("first"), F.nth_value(other, 2).over(everything).alias("second"),
    ).filter("members > 1")
    near = F.when(ext, F.col("longer") - 1 + F.when(counted_drop, F.col("members") - F.col("longer")).otherwise(0))
    return scanned.select(
        "word", near.otherwise(F.col("drops")).alias("near"),
        F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("first")).alias("best"),
    ).groupBy("word").agg(
        F.sum("near").alias("n_near"),
        # the largest count; among equals the first word
        F.min(F.struct((-F.col("best.n")).alias("minus"), F.col("best.word").alias("word"))).alias("best"),
    )


def _roots(forms: DataFrame) -> DataFrame:
    """word and the last word along its forms, for words with a form (columns word, form)."""
    ahead = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = ahead.join(step, "root", "left")
        if moved.filter(F.col("further").isNotNull()).isEmpty():
            return ahead
        ahead = stage(moved.select("word", F.coalesce("further", "root").alias("root")))


def variants(
    docs: DataFrame, limits: Variants = Variants(), text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    counted = stage(words(docs, limits, text, id_column))
    good = F.col("best.minus") * -1 >= limits.ratio * F.col("n")
    known = stage(counted.join(neighbours(counted), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n"),
    ))
    roots = _roots(known.filter(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
