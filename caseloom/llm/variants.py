"""Spelling variants of words by asymmetric q-chunks.

Two words are near if one code point inserted, deleted or replaced turns one into the other. The shorter word (either one,
if they are equally long) contributes two disjoint chunks, its halves; the other one contributes grams of the same lengths.
One edit leaves one half whole, at its place or, behind an inserted code point, shifted by one, so near words always share
a chunk and a gram within shift one; grams that no shift of at most one brings to a chunk are not emitted. The half that
holds the edit is chunked once more by the same rule: one of its halves is whole as well. So what is joined is the word
without one of its four quarters, together with the quarter and the length, and the other word without that quarter
(equally long) or without the quarter and one more code point (longer by one). All pairs found are verified by their
edit distance.

A chunk that more than ``HOT`` words share is halved down to single code points at once: the words are joined by what is
left without one code point of the quarter, which no more words share than the alphabet has letters. So no pair is left out
and no group is ever joined with itself whole.

Every word's *form* is its near word of largest count, if that is at least ``RATIO`` times its own; its *root* is where the
forms lead. Counts grow by that ratio with every step, so pointers are doubled a handful of times.

Defined cases: a missing text has no words, a missing document id counts as the empty text; repeated rows count again; an
empty table gives no rows; words without a near word have ``n_near`` 0 and are their own root. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.plans.lineage import stored

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST = 7
LEAST = 2      # occurrences of a word
RATIO = 10
HOT = 1000     # words that share a chunk


def letter_runs(docs: DataFrame, shortest: int = SHORTEST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``id, run``: every maximal run of at least ``shortest`` letters of every text, A to Z in lower case."""
    found = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"({LETTERS}{{{shortest},}})"), F.lit(1))
    return docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run")).select(
        "id", F.translate("run", UPPER, LOWER).alias("run"))


def without(word: Column, start: Column, n: Column) -> Column:
    """The word without ``n`` code points from a 0-based place on."""
    return F.concat(F.substr(word, F.lit(1), start), F.substr(word, start + n + 1))


def counted(words: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``word, n`` of all words that are long and frequent enough."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(
        F.col("n") >= least)


def edges(length: Column) -> list[Column]:
    """Where the four quarters of a word begin, and its end."""
    half = F.floor(length / 2)
    return [F.lit(0), F.floor(half / 2), half, half + F.floor((length - half) / 2), length]


def keyed(words: DataFrame, longer: int) -> DataFrame:
    """``word, n, quarter, start, size, at``: each word without each of its quarters (``longer`` 0), or as the word that
    is one code point longer than the one whose chunks it is to meet (1)."""
    length = F.length("word") - longer
    marks = edges(length)
    parts = F.explode(F.array(*(F.struct(F.lit(q).alias("quarter"), marks[q].cast("int").alias("start"),
                                         (marks[q + 1] - marks[q]).cast("int").alias("size")) for q in range(4))))
    rest = without(F.col("word"), F.col("p.start"), F.col("p.size") + longer)
    return words.select("word", "n", parts.alias("p")).select(
        "word", "n", "p.*", F.xxhash64(F.col("p.quarter"), F.length("word") - longer, rest).alias("at"))


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """``a, na, b, nb``: every pair of near words of a stored table ``word, n``, once."""
    own, more = keyed(words, 0), keyed(words, 1)
    sizes = own.select("at").union(more.select("at")).groupBy("at").agg(F.count("*").alias("m")).where(F.col("m") > hot)
    crowded = stored(sizes.select("at"))
    none = crowded.isEmpty()

    def light(rows: DataFrame) -> DataFrame:
        return (rows if none else rows.join(crowded, "at", "left_anti")).select("at", "word", "n")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.toDF("at", "a", "na").join(right.toDF("at", "b", "nb"), "at").where(
            (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")

    found = met(light(own), light(own)).where("a < b").union(met(light(own), light(more)))
    if not none:
        def single(rows: DataFrame, longer: int) -> DataFrame:
            """Words of crowded chunks without one code point of the quarter."""
            places = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1 + longer))
            there = rows.where(F.col("size") + longer > 0).join(crowded, "at", "left_semi").select("word", "n", "at", places.alias("p"))
            return there.select(F.xxhash64("at", "p", without(F.col("word"), F.col("p"), F.lit(1))).alias("at"), "word", "n")

        replaced = met(single(own, 0), single(own, 0)).where("a < b")
        # the longer word without one code point of the stretch is the shorter one
        cut = more.join(crowded, "at", "left_semi").select("word", "n", F.explode(F.sequence(
            F.col("start"), F.col("start") + F.col("size"))).alias("p")).select(
            without(F.col("word"), F.col("p"), F.lit(1)).alias("a"), F.col("word").alias("b"), F.col("n").alias("nb"))
        inserted = cut.join(words.toDF("a", "na"), "a").select("a", "na", "b", "nb")
        found = found.union(replaced).union(inserted)
    return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of a table ``word, form`` without cycles, by doubling pointers."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        up = at.toDF("root", "above")
        moved = stored(at.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"),
                                                          F.col("above").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table ``word, n`` of distinct words."""
    words = stored(words.select("word", "n"))
    pairs = stored(near_pairs(words, hot))
    both = pairs.union(pairs.select("b", "nb", "a", "na"))
    best = F.min(F.struct((-F.col("nb")).alias("minus"), F.col("b").alias("form")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("best.minus") >= ratio * F.col("n"), F.col("best.form")).alias("form"),
        F.when(-F.col("best.minus") >= ratio * F.col("n"), -F.col("best.minus")).alias("form_n")))
    found = roots(joined.where("form IS NOT NULL"))
    return joined.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
