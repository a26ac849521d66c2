"""Language identification by prediction with partial matching.

For every language a tree of byte contexts of up to ``ORDER`` bytes is counted on sample texts and then frozen. A byte is
coded in the longest context the tree has: with the share of its count if it was seen there, else an escape is coded and
the next shorter context is asked, down to a uniform code of 8 bits (escape probabilities by method C: distinct over
total plus distinct). Contexts lie inside a word (a run of letters in lower case between two marks), so the exact code
length of a text is the sum over its words, and each distinct word is coded once per cache. The language with the
shortest code wins; the score is its share of the probability over all languages.

Defined cases: a missing text and a text without a letter give ``und`` with score 0, and so does everything when there
are no labelled texts; ties go to the first language by name; rows that repeat get the same answer; an empty table gives
no rows. Other columns are kept; a column of an output's name is replaced.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = 4
SAMPLE_TEXTS = 250        # per language, at most
SAMPLE_CHARS = 600_000  # per language, at most; texts longer than that are not taken into the sample
CACHED_WORDS = 120_000
CACHED_GRAMS = 200_000
UNKNOWN = "und"
MARK = b" "
LETTERS = re.compile(r"[^\W\d_]+").findall


def sample(labelled: DataFrame, text: str = "text", lang: str = "lang", texts: int = SAMPLE_TEXTS,
           chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """A bounded sample of (language, whole text): of the distinct texts of a language those with the smallest hashes, up to
    both bounds, however many copies a text has. Only about twice the bound is sorted, whatever the size of a language."""
    size = F.length(text)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (size <= chars)).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    counts = rows.groupBy("lang").agg(F.countDistinct("h").alias("n"))
    near = rows.join(F.broadcast(counts), "lang").where(
        F.pmod("h", F.lit(1 << 40)) < F.lit(float(1 << 40)) * (2 * texts + 20) / F.col("n"))
    near = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "text")
    chosen = near.withColumn("k", F.row_number().over(order)).withColumn("c", F.sum(F.length("text")).over(
        order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("k") <= texts) & (F.col("c") <= chars))
    return [(r.lang, r.text) for r in chosen.select("lang", "text").collect()]


class Trees:
    """Frozen context trees: per language the bits of every symbol and of the escape in every context."""

    def __init__(self, texts: Iterable[tuple[str, str]], order: int = ORDER):
        self.order = order
        counts: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        for lang, text in sorted(texts):
            grams = counts[lang]
            for word in LETTERS(text.lower()):
                coded = MARK + word.encode("utf-8", "surrogatepass") + MARK
                for i in range(1, len(coded)):
                    for k in range(min(order, i) + 1):
                        grams[coded[i - k: i + 1]] += 1
        self.languages = sorted(counts)
        self.symbol: list[dict[bytes, float]] = []
        self.escape: list[dict[bytes, float]] = []
        for lang in self.languages:
            grams = counts[lang]
            total, distinct = defaultdict(int), defaultdict(int)
            for gram, n in grams.items():
                total[gram[:-1]] += n
                distinct[gram[:-1]] += 1
            self.symbol.append({g: math.log2((total[g[:-1]] + distinct[g[:-1]]) / n) for g, n in grams.items()})
            self.escape.append({c: math.log2((total[c] + distinct[c]) / distinct[c]) for c in total})

    def bits(self, gram: bytes) -> list[float]:
        """Code length of the last byte after the others, per language."""
        found = []
        for symbol, escape in zip(self.symbol, self.escape):
            bits = 0.0
            for k in range(len(gram)):
                part = gram[k:]
                if part in symbol:
                    bits += symbol[part]
                    break
                bits += escape.get(part[:-1], 0.0)
            else:
                bits += 8.0
            found.append(bits)
        return found

    def grams(self, word: str) -> list[bytes]:
        coded, order = MARK + word.encode("utf-8", "surrogatepass") + MARK, self.order
        return [coded[max(0, i - order): i + 1] for i in range(1, len(coded))]


class Numbers(dict):
    """Numbers given to keys as they come; ``new`` holds those without a row yet."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, key):
        self.new.append(key)
        self[key] = number = len(self)
        return number


class Rows:
    """Rows of numbers that more are added to; the room doubles when it is used up."""

    def __init__(self, width: int):
        self.n, self.room = 0, np.zeros((1024, width))

    def add(self, more: np.ndarray) -> None:
        while self.n + len(more) > len(self.room):
            self.room = np.concatenate([self.room, np.zeros_like(self.room)])
        self.room[self.n: self.n + len(more)] = more
        self.n += len(more)


class Scorer:
    """Code lengths of texts, with bounded caches of words and byte sequences."""

    def __init__(self, trees: Trees):
        self.trees = trees
        self.reset()

    def reset(self) -> None:
        width = len(self.trees.languages)
        self.words, self.grams = Numbers(), Numbers()
        self.word_bits, self.gram_bits = Rows(width), Rows(width)

    def learn(self) -> None:
        """Rows of the words that came since the last call."""
        if not self.words.new:
            return
        ids, ends = [], []
        for word in self.words.new:
            ids.extend(map(self.grams.__getitem__, self.trees.grams(word)))
            ends.append(len(ids))
        if self.grams.new:
            self.gram_bits.add(np.array([self.trees.bits(g) for g in self.grams.new]))
            self.grams.new = []
        starts = np.array([0, *ends[:-1]])
        self.word_bits.add(np.add.reduceat(self.gram_bits.room[ids], starts, axis=0))
        self.words.new = []

    def code_lengths(self, text: str) -> np.ndarray | None:
        """Bits per language; None for a text without a letter."""
        if len(self.words) > CACHED_WORDS or len(self.grams) > CACHED_GRAMS:
            self.reset()
        total, any_letter = np.zeros(len(self.trees.languages)), False
        words = LETTERS(text.lower())
        for at in range(0, len(words), CACHED_WORDS):
            part = words[at: at + CACHED_WORDS]
            any_letter = any_letter or any(c.isalpha() for w in part for c in w)
            numbers = np.fromiter(map(self.words.__getitem__, part), np.int64, len(part))
            self.learn()
            total += self.word_bits.room[numbers].sum(axis=0)
        return total if any_letter else None

    def predict(self, text: str | None) -> tuple[str, float]:
        bits = self.code_lengths(text) if text and self.trees.languages else None
        if bits is None:
            return UNKNOWN, 0.0
        best = int(np.argmin(bits))
        return self.trees.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def predict(df: DataFrame, trees: Trees, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the language of every whole text and its score."""
    sent = df.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    @F.pandas_udf("lang string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for texts in batches:
            yield pd.DataFrame([scorer.predict(t) for t in texts], columns=["lang", "score"])

    found = df.withColumn("__found", identify(F.col(text).cast("string")))
    return found.withColumn(lang, F.col("__found.lang")).withColumn(score, F.col("__found.score")).drop("__found")


def identify(df: DataFrame, learn_from: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows of ``learn_from`` that have a label, predict for all rows."""
    return predict(df, Trees(sample(df.where(learn_from), text, lang)), text)
