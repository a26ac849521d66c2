"""Byte pair encoding with forced boundaries, and decoding.

A merge can only join symbols that stand next to each other inside some vocabulary token. Two neighbouring symbols that
no token contains side by side are therefore a certain cut: whatever the merges do, no token spans it. Every word is
split at its certain cuts, the fragments are encoded independently and their ids are concatenated. A worker keeps the ids
of words it has seen; the fragments of all new words of some texts are merged together, one merge of each per step. Long words fall into short fragments, so a word of a million letters costs no more than its length.

Ids travel as one binary value per document, little-endian unsigned 32-bit. ``encode`` and ``decode`` add columns; they
need no shuffle, keep all other columns, and use memory for one Arrow batch and a bounded cache per worker.

Defined cases: a missing text encodes as the empty text (no ids); missing ids decode to the empty text; rows that repeat
are encoded alike; an empty table gives an empty table. An output column that already exists is replaced.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHED_WORDS = 100_000  # entries of one generation of a worker's word cache
CACHED_LENGTH = 64      # longer words are encoded without being kept

LONG_FRAGMENT = 200     # longer ones are merged one by one with a heap
GROUP_CHARS = 1_000_000 # of texts whose new words are encoded together
LATIN = 0x180           # texts of code points below, lower case included, are split by the standard library
BEYOND_LATIN = re.compile(f"[{chr(LATIN)}-\U0010ffff]").search
NEWER_FROM = 0x558      # the first code point on which versions of Unicode differ
BEYOND = re.compile(f"[{chr(NEWER_FROM)}-\U0010ffff]").search
BITS, MASK = 20, (1 << 20) - 1
NONE, CUT = 1 << 60, 1 << 61  # pairs without a merge; pairs that no token contains

# fixed values: the pattern that splits words, as in the vocabulary file
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class PairTable:
    """Numbers by pair of ids, looked up for whole arrays: open addressing with a fixed number of steps."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(10, (4 * len(pairs)).bit_length())
        size, self.steps = 1 << self.bits, 1
        self.keys, self.values = np.full(size + 64, -1, dtype=np.int64), np.full(size + 64, CUT, dtype=np.int64)
        keys = np.array(list(pairs), dtype=np.int64)
        for key, home, value in zip(keys.tolist(), self.home(keys).tolist(), pairs.values()):
            at = home
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.values[at] = key, value
            self.steps = max(self.steps, at - home + 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = first << BITS | second
        at = self.home(keys)
        out = np.where(self.keys[at] == keys, self.values[at], CUT)
        for step in range(1, self.steps):
            left = np.flatnonzero((out == CUT) & (self.keys[at + step - 1] >= 0))
            if not len(left):
                break
            there = at[left] + step
            out[left] = np.where(self.keys[there] == keys[left], self.values[there], CUT)
        return out


class Codec:
    """Encoder and decoder of one vocabulary file (BPE over byte letters with a suffix at word ends)."""

    def __init__(self, content: str):
        import regex
        data = json.loads(content)
        model = data["model"]
        suffix, vocab = model["end_of_word_suffix"] or "", model["vocab"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for name, number in [*vocab.items(), *self.special.items()]:
            self.tokens[number] = name
        # a pair of ids -> rank of its merge and the new id in one number, so that the smallest is the next merge
        pairs = {}
        for rank, pair in enumerate(model["merges"]):
            first, second = pair if isinstance(pair, list) else pair.split(" ")
            pairs[vocab[first] << BITS | vocab[second]] = rank << BITS | vocab[first + second]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters])
        self.last = np.array([vocab[c + suffix] for c in letters])
        together = {}
        for name in vocab:
            ended = suffix and name.endswith(suffix) and len(name) > len(suffix)
            symbols = [vocab[c] for c in (name[: -len(suffix)] if ended else name)]
            if ended:
                symbols[-1] = vocab[name[-len(suffix) - 1:]]
            together.update((a << BITS | b, NONE) for a, b in zip(symbols, symbols[1:]))
        self.pairs = pairs
        self.rank, self.beside = PairTable(pairs), PairTable(together | {k: pairs[k] for k in together if k in pairs})
        self.find = regex.compile(WORDS).findall
        self.regex = regex
        # the same pattern for the standard library, which is faster, for texts of Latin letters
        letters_, digits, blanks = ("".join(c for c in map(chr, range(LATIN)) if regex.match(k, c))
                                    for k in (r"\p{L}", r"\p{N}", r"\s"))
        self.simple = re.compile(f"'(?:[stmd]|re|ve|ll)|[{letters_}]+|[{digits}]|[^{blanks}{letters_}{digits}]+").findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @functools.cached_property
    def recent(self) -> frozenset[str]:
        """Letters and digits that only later versions of Unicode assign than the standard library has."""
        later = self.regex.compile(r"[\p{L}\p{N}]").match
        return frozenset(c for c in map(chr, range(NEWER_FROM, 0x110000)) if unicodedata.category(c) == "Cn" and later(c))

    @functools.cached_property
    def newer(self) -> frozenset[str]:
        """Those of them that the version of the tokenizers has not either; words are split as if they were signs."""
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split
        known = Split(Regex(r"[\p{L}\p{N}]+"), "removed", invert=True).pre_tokenize_str
        return frozenset(c for c in self.recent if not known(c))

    def merge_long(self, parts: list[int]) -> list[int]:
        """Ids of a fragment of any length: always the pair of lowest rank next, the leftmost first."""
        rank, n = self.pairs.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(key, i) for i in range(n - 1) if (key := rank(parts[i] << BITS | parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            key, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or rank(parts[i] << BITS | parts[j], NONE) != key:
                continue
            parts[i], parts[j] = key & MASK, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (found := rank(parts[a] << BITS | parts[b], NONE)) != NONE:
                    heapq.heappush(heap, (found, a))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words: their symbols in one row, cut into fragments, each fragment merged until no pair has a rank."""
        if not words:
            return []
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(size)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        rank = np.append(self.beside(symbols[:-1], symbols[1:]), CUT)
        rank[ends - 1] = CUT
        cuts = np.flatnonzero(rank == CUT) + 1
        rank[cuts - 1] = NONE
        length = np.diff(np.r_[0, cuts])
        done = np.full(len(data), -1, dtype=np.int64)
        long = length > LONG_FRAGMENT
        for stop, n in zip(cuts[long].tolist(), length[long].tolist()):
            merged = self.merge_long(symbols[stop - n: stop].tolist())
            done[stop - n: stop - n + len(merged)] = merged
        some = ~np.repeat(long, length)
        self.merge_all(symbols[some], rank[some], length[~long], np.flatnonzero(some), done)
        kept = done >= 0
        ids = done[kept].astype(np.uint32).tobytes()
        stops = (4 * np.cumsum(kept)[ends - 1]).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def merge_all(self, symbols, rank, length, place, done) -> None:
        """Merge many fragments at once: in every step the pair of lowest rank of each fragment, at all its places.
        ``rank`` holds that of a symbol and the next one; ``done`` gets the ids at their places."""
        final = np.zeros(len(symbols), dtype=bool)
        final[np.cumsum(length) - 1] = True
        while len(symbols):
            starts = np.cumsum(length) - length
            least = np.minimum.reduceat(rank, starts)
            live = least < NONE
            if not live.all():
                keep = np.repeat(live, length)
                done[place[~keep]] = symbols[~keep]
                symbols, rank, place, final = symbols[keep], rank[keep], place[keep], final[keep]
                length, least = length[live], least[live]
                if not len(length):
                    return
            number = np.repeat(np.arange(len(length)), length)
            at = np.flatnonzero(rank == least[number])
            order = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], order, 0))
            at = at[(order - run) % 2 == 0]  # of pairs that overlap, every other one from the left
            symbols[at] = rank[at] & MASK
            final[at] = final[at + 1]
            length = length - np.bincount(number[at], minlength=len(length))
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, rank, place, final = symbols[keep], rank[keep], place[keep], final[keep]
            at = at - np.arange(len(at))
            changed = np.unique(np.r_[at, at[at > 0] - 1])
            after = np.minimum(changed + 1, len(symbols) - 1)
            new = self.rank(symbols[changed], symbols[after])
            rank[changed] = np.where(final[changed] | (new == CUT), NONE, new)

    def segment(self, text: str) -> list[str]:
        """Words of the composed text in lower case, letter by letter (a final sigma gets no form of its own)."""
        if text.isascii():
            return self.simple(text.lower())
        text = unicodedata.normalize("NFC", text)
        if not BEYOND_LATIN(text):
            return self.simple(text.lower())
        if "\u03a3" not in text and (not BEYOND(text) or self.recent.isdisjoint(text)):
            return self.find(text.lower())
        from tokenizers.normalizers import Lowercase
        text = Lowercase().normalize_str(text)
        signs = "".join("\u00a6" if c in self.newer else c for c in text)  # of the same length
        return [text[w.start():w.end()] for w in self.regex.finditer(WORDS, signs)]

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text."""
        if self.parts is None or "<" not in text:
            return self.segment(text)
        return [w for part in self.parts(text) if part for w in ([part] if part in self.special else self.segment(part))]

    def ids_of(self, words: set[str]) -> dict[str, bytes]:
        """Ids of some words: what was seen before is kept in two generations of bounded size."""
        if len(self.words) + len(words) > CACHED_WORDS:
            self.older, self.words = self.words, {}
        new = []
        for word in words.difference(self.words):
            ids = self.older.get(word)
            if ids is None:
                new.append(word)
            else:
                self.words[word] = ids
        found = dict(zip(new, self.encode_words(new)))
        for word in self.special.keys() & words:
            found[word] = self.special[word].to_bytes(4, "little")
        self.words.update((w, i) for w, i in found.items() if len(w) <= CACHED_LENGTH)
        return {w: i for w, i in found.items() if len(w) > CACHED_LENGTH}

    def encode_texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of every text, taken together in groups of some characters."""
        group, chars = [], 0
        for text in texts:
            group.append(self.pieces(text) if text else [])
            chars += len(text or "")
            if chars >= GROUP_CHARS:
                yield from self.encode_group(group)
                group, chars = [], 0
        yield from self.encode_group(group)

    def encode_group(self, group: list[list[str]]) -> Iterator[bytes]:
        long = self.ids_of(set().union(*group))
        words = self.words
        for pieces in group:
            yield b"".join([long[w] if w in long else words[w] for w in pieces] if long else [words[w] for w in pieces])

    def encode(self, text: str | None) -> bytes:
        return next(iter(self.encode_texts([text])))

    def decode(self, ids: bytes | None) -> str:
        """Tokens joined by blanks, as a vocabulary without a decoder has it."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I"))) if ids else ""


_CODECS: dict[str, Codec] = {}


def codec(key: str, content: str) -> Codec:
    """One codec per worker process and vocabulary."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(content)
    return _CODECS[key]


class Vocabulary:
    """A vocabulary file, read once on the driver and sent to the tasks (its size is that of the file, some MB)."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            content = file.read()
        self.key = hashlib.sha256(content.encode()).hexdigest()
        self.sent = spark.sparkContext.broadcast(content)

    def codec(self) -> Codec:
        return _CODECS.get(self.key) or codec(self.key, self.sent.value)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of every whole text, as little-endian unsigned 32-bit integers in one binary value."""
    vocabulary = Vocabulary(df.sparkSession, path)

    @F.pandas_udf("binary")
    def to_ids(texts: pd.Series) -> pd.Series:
        return pd.Series(list(vocabulary.codec().encode_texts(texts)), dtype=object)

    return df.withColumn(ids, to_ids(F.col(text).cast("string")))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of the ids; special tokens are kept."""
    vocabulary = Vocabulary(df.sparkSession, path)

    @F.pandas_udf("string")
    def to_text(values: pd.Series) -> pd.Series:
        one = vocabulary.codec().decode
        return pd.Series([one(v) for v in values], dtype=object)

    return df.withColumn(text, to_text(F.col(ids)))

