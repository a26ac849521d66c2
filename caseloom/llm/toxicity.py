"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of what is learned for the word itself and the mean of what is learned for its groups of three
bytes, so unseen spellings are not blind spots. A window of ``WINDOW`` words is read in both directions by gated
recurrent units, attention weighs the positions, and one number comes out. Windows overlap by half and cover the whole
text; the score of a text is that of its most toxic window. Training sees whole texts with one label each: the gradient
goes to the windows of a text by a sharp softmax over them.

The network is fitted on a bounded sample (``SAMPLE_TEXTS`` and ``SAMPLE_CHARS`` per label); every fifth text of it is
set aside to choose the cut between the labels. Scoring needs no shuffle; a worker keeps the inputs of words it has seen.

Defined cases: a missing text is the empty text; a text without words scores 0; without texts of both labels everything
scores 0; rows that repeat score alike; an empty table gives no rows. Other columns are kept; a column of the output's
name is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.plans.lineage import stored

WINDOW, STRIDE = 32, 16
SAMPLE_TEXTS = 600        # per label
SAMPLE_CHARS = 1_200_000  # per label; texts of more than a twentieth are not taken into the sample
VOCABULARY = 20_000       # words and groups of bytes that are learned, each
UNITS, WIDTH, ATTENTION = 8, 12, 8
EPOCHS, STEPS, RATE, BATCH_WINDOWS, SHARP = 5, 250, 0.02, 256, 3.0  # small samples are gone through more often
CACHED_WORDS = 120_000
GROUP_WORDS = 300_000     # words that are scored together
WORDS = re.compile(r"[^\W_]+").findall


def sample(docs: DataFrame, text: str, label: str, labels: DataFrame | None = None, key: str = "doc_id",
           texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS):
    """A bounded sample of (label, whole text), and the share of label 1: of the distinct texts of each label those with
    the smallest hashes, however many copies a text has. ``labels`` has the labels by ``key``, if ``docs`` has none.

    Hashes and lengths are chosen first, so that no text is exchanged but those of the sample; only about twice the bound
    of them is sorted.
    """
    place = F.pmod(F.xxhash64(text), F.lit(1 << 40))
    known = docs.where(F.col(text).isNotNull() & (F.length(text) <= chars // 20))
    if labels is None:
        marks = known.select(F.col(label).alias("y"), place.alias("h"), F.length(text).alias("n"))
    else:
        marks = known.select(F.col(key).alias("key"), place.alias("h"), F.length(text).alias("n")).join(
            labels.select(F.col(key).alias("key"), F.col(label).alias("y")), "key")
    marks = stored(marks.where(F.col("y").isin(0, 1)).select(F.col("y").cast("int").alias("y"), "h", "n"))
    counts = {r.y: r for r in marks.groupBy("y").agg(F.count("*").alias("rows"), F.countDistinct("h").alias("texts")).collect()}
    if len(counts) < 2:
        return [], 0.0
    bar = F.when(F.col("y") == 1, (2 * texts + 20) / counts[1].texts).otherwise((2 * texts + 20) / counts[0].texts)
    near = marks.where(F.col("h") < bar * float(1 << 40)).groupBy("y", "h").agg(F.max("n").alias("n"))
    order = Window.partitionBy("y").orderBy("h")
    chosen = stored(near.withColumn("k", F.row_number().over(order)).withColumn(
        "c", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(
        (F.col("k") <= texts) & (F.col("c") <= chars)).select("y", "h"))
    found = known.select(F.col(text).alias("text"), place.alias("h")).join(F.broadcast(chosen), "h").groupBy(
        "y", "h").agg(F.min("text").alias("text")).orderBy("h", "text", "y")
    return [(r.y, r.text) for r in found.collect()], counts[1].rows / (counts[0].rows + counts[1].rows)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """Places of known words and byte groups; 0 stands for all others."""

    def __init__(self, texts: list[list[str]]):
        words = Counter(w for t in texts for w in set(t))
        self.word = {w: i for i, (w, n) in enumerate(words.most_common(VOCABULARY), 1) if n > 1}
        codes, _ = self.codes(list(words))
        kinds, n = np.unique(codes, return_counts=True)
        self.groups = np.sort(kinds[np.argsort(-n, kind="stable")[:VOCABULARY]])

    @staticmethod
    def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Three bytes as one number, for all words between marks, and how many each word has."""
        raw = [f"^{w}$".encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw) + b"  ", dtype=np.uint8).astype(np.int64)
        codes = (data[:-2] << 16 | data[1:-1] << 8 | data[2:])
        ends = np.cumsum(size)
        keep = np.ones(len(codes), dtype=bool)
        keep[ends - 1] = keep[ends - 2] = False
        return codes[keep], size - 2

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each word, places of all groups, and how many groups each word has."""
        codes, n = self.codes(words)
        at = np.minimum(np.searchsorted(self.groups, codes), len(self.groups) - 1)
        return (np.array([self.word.get(w, 0) for w in words]), np.where(self.groups[at] == codes, at + 1, 0), n)


class Network:
    def __init__(self, words: Words, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        small = lambda n: (0.1 * rng.standard_normal((n, WIDTH))).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, dtype=np.float32)
        h = UNITS
        self.words, self.cut = words, 0.0
        self.p = {"word": small(len(words.word) + 1), "group": small(len(words.groups) + 1),
                  "inf": draw(2 * WIDTH, 3 * h), "inb": draw(2 * WIDTH, 3 * h), "bf": zero(3 * h), "bb": zero(3 * h),
                  "uf": draw(h, 3 * h), "ub": draw(h, 3 * h), "att": draw(2 * h, ATTENTION), "batt": zero(ATTENTION),
                  "vatt": draw(ATTENTION), "out": draw(2 * h), "bout": zero(1)}

    def features(self, words: list[str]):
        """What enters for each word: its own row and the mean row of its byte groups."""
        place, groups, n = self.words.inputs(words)
        begin = np.cumsum(n) - n
        mean = np.add.reduceat(self.p["group"][groups], begin, axis=0) / n[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][place], mean], axis=1), (place, groups, n)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Inputs of all gates in both directions."""
        return np.concatenate([x @ self.p["inf"] + self.p["bf"], x @ self.p["inb"] + self.p["bb"]], axis=1)

    def read(self, gates, index, mask, keep: bool):
        """States ``[windows, words, 2 units]`` and what the way back needs. ``index`` has rows of ``gates``."""
        n, t = index.shape
        states, steps = np.zeros((n, t, 2 * UNITS), dtype=np.float32), []
        for side, order in ((0, range(t)), (1, range(t - 1, -1, -1))):
            u, h = self.p["uf" if side == 0 else "ub"], np.zeros((n, UNITS), dtype=np.float32)
            part = gates[:, 3 * UNITS * side: 3 * UNITS * (side + 1)]
            for i in order:
                g, hu = part[index[:, i]], h @ u
                zr = sigmoid(g[:, : 2 * UNITS] + hu[:, : 2 * UNITS])
                z, r = zr[:, :UNITS], zr[:, UNITS:]
                c = hu[:, 2 * UNITS:]
                new = np.tanh(g[:, 2 * UNITS:] + r * c)
                if keep:
                    steps.append((side, i, h, z, r, c, new))
                h = np.where(mask[:, i, None], new + z * (h - new), h)
                states[:, i, UNITS * side: UNITS * (side + 1)] = h
        return states, steps

    def pool(self, states, mask):
        """One number per window, and the parts it is made of."""
        hidden = np.tanh(states @ self.p["att"] + self.p["batt"])
        energy = np.where(mask, hidden @ self.p["vatt"], -1e9)
        weight = np.exp(energy - energy.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = (weight[:, :, None] * states).sum(axis=1)
        return pooled @ self.p["out"] + self.p["bout"][0], (hidden, weight, pooled)

    def gradient(self, index, mask, owner, y, words):
        """Loss and gradients of a batch: windows over ``words``, the text that owns each, the labels of the texts."""
        x, (place, groups, n) = self.features(words)
        gates = self.gates(x)
        states, steps = self.read(gates, index, mask, True)
        logit, (hidden, weight, pooled) = self.pool(states, mask)
        top = np.full(len(y), -np.inf, dtype=np.float32)
        np.maximum.at(top, owner, logit)
        share = np.exp(SHARP * (logit - top[owner]))
        total = np.bincount(owner, share, len(y))
        text = top + np.log(total) / SHARP
        error = sigmoid(text) - y
        loss = float((np.logaddexp(0, text) - y * text).mean())
        d_logit = (error[owner] * share / total[owner] / len(y)).astype(np.float32)
        grad = {"out": pooled.T @ d_logit, "bout": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_weight = (states * d_pooled[:, None, :]).sum(axis=2)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        d_hidden = d_energy[:, :, None] * self.p["vatt"] * (1 - hidden * hidden)
        grad["vatt"] = np.einsum("nta,nt->a", hidden, d_energy)
        grad["att"] = np.einsum("ntk,nta->ka", states, d_hidden)
        grad["batt"] = d_hidden.sum(axis=(0, 1))
        d_states = weight[:, :, None] * d_pooled[:, None, :] + d_hidden @ self.p["att"].T
        d_gates = np.zeros((*index.shape, 6 * UNITS), dtype=np.float32)
        grad["uf"], grad["ub"] = np.zeros_like(self.p["uf"]), np.zeros_like(self.p["ub"])
        back, last = None, None
        for side, i, before, z, r, c, new in reversed(steps):
            if side != last:
                back, last = np.zeros_like(before), side
            name = "uf" if side == 0 else "ub"
            back = back + d_states[:, i, UNITS * side: UNITS * (side + 1)]
            live = mask[:, i, None]
            d = np.where(live, back, 0)
            d_new = d * (1 - z) * (1 - new * new)
            d_z, d_r = d * (before - new) * z * (1 - z), d_new * c * r * (1 - r)
            d_hu = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_gates[:, i, 3 * UNITS * side: 3 * UNITS * (side + 1)] = np.concatenate([d_z, d_r, d_new], axis=1)
            grad[name] += before.T @ d_hu
            back = np.where(live, d * z + d_hu @ self.p[name].T, back)
        flat, rows = d_gates.reshape(-1, 6 * UNITS), index.ravel()
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(rows[order]) > 0])
        d_word = np.zeros_like(gates)
        d_word[rows[order][first]] = np.add.reduceat(flat[order], first, axis=0)
        half = 3 * UNITS
        grad["inf"], grad["inb"] = x.T @ d_word[:, :half], x.T @ d_word[:, half:]
        grad["bf"], grad["bb"] = d_word[:, :half].sum(axis=0), d_word[:, half:].sum(axis=0)
        d_x = d_word[:, :half] @ self.p["inf"].T + d_word[:, half:] @ self.p["inb"].T
        grad["word"], grad["group"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["group"])
        np.add.at(grad["word"], place, d_x[:, :WIDTH])
        np.add.at(grad["group"], groups, np.repeat(d_x[:, WIDTH:] / n[:, None], n, axis=0))
        return loss, grad

    def logits(self, gates, index, mask) -> np.ndarray:
        return self.pool(self.read(gates, index, mask, False)[0], mask)[0]


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window number -> text and first word, for texts of some numbers of words; every word is in a window."""
    count = np.where(sizes > 0, 1 + -(-np.maximum(sizes - WINDOW, 0) // STRIDE), 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    return owner, STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))


def laid_out(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, word numbers and mask of all windows of some texts."""
    sizes = np.array([len(x) for x in numbers])
    owner, first = windows(sizes)
    flat = np.concatenate([*numbers, np.zeros(1, np.int64)])
    inside = first[:, None] + np.arange(WINDOW)
    mask = inside < sizes[owner][:, None]
    begin = (np.cumsum(sizes) - sizes)[owner][:, None]
    return owner, flat[np.where(mask, begin + inside, len(flat) - 1)], mask


def fit(texts: list[tuple[int, str]], share: float) -> Network | None:
    """Train on a sample of (label, text); None if it does not hold both labels."""
    split = [(y, WORDS(t.lower())) for y, t in texts]
    split = [(y, w) for y, w in split if w]
    learn = [x for i, x in enumerate(split) if i % 5]
    if len({y for y, _ in learn}) < 2:
        return None
    network = Network(Words([w for _, w in learn]))
    n_windows = sum(1 + len(w) // STRIDE for _, w in learn)
    epochs = max(EPOCHS, min(STEPS, -(-STEPS * BATCH_WINDOWS // n_windows)))
    rng = np.random.default_rng(3)
    mean = {k: np.zeros_like(v) for k, v in network.p.items()}
    square = {k: np.zeros_like(v) for k, v in network.p.items()}
    step = 0
    for epoch in range(epochs):
        at = 0
        order = rng.permutation(len(learn))
        while at < len(order):
            batch, size = [], 0
            while at < len(order) and (size < BATCH_WINDOWS or not batch):
                batch.append(learn[order[at]])
                size += 1 + len(batch[-1][1]) // STRIDE
                at += 1
            words = sorted({w for _, some in batch for w in some})
            number = {w: i for i, w in enumerate(words)}
            owner, index, mask = laid_out([np.array([number[w] for w in some]) for _, some in batch])
            _, grad = network.gradient(index, mask, owner, np.array([y for y, _ in batch], np.float32), words)
            step += 1
            rate = RATE * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                network.p[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-7)).astype(np.float32)
    aside = [x for i, x in enumerate(split) if i % 5 == 0] or split
    network.cut = best_cut(Scorer(network).raw([" ".join(w) for _, w in aside]), [y for y, _ in aside], share)
    return network


def best_cut(logits: list[float], labels: list[int], share: float) -> float:
    """Cut with the fewest mistakes at the true share of label 1; the middle of the widest gap among equals."""
    x, y = np.array(logits), np.array(labels)
    if len(set(labels)) < 2:
        return 0.0
    order = np.argsort(x)
    x, y = x[order], y[order]
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    wrong = np.r_[0, np.cumsum(np.where(y == 1, weight, -weight))]  # mistakes, but for a constant, of a cut before i
    at = np.flatnonzero(wrong[1:-1] <= wrong[1:-1].min() + 1e-12) + 1
    gap = x[at] - x[at - 1]
    best = at[np.argmax(gap)]
    return float((x[best] + x[best - 1]) / 2)


class Scorer:
    """Scores of texts with a bounded cache of the gate inputs of words."""

    def __init__(self, network: Network):
        self.network = network
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((CACHED_WORDS, 6 * UNITS), dtype=np.float32)

    def numbers(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.number)
        if new:
            new = sorted(new)
            begin = len(self.number)
            x, _ = self.network.features(new)
            while begin + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[begin: begin + len(new)] = self.network.gates(x)
            self.number.update(zip(new, range(begin, begin + len(new))))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def flush(self, held: list[tuple[int, np.ndarray]], out: list[float]) -> None:
        owner, index, mask = laid_out([x for _, x in held])
        for at in range(0, len(owner), 4096):
            found = self.network.logits(self.rows, index[at: at + 4096], mask[at: at + 4096])
            for text, value in zip(owner[at: at + 4096].tolist(), found.tolist()):
                out[held[text][0]] = max(out[held[text][0]], value)

    def raw(self, texts) -> list[float]:
        """The largest window's number of every text; -inf for texts without words."""
        out: list[float] = []
        held, size = [], 0
        for text in texts:
            out.append(float("-inf"))
            words = WORDS(text.lower()) if text else []
            # parts of a long text share a window, so that no window of the whole is lost
            for at in range(0, max(len(words) - (WINDOW - STRIDE), 1 if words else 0), GROUP_WORDS):
                part = words[at: at + GROUP_WORDS + WINDOW - STRIDE]
                if len(self.number) + len(part) > 2 * CACHED_WORDS and held:
                    self.flush(held, out)
                    held, size = [], 0
                if len(self.number) + len(part) > 2 * CACHED_WORDS:
                    self.reset()
                held.append((len(out) - 1, self.numbers(part)))
                size += len(part)
                if size >= GROUP_WORDS:
                    self.flush(held, out)
                    held, size = [], 0
        if held:
            self.flush(held, out)
        return out

    def scores(self, texts) -> np.ndarray:
        return np.array([float(sigmoid(np.float64(x - self.network.cut))) if x > float("-inf") else 0.0
                         for x in self.raw(texts)])


def score(df: DataFrame, network: Network | None, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score of every whole text."""
    if network is None:
        return df.withColumn(name, F.lit(0.0))
    sent = df.sparkSession.sparkContext.broadcast(network)  # bounded by the sample and the vocabulary

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for texts in batches:
            yield pd.Series(scorer.scores(texts))

    return df.withColumn(name, rate(F.col(text).cast("string")))


def train(docs: DataFrame, text: str = "text", label: str = "toxic", labels: DataFrame | None = None,
          key: str = "doc_id") -> Network | None:
    """The network fitted on a bounded sample of the labelled texts; ``labels`` has the labels by ``key``, if ``docs`` has
    none."""
    texts, share = sample(docs, text, label, labels, key)
    return fit(texts, share)
