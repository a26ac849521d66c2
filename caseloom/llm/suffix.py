"""Removal of long byte strings that occur more than once, with run-length compressed suffix indexes.

Every string of ``WINDOW`` bytes that also starts somewhere else in the corpus is removed wherever it occurs, in any
document and at overlapping places alike; matches never cross documents.

*Anchors* bring equal strings together. Of all hashes of ``ANCHOR`` bytes inside a window the smallest one (the leftmost
of equals) is its anchor, so equal windows have equal anchors at the same place. Only anchors that occur twice are
looked at further; one anchor in 85 bytes or so is needed. The *context* of an anchor holds all windows around it.
Equal contexts are collapsed before any shuffle of theirs: they are repeated as a whole.

*Index*. The different contexts of an anchor, one of each kind, go to one bucket; buckets of about ``CHUNK`` bytes form a
small corpus. Contexts that overlap in a document are joined, so that no byte is there twice. Its suffixes are sorted,
and of its Burrows-Wheeler transform only the runs are kept, with the text positions at both ends of each run. Inside a
run, the match of a suffix with its neighbour is one byte shorter than that of the position before it, so matches have to
be measured at the run ends only, and few of them are there in repetitive text. Streaming over the text, the longest match
elsewhere of every position (its matching statistic) is the largest of these samples less the distance to it; positions
with ``WINDOW`` or more are marked.

*Hot anchors.* An anchor with more than ``BUCKET`` different contexts (at the edges of a common passage) is split: the
windows around it are told apart by how many bytes they hold to its left, in ``WAYS`` steps, and a longer anchor that all
windows of a step hold takes its place. After three such rounds the anchor is the window itself, and contexts are equal.
Only one context of each kind goes on.

Defined cases: a missing text is the empty text; texts shorter than the window lose nothing; rows that repeat are copies
of each other; an empty table gives no rows. Columns other than the text are kept; columns of the outputs' names are
replaced.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import FEW_ENTRIES, join_small, whole_text, with_row_ids
from caseloom.plans.lineage import stored

WINDOW = 200
ANCHOR = 32
BUCKET = 4096          # different contexts of one anchor in one index
WAYS = 8               # longer anchors that take the place of a hot one
CHUNK = 600_000        # bytes that are indexed together
STRETCH = 1 << 20      # bytes of a text that are hashed together
OUT_ROWS = 50_000
SEPARATOR = 255        # never a byte of UTF-8
SPANS = "row_id bigint, start int, stop int"
BITS = 21              # of a place in a stretch


def mix(x: np.ndarray) -> np.ndarray:
    """A mixing function on 64 bits."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ x >> np.uint64(32)


class Spans:
    """Hashes of the byte spans of one text: differences of prefix sums over a polynomial in an odd base."""

    def __init__(self, data: np.ndarray, seed: int):
        base = (int(mix(np.array([seed]))[0]) | 1) & (1 << 64) - 1
        self.power, inverse = powers(base, len(data)), powers(pow(base, -1, 1 << 64), len(data))
        letters = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 32))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[data] * inverse)])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.power[start])


POWERS: dict[int, np.ndarray] = {}  # one table per base, of the largest size that was asked for


def powers(base: int, n: int) -> np.ndarray:
    table = POWERS.get(base)
    if table is None or len(table) < n:
        steps = np.full(1 << max(12, (n + 1).bit_length()), base, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            table = POWERS[base] = np.cumprod(steps)
    return table[: n]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: prefix minima of one block and suffix minima of the block before."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


def stretches(n: int, window: int):
    """Parts of a text: the windows that start in a part, and the bytes that hold all their contexts."""
    for at in range(0, max(n - window + 1, 0), STRETCH):
        yield at, min(at + STRETCH, n - window + 1), max(0, at - window), min(n, at + STRETCH + 2 * window)


def anchors(data: np.ndarray, window: int = WINDOW, length: int = ANCHOR):
    """Arrays ``a`` (hash of the anchor), ``c`` (hash of its context) and ``pos`` of a text's anchors."""
    found = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64)]
    last = -1
    for first, end, low, high in stretches(len(data), window):
        part = data[low:high]
        spans = Spans(part, 1)
        at = np.arange(first - low, end - low + window - length)
        hashes = spans(at, at + length)
        order = hashes >> np.uint64(BITS) << np.uint64(BITS) | (at - at[0]).astype(np.uint64)
        least = sliding_min(order, window - length + 1) & np.uint64((1 << BITS) - 1)
        pos = np.unique(least).astype(np.int64) + at[0]
        pos = pos[pos + low > last]
        if len(pos):
            last = int(pos[-1]) + low
            found = [np.concatenate([x, y]) for x, y in zip(found, hashed(part, spans, pos, low, window, length))]
    return found


def context(pos, size, window: int, length: int):
    """First and last byte of the windows around an anchor."""
    return np.maximum(pos - (window - length), 0), np.minimum(pos + window, size)


def hashed(part: np.ndarray, spans: Spans, pos: np.ndarray, low: int, window: int, length: int):
    lo, hi = context(pos, len(part), window, length)
    shape = (pos - lo).astype(np.uint64) << np.uint64(32) | (hi - pos).astype(np.uint64)
    return spans(pos, pos + length), mix(Spans(part, 2)(lo, hi) ^ mix(shape)), pos + low


def longer(pos: np.ndarray, length: int, size: int, window: int) -> tuple[np.ndarray, int]:
    """Places and length of the longer anchors that take the place of some of ``length``, as far as the text has room.
    A window holds ``window - length`` bytes beside its anchor; the anchors are told apart by how many of them are on
    the left, in up to ``WAYS`` steps, or one by one if they are few."""
    rest = window - length
    step = -(-rest // WAYS) if rest > WAYS else 0
    left = np.arange(0, rest, step) if step else np.arange(rest + 1)
    starts = np.unique((pos[:, None] - left[None, :]).ravel())
    return starts[(starts >= 0) & (starts + window - step <= size)], window - step


def bytes_of(value) -> np.ndarray:
    return np.frombuffer((value.as_py() or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


ROWS = "row_id bigint, a bigint, c bigint, place bigint"


def batch_of(parts: list[tuple]) -> pa.RecordBatch:
    """A batch of ``ROWS`` from (row id, size of the text, arrays). ``place`` holds the place of the anchor and the room
    behind it, as far as a window reaches."""
    n = [len(arrays[0]) for _, _, arrays in parts]
    join = lambda k: np.concatenate([arrays[k] for _, _, arrays in parts])
    pos, size = join(2), np.repeat(np.array([s for _, s, _ in parts], np.int64), n)
    columns = [np.repeat(np.array([r for r, _, _ in parts], np.int64), n), join(0).view(np.int64), join(1).view(np.int64),
               pos << 16 | np.minimum(size - pos, (1 << 16) - 1)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row_id", "a", "c", "place"])


def span_of(place: str, window: int, length: int) -> tuple[Column, Column]:
    """First and last byte of the context of a place, as columns."""
    pos, room = F.shiftright(place, 16), F.col(place).bitwiseAND(F.lit((1 << 16) - 1))
    return (F.greatest(F.lit(0), pos - (window - length)).cast("int"),
            (pos + F.least(room, F.lit(window))).cast("int"))


def anchor_rows(docs: DataFrame, window: int, length: int) -> DataFrame:
    def scan(batches):
        for batch in batches:
            parts, filled = [], 0
            for row, text in zip(batch.column(0), batch.column(1)):
                data = bytes_of(text)
                found = anchors(data, window, length)
                if len(found[0]):
                    parts.append((row.as_py(), len(data), found))
                    filled += len(found[0])
                if filled >= OUT_ROWS:
                    yield batch_of(parts)
                    parts, filled = [], 0
            if parts:
                yield batch_of(parts)

    return docs.select("row_id", "_text").mapInArrow(scan, ROWS)


def longer_rows(docs: DataFrame, hot: DataFrame, entries: int, window: int, length: int) -> DataFrame:
    """Rows of the longer anchors that take the place of hot ones."""
    wanted = hot.groupBy("row_id").agg(F.collect_set(F.shiftright("place", 16)).alias("wanted"))

    def scan(batches):
        for batch in batches:
            parts, filled = [], 0
            for row, text, places in zip(*(batch.column(i) for i in range(3))):
                data = bytes_of(text)
                pos, size = longer(np.array(places.as_py(), dtype=np.int64), length, len(data), window)
                for number in np.unique(pos // STRETCH):
                    some = pos[pos // STRETCH == number]
                    low, high = max(0, int(some[0]) - window), min(len(data), int(some[-1]) + 2 * window)
                    part = data[low:high]
                    parts.append((row.as_py(), len(data), hashed(part, Spans(part, 1), some - low, low, window, size)))
                    filled += len(some)
                if filled >= OUT_ROWS:
                    yield batch_of(parts)
                    parts, filled = [], 0
            if parts:
                yield batch_of(parts)

    rows = join_small(docs.select("row_id", "_text"), wanted, "row_id", entries)
    return rows.select("row_id", "_text", "wanted").mapInArrow(scan, ROWS)


def context_rows(docs: DataFrame, needed: DataFrame, entries: int, window: int, length: int) -> DataFrame:
    """``a, row_id, lo, body``: the bytes of the contexts to be indexed."""
    wanted = needed.groupBy("row_id").agg(F.collect_list(F.struct("a", F.shiftright("place", 16).alias("pos"))).alias(
        "wanted"))

    def scan(batches):
        for batch in batches:
            for row, text, places in zip(*(batch.column(i) for i in range(3))):
                body, places, row = (text.as_py() or "").encode("utf-8", "surrogatepass"), places.as_py(), row.as_py()
                for at in range(0, len(places), OUT_ROWS // 10):
                    some = places[at: at + OUT_ROWS // 10]
                    lo, hi = context(np.array([p["pos"] for p in some]), len(body), window, length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p["a"] for p in some], pa.int64()), pa.array([row] * len(some), pa.int64()),
                         pa.array(lo.astype(np.int32)),
                         pa.array([body[x:y] for x, y in zip(lo.tolist(), hi.tolist())], pa.binary())],
                        ["a", "row_id", "lo", "body"])

    rows = join_small(docs.select("row_id", "_text"), wanted, "row_id", entries)
    return rows.select("row_id", "_text", "wanted").mapInArrow(scan, "a bigint, row_id bigint, lo int, body binary")


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number, zeros beyond the end."""
    padded = np.zeros(len(text) + 16, dtype=np.uint64)
    padded[: len(text)] = text
    out = np.zeros(len(text) + 8, dtype=np.uint64)
    for k in range(8):
        out |= padded[k: k + len(out)] << np.uint64(56 - 8 * k)
    return out


def suffix_array(text: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Order of all suffixes: by eight bytes, then by doubling, each time only where ties are left."""
    n, reach = len(text), 8
    order = np.argsort(word[:n]).astype(np.int32)
    rank = np.full(n + 1, -1, dtype=np.int32)
    key, slots = word[:n][order], np.arange(n, dtype=np.int32)
    while True:
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[first, len(key)])
        rank[order[slots]] = np.repeat(slots[first], length)
        slots = slots[np.repeat(length > 1, length)]
        if not len(slots):
            return order
        some = order[slots]
        key = rank[some].astype(np.int64) * (n + 2) + rank[np.minimum(some + reach, n)] + 1
        by = np.argsort(key)
        order[slots], key = some[by], key[by]
        reach *= 2


def common_prefix(word: np.ndarray, n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at each ``i`` and ``j``."""
    out = np.zeros(len(i), dtype=np.int32)
    active = np.arange(len(i))
    while len(active):
        a, b = i[active] + out[active], j[active] + out[active]
        differ = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        same = (differ == 0) & (np.maximum(a, b) < n)
        rest = differ[~same]
        equal = sum(((rest >> np.uint64(64 - 8 * k)) == 0).astype(np.int32) for k in range(1, 8)) if len(rest) else 0
        out[active[~same]] += equal
        active = active[same]
        out[active] += 8
    return np.minimum(out, n - np.maximum(i, j))


def matching_statistics(text: np.ndarray) -> np.ndarray:
    """Length of the longest match of every position that also starts elsewhere in ``text``, from the ends of the runs
    of its Burrows-Wheeler transform."""
    n = len(text)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    word = words(text)
    order = suffix_array(text, word)
    bwt = text[order - 1].astype(np.int16)
    bwt[order == 0] = SEPARATOR + 1                       # nothing stands before the text
    heads = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1       # runs begin here; the run before ends one earlier
    before, first = order[heads - 1], order[heads]        # sampled text positions: ends and beginnings of runs
    match = common_prefix(word, n, before, first)
    reach = np.zeros(n, dtype=np.int32)
    np.maximum.at(reach, before, match + before)
    np.maximum.at(reach, first, match + first)
    at = np.arange(n, dtype=np.int32)
    return np.maximum(np.maximum.accumulate(reach) - at, 0)


def repeated_spans(segments: list[tuple[int, int, bytes]], window: int) -> list[tuple[int, int, int]]:
    """Spans ``(row, start, stop)`` covered by windows that occur twice in the segments ``(row, lo, body)``."""
    joined: list[list] = []
    for row, lo, body in sorted(segments):
        if joined and joined[-1][0] == row and lo <= joined[-1][1] + len(joined[-1][2]):
            joined[-1][2] += body[joined[-1][1] + len(joined[-1][2]) - lo:]
        else:
            joined.append([row, lo, bytearray(body)])
    text = np.frombuffer(bytes([SEPARATOR]).join(s[2] for s in joined) + bytes([SEPARATOR]), dtype=np.uint8)
    size = np.array([len(s[2]) for s in joined])
    begin = np.cumsum(size + 1) - size - 1
    number = np.repeat(np.arange(len(joined)), size + 1)
    left = (begin + size)[number] - np.arange(len(text))
    starts = np.flatnonzero(np.minimum(matching_statistics(text), left) >= window)
    if not len(starts):
        return []
    cut = np.flatnonzero((np.diff(starts) > 1) | (np.diff(number[starts]) > 0))
    firsts, lasts = starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]]
    return [(joined[s][0], joined[s][1] + int(f - begin[s]), joined[s][1] + int(e - begin[s]) + window)
            for f, e, s in zip(firsts, lasts, number[firsts])]


def span_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))],
                                      ["row_id", "start", "stop"])


def indexed(rows: DataFrame, window: int) -> DataFrame:
    """Spans found by the indexes over all buckets of ``a, row_id, lo, body``."""
    def index(batches):
        held, size, bucket = [], 0, None
        for batch in batches:
            for a, row, lo, body in zip(*(c.to_pylist() for c in batch.columns)):
                if a != bucket and size >= CHUNK:
                    yield span_batch(repeated_spans(held, window))
                    held, size = [], 0
                bucket = a
                held.append((row, lo, body))
                size += len(body)
        if held:
            yield span_batch(repeated_spans(held, window))

    return rows.repartition("a").sortWithinPartitions("a", "row_id", "lo").mapInArrow(index, SPANS)


def meet(rows: DataFrame, keys: DataFrame, on: list[str], first: bool) -> DataFrame:
    """The rows whose key is listed. The list is stored, so that the join stands apart from the counting and a key with
    very many rows can be split. The rounds after the first have few rows, and their list is broadcast while it is short."""
    keys = stored(keys)
    few = not first and keys.count() <= FEW_ENTRIES // 4
    return rows.join(F.broadcast(keys) if few else keys, on, "left_semi")


def repeats(docs: DataFrame, window: int = WINDOW, length: int = ANCHOR, bucket: int = BUCKET) -> DataFrame:
    """Spans ``row_id, start, stop`` of documents ``row_id, _text`` that cover all repeated windows, and nothing else;
    spans may overlap."""
    rows, found, first = stored(anchor_rows(docs, window, length)), None, True
    while True:
        twice = rows.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        members = stored(meet(rows, twice, ["a"], first))
        classes = stored(members.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("row_id", "place")).alias(
            "one")))
        start, stop = span_of("place", window, length)
        whole = meet(members, classes.where("n > 1").select("a", "c"), ["a", "c"], first).select(
            "row_id", start.alias("start"), stop.alias("stop"))
        found = whole if found is None else found.union(whole)
        mixed = classes.groupBy("a").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where(
            "kinds > 1 AND least = 1").select("a", "kinds")
        open_ = stored(classes.join(mixed, "a").select("a", "one.*", "kinds"))
        few, many = open_.agg(F.count_if(F.col("kinds") <= bucket), F.count_if(F.col("kinds") > bucket)).first()
        if few:
            bodies = context_rows(docs, open_.where(F.col("kinds") <= bucket), few, window, length)
            found = found.union(stored(indexed(bodies, window)))
        if not many:
            return found
        # one of each kind goes on; the others of a kind are repeated as a whole and marked already
        hot, first = open_.where(F.col("kinds") > bucket), False
        rows = stored(longer_rows(docs, hot, many, window, length))
        length = longer(np.zeros(1, np.int64), length, window, window)[1]


def merged(spans: DataFrame) -> DataFrame:
    """``row_id, spans``: maximal spans per document, in order."""
    gathered = spans.groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("s"))

    def merge(batches):
        for batch in batches:
            out = []
            for some in batch.column(1).to_pylist():
                kept: list[list[int]] = []
                for x in some:
                    if kept and x["start"] <= kept[-1][1]:
                        kept[-1][1] = max(kept[-1][1], x["stop"])
                    else:
                        kept.append([x["start"], x["stop"]])
                out.append([{"start": a, "stop": b} for a, b in kept])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["row_id", "spans"])

    return gathered.mapInArrow(merge, "row_id bigint, spans array<struct<start:int,stop:int>>")


def cut_udf():
    @F.pandas_udf("binary")
    def cut(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        out = []
        for text, begin, end in zip(texts, starts, stops):
            body, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
            for start, stop in zip(begin, end):
                kept.append(body[at: start])
                at = stop
            out.append(b"".join([*kept, body[at:]]))
        return pd.Series(out, dtype=object)

    return cut


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, length: int = ANCHOR,
                   bucket: int = BUCKET) -> DataFrame:
    """The documents with ``n_bytes, n_removed, n_spans``, the removed ``spans`` (byte offsets) and the
    ``kept`` bytes."""
    names = ["n_bytes", "n_removed", "n_spans", "spans", "kept", "row_id", "_text"]
    rows = with_row_ids(docs.drop(*names)).withColumn("_text", whole_text(text))
    spans = stored(merged(repeats(rows, window, length, bucket)))
    entries = spans.agg(F.coalesce(F.sum(F.size("spans") + 2), F.lit(0))).first()[0]
    none = F.array().cast("array<struct<start:int,stop:int>>")
    found = join_small(rows, spans, "row_id", entries, "left").withColumn("spans", F.coalesce("spans", none))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return (found.withColumn("n_bytes", F.octet_length("_text").cast("bigint")).withColumn("n_removed", removed)
            .withColumn("n_spans", F.size("spans").cast("bigint"))
            .withColumn("kept", cut_udf()("_text", "spans.start", "spans.stop")).drop("row_id", "_text"))
