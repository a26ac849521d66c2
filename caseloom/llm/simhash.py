"""Near-duplicates by SimHash with covering locality-sensitive hashing.

A fingerprint has 64 bits: a bit is set if it is set in more than half of the hashes of the text's word shingles.
Fingerprints within ``RADIUS`` bits are linked. To find every such pair without comparing all, every bit position gets a
vector of ``RADIUS + 1`` bits, and every non-zero vector v gives a mask of the positions whose vector has an odd inner
product with v. The vectors of three differing positions span at most three of four dimensions, so some v is orthogonal
to all of them: in the table of that v the pair agrees on the whole mask and meets in one bucket. 15 tables therefore
cover every pair within three bits, without exception.

Equal fingerprints are collapsed first. A bucket emits no pairs but a spanning forest of its links, at most one edge per
fingerprint. Buckets beyond ``BUCKET`` members are split the same way again: the members agree on the mask, so masks over
the other positions cover their pairs in smaller buckets, until so few positions are left that a bucket is small anyway.

Defined cases: a missing text is the empty text; texts without words have fingerprint zero and link like any other; a
text of fewer words than a shingle is one shingle; rows that repeat fall into one component; an empty table gives no rows.
Identifiers are integers. Columns other than identifier and text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from caseloom.llm.components import components
from caseloom.plans.lineage import stored

WORDS = 3
SEED = 42
RADIUS = 3
BUCKET = 2048
FEW_POSITIONS = 14  # positions left out of a mask, over which there are at most 2 ** 14 fingerprints
COUNTED = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as a signed 64-bit number."""
    import xxhash
    hash_ = xxhash.xxh64_intdigest
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, blanks 20 and 09 to 0D
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = np.array([hash_(joined, SEED)], dtype=np.uint64)
    else:
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(length + 1) - 1
        starts, stops = (ends - length)[: 1 - words].tolist(), ends[words - 1:].tolist()
        hashes = np.array([hash_(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at: at + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def masks(free: int, radius: int = RADIUS) -> list[int]:
    """Masks over the positions of ``free`` such that any ``radius`` of them are outside some mask. With no more
    positions than the radius covers, one empty mask does."""
    places = [i for i in range(64) if free >> i & 1]
    size = (1 << radius + 1) - 1
    vectors = {place: 1 + k % size for k, place in enumerate(places)}
    return sorted({sum(1 << p for p in places if (vectors[p] & v).bit_count() & 1) for v in range(1, size + 1)})


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def first_tables(prints: DataFrame) -> DataFrame:
    """``bucket, mask, print``: every fingerprint in each table."""
    keys = [F.struct(F.xxhash64(F.lit(m), F.col("print").bitwiseAND(F.lit(m))).alias("bucket"), F.lit(m).alias("mask"))
            for m in map(signed, masks((1 << 64) - 1))]
    return prints.select("print", F.explode(F.array(*keys)).alias("k")).select("k.bucket", "k.mask", "print")


def split_tables(rows: DataFrame) -> DataFrame:
    """The same rows in the smaller buckets of masks over the positions that their mask leaves out."""
    def split(batches):
        for batch in batches:
            bucket, mask, prints = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            for value in np.unique(mask):
                here = mask == value
                for more in masks(~int(value) & (1 << 64) - 1):
                    agreed = value | np.uint64(more)
                    inner = mix(bucket[here] ^ mix(prints[here] & np.uint64(more)) + np.uint64(more))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.view(np.int64)) for x in (inner, np.full(here.sum(), agreed), prints[here])],
                        ["bucket", "mask", "print"])

    return rows.select("bucket", "mask", "print").mapInArrow(split, "bucket bigint, mask bigint, print bigint")


def mix(x: np.ndarray) -> np.ndarray:
    """A mixing function on 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ x >> np.uint64(29)


def bucket_links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``a, b`` of a spanning forest of every bucket's links. Buckets are bounded; a task holds a batch and one
    bucket."""
    def forest(prints: np.ndarray) -> list[tuple[int, int]]:
        rest, edges = prints, []
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                one = queue.pop()
                near = np.bitwise_count(rest ^ one) <= radius
                if near.any():
                    found = rest[near]
                    edges.extend((one, x) for x in found)
                    queue.extend(found)
                    rest = rest[~near]
        return edges

    def link(batches):
        kept_bucket, kept = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            bucket = np.concatenate([kept_bucket, batch.column(0).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([kept, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(bucket):
                continue
            done = int(np.searchsorted(bucket, bucket[-1], side="left"))
            yield from links(bucket[:done], prints[:done])
            kept_bucket, kept = bucket[done:], prints[done:]
        yield from links(kept_bucket, kept)

    def links(bucket, prints):
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
        length = np.diff(np.r_[starts, len(bucket)])
        two = starts[length == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius]
        a, b = [prints[two]], [prints[two + 1]]
        for at, n in zip(starts[length > 2].tolist(), length[length > 2].tolist()):
            edges = forest(prints[at: at + n])
            if edges:
                pairs = np.array(edges, dtype=np.uint64)
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        first, second = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second)], ["a", "b"])

    dealt = rows.select("bucket", "print").repartition("bucket").sortWithinPartitions("bucket", "print")
    return dealt.mapInArrow(link, "a bigint, b bigint")


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges between distinct fingerprints that connect exactly what pairs within the radius connect."""
    rows, edges = first_tables(prints), None
    while True:
        open_ = rows.where(F.bit_count("mask") < 64 - FEW_POSITIONS)
        large = stored(open_.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("bucket"))
        if large.isEmpty():
            found = bucket_links(rows, radius)
            return found if edges is None else edges.union(found)
        found = bucket_links(rows.join(large, "bucket", "left_anti"), radius)
        edges = found if edges is None else edges.union(found)
        rows = stored(split_tables(rows.join(large, "bucket", "left_semi")).distinct())


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: the key, ``print`` (signed 64-bit fingerprint) and ``component_id``, the smallest key that
    can be reached over links."""
    rows = stored(docs.select(F.col(key).cast("bigint").alias("id"), fingerprint_udf(F.col(text).cast("string")).alias(
        "print")))
    first = stored(rows.groupBy("print").agg(F.min("id").alias("first")))
    groups = components(links(first.select("print")))
    linked = first.join(groups.select(F.col("node").alias("print"), "component"), "print", "left").select(
        "print", "first", F.coalesce("component", "print").alias("component"))
    names = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = stored(linked.join(names, "component").select("print", "component_id"))
    return rows.join(of_print, "print").select(F.col("id").alias(key), "print", "component_id")


def as_hex(column: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
