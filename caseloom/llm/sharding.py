"""Sharding by histogram sort, with shards of near equal bytes.

Documents are ordered by the hash of their text, so equal texts stay together. The splitters between shards are found by
counting: every round puts probes into the interval each splitter is known to lie in, counts exactly the bytes below all
probes over all partitions (a handful of numbers per task), and goes on with the interval between two probes, until the
bytes below each splitter are within the tolerance of its target. Then the rows are exchanged once.

A group of equal texts that is heavy against the tolerance would make that impossible, so heavy groups are placed first,
the largest into the emptiest shard, and the splitters of all other rows fill the shards up. There are at most
``shards / tolerance`` heavy groups, whatever the size of the input. A group larger than a shard cannot be held by one;
its rows alone are spread by the hash of their key.

Defined cases: a missing text counts as the empty text (one byte of size); rows that repeat are placed each; an empty
table gives no rows; other columns are not carried. Keys may be missing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import whole_text
from caseloom.plans.lineage import stored

TOLERANCE = 0.002      # of a shard's fair share
PROBES = 24            # per splitter and round
ROWS_PER_CELL = 4096   # rows that are numbered in one piece
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def sizes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key, ``size`` (UTF-8 bytes plus 1), ``text_crc32`` and ``text_key`` (hash of the text)."""
    whole = whole_text(text)
    return docs.select(F.col(key).alias("id"), (F.octet_length(whole) + 1).cast("bigint").alias("size"),
                       F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole).alias("text_key"),
                       F.xxhash64(F.col(key).cast("string"), F.lit(7)).alias("row_key"))


def bytes_below(rows: DataFrame, probes: list[int]) -> list[int]:
    """Exact sums of ``size`` over rows whose ``key`` is below each of the ascending probes."""
    edges = np.array(probes, dtype=np.int64)

    def count(batches):
        total = np.zeros(len(edges) + 1, dtype=np.int64)
        for batch in batches:
            cells = np.searchsorted(edges, batch.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(total, cells, batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                                         ["cell", "bytes"])

    found = rows.select("key", "size").mapInArrow(count, "cell int, bytes bigint").groupBy("cell").agg(
        F.sum("bytes").alias("bytes")).collect()
    total = np.zeros(len(edges) + 1, dtype=object)
    for cell, size in found:
        total[cell] = size
    return list(np.cumsum(total)[:-1])


def splitters(rows: DataFrame, targets: list[float], slack: float, probes: int = PROBES) -> list[int]:
    """Keys such that the bytes of rows with a smaller key are within ``slack`` of each ascending target, or as near as
    the keys allow."""
    spans = [[LOWEST, HIGHEST, 0, None] for _ in targets]  # low, high, bytes below each
    best: list[tuple[float, int]] = [(target, LOWEST) for target in targets]
    while True:
        open_ = [i for i, s in enumerate(spans) if best[i][0] > slack and s[1] - s[0] > 1]
        if not open_:
            return [key for _, key in best]
        wanted = sorted({s[0] + (s[1] - s[0]) * j // (probes + 1) for i in open_ for s in [spans[i]]
                         for j in range(1, probes + 1)} | {spans[i][1] for i in open_ if spans[i][3] is None})
        below = bytes_below(rows, wanted)
        for i in open_:
            span, target = spans[i], targets[i]
            for key, size in zip(wanted, below):
                if abs(size - target) < best[i][0]:
                    best[i] = (abs(size - target), key)
                if size <= target and span[0] < key < span[1]:
                    span[0], span[2] = key, size
                if size > target and span[0] < key <= span[1]:
                    span[1], span[3] = key, size
            if span[3] is None:  # the largest key is not above the target
                span[3] = below[wanted.index(HIGHEST)] if HIGHEST in wanted else 0


def assign(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE, text: str = "text",
           key: str = "doc_id") -> DataFrame:
    """One row per document: the key, ``size, text_crc32, shard`` and ``slot`` (gapless from 0 in its shard)."""
    spark = docs.sparkSession
    table = stored(sizes(docs, text, key))
    total, count = table.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    share = total / shards
    heavy = table.groupBy("text_key").agg(F.sum("size").alias("s")).where(
        F.col("s") > tolerance * share).collect() if total else []
    load, home, spread = [0] * shards, {}, []
    for text_key, size in sorted(heavy, key=lambda r: (-r[1], r[0])):
        if size > share:
            spread.append(text_key)
        else:
            home[text_key] = load.index(min(load))
            load[home[text_key]] += size
    held = spark.createDataFrame([*home.items(), *((k, -1) for k in spread)], "text_key bigint, home int")
    placed = table.join(F.broadcast(held), "text_key", "left")
    light = placed.where("home IS NULL OR home < 0").select(
        F.when(F.col("home") < 0, F.col("row_key")).otherwise(F.col("text_key")).alias("key"), "size")
    room = [max(0.0, share - x) for x in load]
    rest = total - sum(load)
    targets = list(np.cumsum([rest * r / max(sum(room), 1) for r in room])[:-1])
    edges = splitters(light, targets, tolerance * share) if rest else [LOWEST] * (shards - 1)
    edges = [max(edges[: i + 1]) for i in range(len(edges))]
    own = F.when(F.col("home") < 0, F.col("row_key")).otherwise(F.col("text_key"))
    number = sum((F.when(own >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    cells = max(1, -(-count // (shards * ROWS_PER_CELL)))
    rows = placed.select("id", "size", "text_crc32", F.when(F.col("home") >= 0, F.col("home")).otherwise(number).cast(
        "int").alias("shard"), F.pmod(F.col("row_key"), F.lit(cells)).alias("cell"))
    return numbered(rows).withColumnRenamed("id", key)


def numbered(rows: DataFrame) -> DataFrame:
    """Exchange the rows once, by shard and cell, and number them without gaps in their shard."""
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n")).select(
        "shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "text_crc32", "size")) - 1
    return rows.withColumn("inside", inside).join(starts, ["shard", "cell"]).select(
        "id", "size", "text_crc32", "shard", (F.col("start") + F.col("inside")).cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the documents as one folder per shard."""
    docs.join(assigned.select(key, "shard"), key).write.partitionBy("shard").parquet(path)
