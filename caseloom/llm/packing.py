"""Packing by concatenating and cutting.

All documents form one stream of tokens, each document followed by an end id; the stream is cut every ``size`` tokens,
so only the last sequence has padding. Two passes: the first encodes every document once and writes its ids with the
number of tokens before it in its partition (the written table fixes the order, so retried tasks cannot change it); the
totals per partition, one number each, give every partition its place in the stream; the second pass cuts each document
at the window edges and writes one boundary record per piece. Nothing is shuffled, no task sees more than a batch.

Defined cases: a missing text packs as the empty text (its end id alone); rows that repeat are packed each; a document
longer than a sequence continues in the next ones; an empty table gives no pieces. Other columns are not carried.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.bpe import Vocabulary
from caseloom.plans.lineage import new_folder

SEQUENCE = 2048
END_ID = 1
BATCH_BYTES = 4_000_000


def token_table(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """Pass one, written: ``part``, ``before`` (tokens of the partition before the document), the key, ``n`` and
    ``ids`` (little-endian unsigned 32-bit)."""
    spark, vocabulary, last = docs.sparkSession, Vocabulary(docs.sparkSession, path), end_id.to_bytes(4, "little")
    kind = docs.schema[key].dataType.simpleString()

    def number(batches):
        part, before, encode = TaskContext.get().partitionId(), 0, vocabulary.codec().encode_texts
        for batch in batches:
            at, held, filled = 0, [], 0
            for ids in encode(t.as_py() for t in batch.column(1)):
                held.append(ids + last)
                filled += len(held[-1])
                if filled >= BATCH_BYTES or at + len(held) == batch.num_rows:
                    n = np.fromiter(map(len, held), np.int64, len(held)) // 4
                    start = before + np.cumsum(n) - n
                    before += int(n.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), part, np.int32)), pa.array(start), batch.column(0).slice(at, len(n)),
                         pa.array(n), pa.array(held, pa.binary())], ["part", "before", "key", "n", "ids"])
                    at, held, filled = at + len(held), [], 0

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        number, f"part int, before bigint, key {kind}, n bigint, ids binary")
    place = new_folder(spark, "tokens")
    rows.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(rows.schema).parquet(place)


def place_documents(tokens: DataFrame) -> DataFrame:
    """Global ``first`` of every document from the totals per partition (the driver holds one number per partition)."""
    spark, first, rows = tokens.sparkSession, 0, []
    for part, total in sorted(tuple(r) for r in tokens.groupBy("part").agg(F.sum("n")).collect()):
        rows.append((part, first))
        first += total
    offsets = spark.createDataFrame(rows, "part int, offset bigint")
    return tokens.join(F.broadcast(offsets), "part").withColumn("first", F.col("offset") + F.col("before"))


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, text: str = "text", key: str = "doc_id",
         end_id: int = END_ID) -> DataFrame:
    """One row per piece: the key, ``start, length, doc_tokens, sequence_id, offset`` and the ``ids`` of the piece."""
    kind = docs.schema[key].dataType.simpleString()
    placed = place_documents(token_table(docs, path, text, key, end_id)).select("key", "first", "n", "ids")

    def cut(batches):
        for batch in batches:
            out, filled = [], 0
            for key_, first, n, ids in zip(*(batch.column(i) for i in range(4))):
                key_, first, n, ids = key_.as_py(), first.as_py(), n.as_py(), ids.as_py()
                at = 0
                while at < n:
                    offset = (first + at) % size
                    length = min(n - at, size - offset)
                    out.append((key_, at, length, n, (first + at) // size, offset, ids[4 * at: 4 * (at + length)]))
                    at += length
                    filled += 4 * length
                    if filled >= BATCH_BYTES:
                        yield _pieces(out, batch.schema.field(0).type)
                        out, filled = [], 0
            if out:
                yield _pieces(out, batch.schema.field(0).type)

    return placed.mapInArrow(cut, f"{key} {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
                                  "offset bigint, ids binary")


def _pieces(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    types = [key_type, *[pa.int64()] * 5, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def with_crc(pieces: DataFrame) -> DataFrame:
    """Add ``ids_crc32``, the unsigned crc32 of the ids of a piece."""
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, length, ids``. A group is one sequence, at most its size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select(
        "sequence_id", "length", F.expr("aggregate(p, CAST('' AS BINARY), (a, x) -> concat(a, x.ids))").alias("ids"))


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
