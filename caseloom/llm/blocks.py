"""Vectors as bytes, and tables dealt in blocks: the rows of a block first, then whatever is held against them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

PIECE = 512  # rows that are held against a block at a time


def finite(vector: str):
    """Whether a vector is there and all its components are finite numbers."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


def as_bytes(rows: DataFrame, vector: str = "x") -> DataFrame:
    """The rows with ``vec``, the bytes of the doubles of ``vector``, in its place."""
    names = [c for c in rows.columns if c != vector]
    schema = StructType([rows.schema[c] for c in names] + [StructField("vec", rows.selectExpr("binary('') AS b").schema["b"].dataType)])

    def pack(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(vector))
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            body = [flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(body, pa.binary())], [*names, "vec"])

    return rows.withColumn(vector, F.col(vector).cast("array<double>")).mapInArrow(pack, schema)


def matrix(column) -> np.ndarray:
    """Vectors of one length from a column of bytes."""
    body = column.to_pylist()
    return np.frombuffer(b"".join(body), dtype=np.float64).reshape(len(body), len(body[0]) // 8 if body else 0)


def against_blocks(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (side 0) and what is asked of them (side 1), with the same columns behind ``at``, block by block."""
    both = rows.withColumn("side", F.lit(0)).unionByName(asked.withColumn("side", F.lit(1)), allowMissingColumns=True)
    names = ["at", "side", *(c for c in both.columns if c not in ("at", "side"))]
    return both.select(names).repartition("at").sortWithinPartitions("at", "side")


def dealt(batches):
    """Of sorted batches: the block's number, the table of its rows, and a piece of what is asked of them."""
    at, held, table = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (side[1:] != side[:-1])) + 1, len(key)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if key[a] != at:
                at, held, table = key[a], [], None
            if side[a] == 0:
                held.append(batch.slice(a, b - a))
            elif held:
                table = pa.Table.from_batches(held).combine_chunks() if table is None else table
                for low in range(a, b, PIECE):
                    yield int(at), table, batch.slice(low, min(PIECE, b - low))


def exact_products(left: np.ndarray, i: np.ndarray, right: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of chosen rows, summed component by component."""
    total = np.zeros(len(i))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(left.shape[1]):
            total += left[i, d] * right[j, d]
    return total
