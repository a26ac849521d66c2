"""Size checks in front of broadcasts and in-row arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def require_at_most(df: DataFrame, rows: int, what: str) -> DataFrame:
    """Raise when a parameter table has more rows than it may."""
    found = df.limit(rows + 1).count()
    if found > rows:
        raise ValueError(f"{what} may have at most {rows} rows")
    return df


def size_in_bytes(df: DataFrame) -> tuple[int, int]:
    """Rows and about the bytes of a stored or cheap table: 16 for every plain
    value, what texts hold, and 16 for every value in an array."""
    extra = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in df.schema.fields
             if f.dataType.simpleString() in ("string", "binary")]
    extra += [F.coalesce(F.size(f.name), F.lit(0)) * 16 * f.dataType.simpleString().count(":") if
              "struct" in f.dataType.simpleString() else F.coalesce(F.size(f.name), F.lit(0)) * 16
              for f in df.schema.fields if f.dataType.simpleString().startswith("array")]
    row = F.lit(16 * len(df.columns))
    for part in extra:
        row = row + part
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row.cast("bigint")), F.lit(0))).first()
    return n, size
