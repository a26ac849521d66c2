"""Small learned tables (fits, cut-offs, transition counts) and joins with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.plans.bounds import BROADCAST_BYTES, BROADCAST_ROWS, size_in_bytes
from caseloom.plans.lineage import stored  # noqa: F401

SALTS = 32


def join_model(rows: DataFrame, model: DataFrame, on: list[str], how: str = "inner",
               max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join many rows with a stored model table.

    ``model`` should be a stored table.  Its rows and bytes are counted first: a small one is broadcast; a
    larger one is repeated under ``SALTS`` salts, so a key that holds a third of the rows is
    spread over that many tasks.
    """
    n, size = size_in_bytes(model)
    if n <= max_rows and size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(model), on, how)
    hashable = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(SALTS)))
    copies = model.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                            F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def split_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join (inner or left) rows with a table that has one line per key and its number of
    rows in ``weight``.

    Lines above ``hotRows`` (at most rows / hotRows of them) are broadcast;
    all others meet their rows in a shuffle without hot keys.
    """
    from caseloom.plans.slices import HOT_CONF, _conf

    heavy = table.where(F.col(weight) > _conf(HOT_CONF))
    light = table.where(F.col(weight) <= _conf(HOT_CONF))
    heavy_keys = F.broadcast(heavy.select(*on))
    return (rows.join(F.broadcast(heavy), on)
            .unionByName(rows.join(heavy_keys, on, "left_anti").join(light, on, how)))
