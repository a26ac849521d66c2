"""Column functions on activity names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ESCAPED_UNDERSCORE = "§€§"
ITERATION_MARK = "_ITERATION_"


def with_lifecycle(name: Column, lifecycle: Column) -> Column:
    """``name_lifecycle``; a missing lifecycle is written as ``null``."""
    return F.concat(name, F.lit("_"), F.coalesce(lifecycle, F.lit("null")))


def escape_underscores(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(ESCAPED_UNDERSCORE))


def unescape_underscores(name: Column) -> Column:
    return F.replace(name, F.lit(ESCAPED_UNDERSCORE), F.lit("_"))


def hash_underscores(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit("#"))


def base_name(name: Column) -> Column:
    """The part before the first ``+``."""
    return F.substring_index(name, "+", 1)


def label_base(name: Column) -> Column:
    """The part before the first ``+`` or iteration mark."""
    return F.substring_index(F.substring_index(name, "+", 1), ITERATION_MARK, 1)
