"""Ordered computations that never put one hot key into one task.

A plain ``Window.partitionBy(case).orderBy(pos)`` sends a whole case to one
task.  A case, user or activity may hold a third of all rows, so ordered
operators use four shapes instead:

``sweep``       running values over any order, of all rows or of keys; what is
                too large for one task is range-partitioned by its full order
                (the splitters are drawn from the data) and the totals of the
                cells are prefix-combined.
``positions``   dense row numbers, by a sweep that counts.
``neighbours``  lag/lead over a dense order column, cut into fixed-length
                slices; the rows at a slice edge are copied to the next slice.
``running``     running sum/max/xor/last over ordered buckets: totals per
                bucket are prefix-combined, then added to the in-bucket window.

Slices are functions of the data only, so a retried task sees the same ones.
Key columns must not be null (``as_log`` names a missing case or activity '').
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.plans.lineage import reusable, stored

SLICE_CONF = "spark.caseloom.sliceRows"
HOT_CONF = "spark.caseloom.hotRows"
CELL_CONF = "spark.caseloom.cellRows"
DEFAULT_ROWS = 1_000_000


def _conf(name: str) -> int:
    return int(SparkSession.active().conf.get(name, str(DEFAULT_ROWS)))


def slice_rows() -> int:
    """Rows per slice of a dense order column."""
    return _conf(SLICE_CONF)


def slice_of(order: str = "pos") -> Column:
    """Slice number of a dense 1-based order column."""
    return F.expr(f"({order} - 1) div {slice_rows()}")


_COMBINE = {
    "sum": lambda before, own: F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0)),
    "xor": lambda before, own: F.coalesce(before, F.lit(0).cast("bigint")).bitwiseXOR(
        F.coalesce(own, F.lit(0).cast("bigint"))),
    "max": lambda before, own: F.greatest(before, own),
    "min": lambda before, own: F.least(before, own),
    "last": lambda before, own: F.coalesce(own, before),
}


def _aggregate(op: str, col: Column, order: list[str], windowed: bool) -> Column:
    if op == "sum":
        return F.sum(col)
    if op == "xor":
        return F.bit_xor(col)
    if op == "max":
        return F.max(col)
    if op == "min":
        return F.min(col)
    if op == "last":
        if windowed:
            return F.last(col, ignorenulls=True)
        key = F.struct(*[F.col(c) for c in order])
        return F.max_by(col, F.when(col.isNotNull(), key))
    raise ValueError(f"unknown running operation {op!r}")


def running(
    df: DataFrame,
    keys: list[str],
    buckets: list[str],
    order: list[str],
    cols: dict[str, tuple[str, Column]],
    exclusive: bool = False,
    full_bucket_rows: int | None = None,
    overall: dict[str, tuple[str, Column]] | None = None,
    carry_for: DataFrame | None = None,
) -> DataFrame:
    """Add running aggregates over ``order`` within ``keys``.

    ``buckets`` are columns, coarse to fine, that grow with ``order``.  Totals
    per finest bucket (combined before the shuffle) get their own running
    value over the coarser buckets, and each row adds its in-bucket window.
    ``full_bucket_rows`` says a bucket is followed by another one only when it
    holds exactly that many rows, so the totals of all others are dropped.
    ``exclusive`` leaves out the current row.  ``overall`` adds sums or maxima
    over the whole key, taken over the bucket totals if there are any, so no
    row meets all rows of its key (needs no ``full_bucket_rows``).  ``carry_for``
    lists the (few) keys with more than one bucket; no totals are taken for others.
    """
    overall = overall or {}
    if buckets:
        span = Window.partitionBy(*keys, *buckets).orderBy(*order)
    else:
        span = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    frame = span.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    windowed = {name: _aggregate(op, col, order, True).over(frame) for name, (op, col) in cols.items()}
    if not buckets:
        whole = Window.partitionBy(*(keys or [F.lit(0)]))
        return df.withColumns({n: F.coalesce(c, F.lit(0)) if cols[n][0] in ("sum", "xor") else c
                               for n, c in windowed.items()} | {
            n: _aggregate(op, col, order, True).over(whole) for n, (op, col) in overall.items()})
    own = df.withColumns(windowed)

    sources = df if carry_for is None else df.join(F.broadcast(carry_for), carry_for.columns, "left_semi")
    totals = sources.groupBy(*keys, *buckets).agg(
        *[_aggregate(op, col, order, False).alias(f"_t_{n}") for n, (op, col) in cols.items()],
        *[_aggregate(op, col, order, False).alias(f"_o_{n}") for n, (op, col) in overall.items()],
        F.count(F.lit(1)).alias("_rows"))
    if overall:
        whole = Window.partitionBy(*(keys or [F.lit(0)]))
        totals = totals.withColumns({
            f"_o_{n}": _aggregate(op, F.col(f"_o_{n}"), order, True).over(whole) for n, (op, _) in overall.items()})
    if full_bucket_rows is not None:
        totals = totals.where(F.col("_rows") == full_bucket_rows)
        # the value carried into a bucket is the inclusive value of the one before
        carried = running(totals, keys, buckets[:-1], [buckets[-1]],
                          {f"_b_{n}": (op, F.col(f"_t_{n}")) for n, (op, _) in cols.items()})
        step = 1
    else:
        carried = running(totals, keys, buckets[:-1], [buckets[-1]],
                          {f"_b_{n}": (op, F.col(f"_t_{n}")) for n, (op, _) in cols.items()},
                          exclusive=True)
        step = 0
    last = F.col(buckets[-1])
    carried = carried.select(*keys, *buckets[:-1], (last + step if step else last).alias(buckets[-1]),
                             *[f"_b_{n}" for n in cols], *[f"_o_{n}" for n in overall])
    out = own.join(carried, keys + buckets, "left")
    kept = [c for c in df.columns if c not in cols and c not in overall]
    return out.select(*kept, *[_COMBINE[op](F.col(f"_b_{n}"), F.col(n)).alias(n) for n, (op, _) in cols.items()],
                      *[F.col(f"_o_{n}").alias(n) for n in overall])


def running_dense(df: DataFrame, keys: list[str], order: str,
                  cols: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """``running`` over a dense 1-based order column, cut into equal slices."""
    sliced = df.withColumn("_slice", slice_of(order))
    return running(sliced, keys, ["_slice"], [order], cols, exclusive,
                   full_bucket_rows=slice_rows()).drop("_slice")


def long_cases(log: DataFrame) -> DataFrame:
    """Cases with more than one slice: at most (events / slice rows) of them,
    which bounds their broadcast.  On a stored log the filter is pushed down."""
    return log.where(F.col("pos") > slice_rows()).select("case_id").distinct()


def running_in_case(df: DataFrame, keys: list[str], cols: dict[str, tuple[str, Column]], exclusive: bool = False,
                    log: DataFrame | None = None) -> DataFrame:
    """``running`` by position within ``case_id`` and further keys.  Only cases
    with more than one slice have totals to carry; ``log`` is the table to find
    them in (default: the rows themselves)."""
    sliced = df.withColumn("_slice", slice_of("pos"))
    return running(sliced, ["case_id", *keys], ["_slice"], ["pos"], cols, exclusive,
                   carry_for=long_cases(df if log is None else log)).drop("_slice")


def neighbours(df: DataFrame, keys: list[str], order: str,
               cols: dict[str, tuple[Column | str, int]]) -> DataFrame:
    """Add columns read from the row ``offset`` places before (positive) or
    after (negative) in a dense 1-based order within ``keys``."""
    back = max([o for _, o in cols.values() if o > 0], default=0)
    ahead = max([-o for _, o in cols.values() if o < 0], default=0)
    rows = max(slice_rows(), back, ahead)
    home = F.expr(f"({order} - 1) div {rows}")
    slot = F.expr(f"({order} - 1) % {rows}")
    targets = [home]
    if back:
        targets.append(F.when(slot >= rows - back, home + 1))
    if ahead:
        targets.append(F.when(slot < ahead, home - 1))
    spread = df.withColumn("_slice", F.explode(F.array_compact(F.array(*targets))))
    span = Window.partitionBy(*keys, "_slice").orderBy(order)
    out = spread.withColumns({
        name: F.lag(F.col(col) if isinstance(col, str) else col, offset).over(span)
        for name, (col, offset) in cols.items()})
    return out.where(F.col("_slice") == home).drop("_slice")


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys with more than ``hotRows`` rows, at most (rows / hotRows) of them; None if there is none."""
    hot = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > _conf(HOT_CONF)).select(*keys))
    return None if hot.isEmpty() else hot


def cells(rows: DataFrame, order: list[str]) -> DataFrame:
    """A stored copy of the rows with ``_cell``, a number that grows with ``order``.

    The rows are range-partitioned by the full order, into cells of about half of ``cellRows`` rows however values and
    ties are spread; the splitters come from a sample that Spark draws, and since the copy is stored, all readers see the
    same cells.
    """
    parts = -(-2 * rows.count() // int(SparkSession.active().conf.get(CELL_CONF, str(_conf(HOT_CONF)))))
    return stored(rows.repartitionByRange(max(parts, 1), *order).withColumn("_cell", F.spark_partition_id()))


def sweep(df: DataFrame, keys: list[str], order: list[str], cols: dict[str, tuple[str, Column]], exclusive: bool = False,
          overall: dict[str, tuple[str, Column]] | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``running`` over any order within ``keys`` (none: over all rows), without buckets to name.

    Keys of at most ``hotRows`` rows stay whole. All others are put into ``cells`` by key and order, whose totals are
    prefix-combined; so neither many rows of one key nor many rows of one time or value meet in a task.
    ``counted`` is a cheap table with the keys of at least as many rows: if it has no hot key, no copy of the rows is made.
    """
    if counted is not None and hot_keys(counted, keys) is None:
        return running(df, keys, [], order, cols, exclusive, overall=overall)
    rows = reusable(df)
    if keys:
        hot = hot_keys(rows, keys)
        heavy = None if hot is None else rows.join(F.broadcast(hot), keys, "left_semi")
        light = rows if hot is None else rows.join(F.broadcast(hot), keys, "left_anti")
    else:
        many = rows.count() > _conf(HOT_CONF)
        heavy, light = (rows, None) if many else (None, rows)
    out = []
    if light is not None:
        out.append(running(light, keys, [], order, cols, exclusive, overall=overall))
    if heavy is not None:
        out.append(running(cells(heavy, [*keys, *order]), keys, ["_cell"], order, cols, exclusive,
                           overall=overall).drop("_cell"))
    return out[0].unionByName(out[1]) if len(out) > 1 else out[0]


def positions(df: DataFrame, keys: list[str], order: list[str], out: str, counted: DataFrame | None = None) -> DataFrame:
    """Dense 1-based row numbers by ``order`` within ``keys``."""
    kept = [c for c in df.columns if c != out]
    placed = sweep(df.select(*kept), keys, order, {out: ("sum", F.lit(1))}, counted=counted)
    return placed.select(*kept, F.col(out).cast("bigint").alias(out))


def with_case_values(log: DataFrame, **aggregates: Column) -> DataFrame:
    """Add per-case aggregates to every event of the case.

    The per-case row is repeated once per slice of the case and joined on
    (case, slice), so a long case is spread over tasks.
    """
    per_case = log.groupBy("case_id").agg(
        F.max("pos").alias("_last"), *[col.alias(name) for name, col in aggregates.items()])
    return attach_cases(log, per_case, "_last").drop("_last")


def attach_cases(log: DataFrame, cases: DataFrame, length: str) -> DataFrame:
    """Inner join a one-row-per-case table with column ``length`` (events in
    the case) to the events, spread by slice."""
    spread = cases.withColumn(
        "_slice", F.explode(F.expr(f"sequence(0L, (`{length}` - 1) div {slice_rows()})")))
    return (log.withColumn("_slice", slice_of("pos"))
            .join(spread, ["case_id", "_slice"]).drop("_slice"))
