"""Ordered prefixes (running sums, previous values) without sorting a hot
key in one task.

The rows are dealt by range of (partition keys, order) into as many buckets
as there are shuffle partitions, so a key that holds a third of all rows
spans a third of the buckets, however its order values cluster. Each bucket is
scanned by itself; one row per (key, bucket) carries what earlier buckets
hold, and rows and carries meet again by key and bucket. NULL keys and NULL
order values are rows like any others (NULL first).

Nothing runs while a plan is built. Both uses of the dealt rows read one
exchange: the rows travel as one struct, which both uses count, so column
pruning cannot tell the two apart, and the number of ranges is explicit, so
runtime coalescing cannot either. Rows whose bucket and carry disagree fail
the query: ``dropDuplicates`` on some of the columns right before a running
sum would do that (Spark plans it anew for each use, and so deals twice);
group by these columns instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FRAME = {True: (Window.unboundedPreceding, 0), False: (Window.unboundedPreceding, -1)}


def _sort(names: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in names]


def _dealt(df: DataFrame, values: dict[str, Column], part: list[str], order: Sequence[str | Column],
           descending: bool = False) -> DataFrame:
    """Rows as (_p*: keys, _o*: order, _v*: values, _row) with ``_bucket``."""
    keys = [F.col(c).alias(f"_p{i}") for i, c in enumerate(part)]
    sort = [(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)]
    vals = [v.alias(f"_v{i}") for i, v in enumerate(values.values())]
    row = F.when(F.monotonically_increasing_id() >= 0, F.struct(*[F.col(c) for c in df.columns])).alias("_row")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*_keys(part), *_sort([f"_o{i}" for i in range(len(order))], descending)]
    return df.select(*keys, *sort, *vals, row).repartitionByRange(n, *by).withColumn("_bucket", F.spark_partition_id())


def _keys(part: list[str]) -> list[str]:
    return [f"_p{i}" for i in range(len(part))]


def _with_carry(local: DataFrame, carries: DataFrame, part: list[str]) -> DataFrame:
    """Attach each bucket's carry; keys compare NULL-safe."""
    c = carries.select(*[F.col(k).alias(f"_c{k}") for k in _keys(part)], F.col("_bucket").alias("_cb"),
                       F.struct("*").alias("_carry"))
    on = F.col("_bucket") == F.col("_cb")
    for k in _keys(part):
        on = on & F.col(k).eqNullSafe(F.col(f"_c{k}"))
    return local.join(c, on, "left")


def _checked(value: Column) -> Column:
    """``value``, or an error where a row found no carry of its bucket."""
    lost = F.raise_error(F.lit("the dealt rows were read in two different ways"))
    return F.when(F.col("_carry").isNull(), lost).otherwise(value)


def running_sums(df: DataFrame, values: dict[str, Column], partition: Sequence[str], order: Sequence[str | Column],
                 inclusive: bool = True, descending: bool = False) -> DataFrame:
    """Add, for each ``name: column`` of ``values``, the sum of the column
    over the rows up to (or strictly before) each row."""
    part = list(partition)
    d = _dealt(df, values, part, order, descending)
    sort = _sort([f"_o{i}" for i in range(len(order))], descending)
    inside = Window.partitionBy(*_keys(part), "_bucket").orderBy(*sort).rowsBetween(*_FRAME[inclusive])
    before = Window.partitionBy(*_keys(part)).orderBy("_bucket").rowsBetween(*_FRAME[False])
    names = [f"_v{i}" for i in range(len(values))]
    totals = d.groupBy(*_keys(part), "_bucket").agg(*[F.sum(v).alias(v) for v in names], F.count("_row").alias("_rows"))
    carries = totals.select(*_keys(part), "_bucket", "_rows",
                            *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in names])
    local = d.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_l{v}") for v in names])
    j = _with_carry(local, carries, part)
    return j.select("_row.*", *[_checked(F.col(f"_l{v}") + F.col(f"_carry.{v}")).cast("long").alias(out)
                                for v, out in zip(names, values)])


def exclusive_running_sum(df: DataFrame, value: str, partition: Sequence[str], order: Sequence[str | Column],
                          out: str) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the rows strictly before each row
    (within ``partition``, in ``order``)."""
    return running_sums(df, {out: F.col(value)}, partition, order, inclusive=False)


def running_sum(df: DataFrame, value: str, partition: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """Inclusive running sum of ``value``."""
    return running_sums(df, {out: F.col(value)}, partition, order)


def previous_value(df: DataFrame, value: Column, partition: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add ``out`` = ``value`` of the previous row (within ``partition``, in
    ``order``), NULL for the first row."""
    part = list(partition)
    d = _dealt(df, {"v": value}, part, order)
    sort = [f"_o{i}" for i in range(len(order))]
    inside = Window.partitionBy(*_keys(part), "_bucket").orderBy(*sort)
    before = Window.partitionBy(*_keys(part)).orderBy("_bucket")
    last = d.groupBy(*_keys(part), "_bucket").agg(F.max_by("_v0", F.struct(*sort)).alias("_last"), F.count("_row").alias("_rows"))
    carries = last.select(*_keys(part), "_bucket", F.lag("_last").over(before).alias("v"), "_rows")
    local = d.select("*", F.lag("_v0").over(inside).alias("_lag"), F.row_number().over(inside).alias("_nth"))
    j = _with_carry(local, carries, part)
    return j.select("_row.*", F.when(F.col("_nth") > 1, F.col("_lag")).otherwise(_checked(F.col("_carry.v"))).alias(out))


def last_non_null(df: DataFrame, value: Column, partition: Sequence[str], order: Sequence[str], out: str,
                  include_current: bool = True) -> DataFrame:
    """Add ``out`` = the last non-NULL ``value`` up to each row (or strictly
    before it)."""
    part = list(partition)
    d = _dealt(df, {"v": value}, part, order)
    sort = [f"_o{i}" for i in range(len(order))]
    inside = Window.partitionBy(*_keys(part), "_bucket").orderBy(*sort).rowsBetween(*_FRAME[include_current])
    before = Window.partitionBy(*_keys(part)).orderBy("_bucket").rowsBetween(*_FRAME[False])
    known = F.when(F.col("_v0").isNotNull(), F.struct(*sort))
    last = d.groupBy(*_keys(part), "_bucket").agg(F.max_by("_v0", known).alias("_last"), F.count("_row").alias("_rows"))
    carries = last.select(*_keys(part), "_bucket", F.last("_last", ignorenulls=True).over(before).alias("v"), "_rows")
    local = d.select("*", F.last("_v0", ignorenulls=True).over(inside).alias("_local"))
    j = _with_carry(local, carries, part)
    return j.select("_row.*", F.coalesce("_local", _checked(F.col("_carry.v"))).alias(out))
