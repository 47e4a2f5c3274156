"""Numbers from 1 in a total order, without a window over all rows: each task numbers its own range, counts are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.sources.tables import shared_path

#: Fixed value: a row's id holds its place in its partition in so many bits, the partition above them.
BITS = 33


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str) -> tuple[DataFrame, str]:
    """(``df`` with ``name``, path of the table that it reads): numbers from 1 within each group of ``by`` by ``order``.

    Rows are dealt into ranges of (by, order) and sorted there, so a group of any size is split and one range is one
    task's work; the sorted ranges are written once. What a group has in earlier ranges is added from a table of one row a
    range and group. Without ``by`` all rows are one group. Nulls of ``by`` are a group; ties take numbers in any order; no
    rows give no rows. A column
    called ``name`` is replaced. The path is to be deleted once the result was read."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "numbered")
    mark = "_"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    row, part, group, shift = (f"{mark}{c}" for c in ("row", "part", "group", "shift"))
    keys = [F.col(c).asc() for c in by] + order
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn(part, F.shiftright(row, BITS)).withColumn(group, F.struct(*by) if by else F.lit(0))
    held = rows.groupBy(part, group).agg(F.count("*").alias("n"), F.min(row).alias("first"))
    before = W.partitionBy(group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    shifts = held.select(part, group, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias(shift))
    met = rows.alias("l").join(shifts.alias("r"), (F.col(f"l.{part}") == F.col(f"r.{part}")) & F.col(f"l.{group}").eqNullSafe(F.col(f"r.{group}")))
    return met.select(*(F.col(f"l.{c}") for c in df.columns if c != name), (F.col(row) + F.col(shift)).alias(name)), path
