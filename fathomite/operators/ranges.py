"""Numbers, running sums and totals by order, of a whole table or of its groups, without a task that sees a whole group.

Rows are dealt out by ranges of the order (by group first, where there are groups), sorted inside each range and
written. A row's number inside its range is then known, and what lies before a range follows from the figures of the
ranges: one row for each range, or for each range and the group at either of its ends. So a group that holds most of a
table is spread over as many tasks as its rows need, and what is broadcast has two rows for each range at most.

Rows that are equal in all that they are ordered by lie in one range, so callers give an order that tells rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import materialize

_RANGE = 33  # bits of monotonically_increasing_id that number the rows of a partition


def in_order(rows: DataFrame, by: list[Column | str], ranges: int | None = None, tag: str = "order") -> DataFrame:
    """``rows`` as a table written in the order of ``by``, with the range (_part) and the place in it from 0 (_at).

    The number of ranges is that of a shuffle's partitions unless given. Bounds come from a sample that Spark takes of
    ``rows``, which are therefore read twice; the caller writes them before where that is dear.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = dealt.withColumns({"_part": F.shiftright("_at", _RANGE), "_at": F.col("_at").bitwiseAND(F.lit((1 << _RANGE) - 1))})
    return materialize(placed, tag)


def numbered(rows: DataFrame, by: list[Column | str], name: str = "n", tag: str = "order") -> DataFrame:
    """``rows`` with their number from 1 in the order of ``by``. One shuffle; null order values come where ``by`` puts
    them, an empty table gives none."""
    written = in_order(rows, by, tag=tag)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return written.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")


def running(rows: DataFrame, group: list[str], by: list[Column | str], value: str | None = None, upto: str = "upto", total: str | None = None, tag: str = "order") -> DataFrame:
    """``rows`` with the running sum (itself included) of ``value`` in their group, and the group's sum as ``total``.

    Without ``value`` rows are counted, so that ``upto`` is the number of a row in its group, from 1. A null group is a
    group; a null value counts as 0, and integers stay integers. Sums of floating point depend on the ranges and should
    not be compared exactly.
    """
    written = in_order(rows, [*group, *by], tag=tag)
    own = F.lit(1).cast("bigint") if value is None else F.coalesce(F.col(value), F.lit(0))
    key = F.struct(*group)
    ends = written.groupBy("_part").agg(F.min_by(key, "_at").alias("_first"), F.max_by(key, "_at").alias("_last"))
    # A group that reaches beyond a range lies at one of its ends; these are the only figures that ranges hand on.
    at_ends = written.join(F.broadcast(ends), "_part").filter(key.eqNullSafe(F.col("_first")) | key.eqNullSafe(F.col("_last")))
    edges = at_ends.groupBy("_part", *group).agg(F.sum(own).alias("_sum"))
    same = Window.partitionBy(*group)
    before = same.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(F.col("_part").alias("_edge"), key.alias("_key"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried"), F.sum("_sum").over(same).alias("_all"))
    inside = Window.partitionBy("_part", *group)
    local = written.withColumn("_own", F.sum(own).over(inside.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    if total is not None:
        local = local.withColumn("_total", F.sum(own).over(inside))
    met = local.join(F.broadcast(edges), (F.col("_part") == F.col("_edge")) & key.eqNullSafe(F.col("_key")), "left")
    made = met.withColumn(upto, F.col("_own") + F.coalesce("_carried", F.lit(0)))
    if total is not None:
        made = made.withColumn(total, F.coalesce("_all", "_total"))
    return made.select(*rows.columns, upto, *([total] if total is not None else []))
