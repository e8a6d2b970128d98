"""Numbers of rows in an order over a whole table, without a task that has all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.storage import fresh, materialize


def numbered(rows: DataFrame, order: list[str], into: str) -> DataFrame:
    """``rows`` with ``into``, their place from 1 on by the columns ``order``; rows that are equal in these have places next to
    each other.

    Range partitioning, by splitters that Spark samples, brings the rows in order; a range's rows are counted, and what is
    before it is added to the places in it. Only rows that are equal in all of ``order`` must be in one range.
    """
    part, before = fresh("part", rows), fresh("before", rows)
    ranged = materialize(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(part).agg(F.count("*").alias(before))  # a row for each range
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum(before).over(upto), F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.withColumn(into, place).join(F.broadcast(starts), part).withColumn(into, F.col(into) + F.col(before)).drop(part, before)
