"""Global order without a global sort into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.params import MAX_CRAWL_WORKERS
from lexloom.session import written, written_counted

ROWS_PER_RANGE = 1_000_000


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `rn` (1, 2, ...) in the given order, which no two rows share, and `part`, the range the row fell into.

    Rows are stored and counted first: ranges are cut from a sample, which would compute them twice, and their number
    follows that of the rows, so that none grows with the input. The ranges are written out too, since they are read
    twice: for their sizes and for their rows. Only the sizes, one row per range, are added up in one place.
    """
    rows, n = written_counted(rows, "unordered")
    ranges = -(-n // ROWS_PER_RANGE)
    if ranges > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        spread = rows.repartitionByRange(ranges, *order)
    else:
        spread = rows.repartitionByRange(*order)
    spread = written(spread.withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        spread.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    local = spread.withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return local.join(starts, "part").withColumn("rn", F.col("start") + F.col("local")).drop("start", "local")


def crawl_schedule(urls: DataFrame, order: list[str], delay: Column, workers: int = MAX_CRAWL_WORKERS) -> DataFrame:
    """Adds `worker` and `start`: URLs dealt out in order, each starting after its worker's earlier delays.

    The running sum is taken inside each range and shifted by the worker's total over the earlier ranges.
    """
    dealt = numbered(urls, order).withColumn("worker", F.pmod(F.col("rn"), F.lit(workers))).withColumn("delay", delay)
    earlier = Window.partitionBy("worker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("part", "worker")
        .agg(F.sum("delay").alias("total"))
        .select("part", "worker", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("part", "worker").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("inside", F.coalesce(F.sum("delay").over(inside), F.lit(0)))
        .join(offsets, ["part", "worker"])
        .withColumn("start", F.col("offset") + F.col("inside"))
        .drop("offset", "inside", "part")
    )
