"""Dense 0-based ordinals over a total order without a single-partition window.

``row_number()`` over an un-partitioned window moves every row into one
task.  Instead: range-partition on the order key (sampled bounds, so a
hot value range is split), sort inside partitions, take the in-partition
offset from ``monotonically_increasing_id`` (partition id in the upper
bits), and add the running row count of the preceding partitions.

The ranged frame is checkpointed to the shared checkpoint folder before it
is used twice (offset table + rows): partition ids must be identical in
both uses, which a recomputation under AQE coalescing or after an
executor loss would not guarantee.  The per-partition count table has one
row per partition -- bounded by the partition count, not the data -- so
broadcasting it is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import checkpoint_dir


def with_ordinal(df: DataFrame, order_cols: list[str], name: str = "idx",
                 num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order_cols`` order.

    ``order_cols`` must be a total order (unique).  Select only the columns
    you need before calling: the checkpoint writes them once.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
              .checkpoint(eager=True))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid")
                                    .rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid", "left")
            .withColumn(name, (F.col("_off") + F.col("_local")).cast("bigint"))
            .drop("_pid", "_local", "_off"))
