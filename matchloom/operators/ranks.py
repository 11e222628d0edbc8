"""Numbers of rows in one order over a whole table, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.session import materialize


def global_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with ``name``, 1 for the first row in ``order``.

    Rows are dealt to partitions by range and written; a row's number is its number in
    its partition and the rows of the partitions before, a table of one row for each.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offset = ranged.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__nth", nth).join(F.broadcast(offset), "__part").withColumn(name, (F.col("__nth") + F.col("__offset")).cast("long")).drop("__part", "__nth", "__offset")
