"""Enough tasks for work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    Only an input too small to be split by its files is redistributed: one whose files, by the
    optimizer's statistics of what is read, come to less than one least split per core. Nothing is
    run for that, and a large input is left where it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    least = int(str(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()))
    return df if size >= cores * least else df.repartition(cores)
