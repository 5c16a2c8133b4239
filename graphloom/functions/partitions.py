"""How rows are dealt out before work that takes much more time than reading."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Larger inputs are never dealt out anew: at this size and above, files and their row groups give work enough.
MOST_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is small and is read in fewer partitions than there are cores.

    A file may be one row group, which one task reads however it is split, so a few files would keep a few
    cores busy. What is shuffled is bounded by MOST_BYTES, by the optimizer's estimate of the input, which
    for files is their size; other and larger inputs stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if estimate <= MOST_BYTES and 0 < len(df.inputFiles()) < cores else df
