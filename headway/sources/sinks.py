"""Writers (K1-K3, K7). Models are saved in ``headway.ml``; stream sinks in ``headway.streaming``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def write_by_horizon(df: DataFrame, path: str, k_col: str = "k") -> None:
    """K1: snappy Parquet, one directory per horizon ``k``; the target is replaced.

    Rows are rebalanced by ``k``: adaptive execution sees each horizon's real size and cuts a large one
    into several tasks, while small ones share a task, whatever the spread of the horizons."""
    (df.hint("rebalance", k_col).write.mode("overwrite").partitionBy(k_col)
       .option("compression", "snappy").parquet(path))


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """K2: train/test as one table partitioned by the split label."""
    df.write.mode("overwrite").partitionBy(split_col).option("compression", "snappy").parquet(path)


def write_state(state: DataFrame, path: str) -> None:
    """K3: persist the historical (keys, sum, n) table between runs."""
    state.write.mode("overwrite").parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def persist_state(spark: SparkSession, state: DataFrame, name: str) -> DataFrame:
    """Write ``state`` under the shared checkpoint folder and return the re-read table
    (cuts lineage: the test run depends on files, not on the train plan)."""
    path = scratch_path(spark, name)
    write_state(state, path)
    return read_state(spark, path)


def append_table(df: DataFrame, path: str, partition_cols=()) -> None:
    """K7: bulk append (e.g. the ping table)."""
    w = df.write.mode("append")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)
