"""Small helpers over whole DataFrames."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a table's files for a partition, and partitions at most.
EACH, MOST = 8 << 20, 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only where all runs in one process may it be unset: a temporary folder then."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """df written into the shared folder and read back.

    For what several steps read: it is computed once, and its plan begins at files that lost executors don't take along.
    rows: of a file at most. Parquet stores some tables in a few bytes a row, so that a task that reads 128 MB would meet
    tens of millions; as a file counts for 4 MB at least, a task then reads 32 files at most.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def best_rows(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key with rank (from 0).

    The bound is on row_number() itself: then Spark keeps k rows of a key before the exchange and in it, so that no task
    sorts all rows of a hot key.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).filter(F.col("__place") <= k).withColumn("rank", F.col("__place") - 1).drop("__place")


def union(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """All rows, columns by name.

    Spark 4.1 zips the partitions of inputs that are partitioned alike, and then fails where adaptive execution has joined
    small partitions differently on either side; so a union here only ever concatenates. Spark reads the setting when the
    plan runs, so it stays for the session.
    """
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for df in rest:
        first = first.unionByName(df)
    return first


def _pieces(df: DataFrame) -> int:
    """Its files' size by EACH; 0 where Spark doesn't know it (its guess is huge then)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(size // EACH, MOST) if size < 1 << 50 else 0


def parts_of(df: DataFrame) -> int:
    """How many partitions to deal df's rows to by a key: one for each 8 MiB below it, and no fewer than shuffles have."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), _pieces(df))


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it comes in no more: a small table, whose file may be one row group.

    A table of texts is many times as large in memory as its file, and a word is a row in many steps; so where splits are
    large, partitions hold about 8 MiB of a file each.
    """
    cores, own = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    wanted = max(cores, _pieces(df))
    return df.repartition(wanted) if own <= cores or 2 * own < wanted else df
