"""Intermediate tables in the shared folder, which outlive executors."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that ``written`` has made and ``forget`` has not removed.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the session's ``spark.checkpoint.dir``, and only where that is unset (tests) a folder of the
    warehouse, which a cluster shares too."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return str(context.getCheckpointDir())


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, whose files outlive executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read again: smaller than a checkpoint for wide or many rows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.parquet(path)


def free(spark: SparkSession) -> None:
    """Have Spark remove the shuffles and checkpoints that no frame refers to any more; it does so when the driver collects its
    garbage, which a driver with little to do may put off until disks are full."""
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """What ``free`` does, and executors give unused heap back too."""
    free(spark)
    trim(spark)


def trim(spark: SparkSession) -> None:
    """Have executors collect their garbage, as a full collection shrinks the heap: what one step has grown it to would else
    stay beside the Python workers of the next. One short task an executor, as idle ones are dealt tasks in turn; a hint only."""
    n = max(1, len(spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()) - 1)  # the driver is among them
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").collect()


def mark() -> int:
    """A place in the list of tables, for ``forget``."""
    return len(_made)


def forget(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Remove the tables written from one mark to another; nothing that is still to be computed may read them."""
    for path in _made[since:until]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _made[since:until]
