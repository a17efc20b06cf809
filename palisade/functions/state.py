"""Intermediate results that several branches of one job read."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_of_thread = threading.local()


def _made(let_go: Callable[[], object]) -> None:
    """Note how to let go of an intermediate, for the end of the step that is open, if one is."""
    if (open_ := getattr(_of_thread, "step", None)) is not None:
        open_.append(let_go)


def pin(df: DataFrame) -> DataFrame:
    """Keep a reused intermediate; lost blocks are recomputed from lineage."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _made(kept.unpersist)
    return kept


def counted(df: DataFrame) -> DataFrame:
    """Keep a small side of joins now, so that Spark knows its size when it plans them: what fits its
    limit is broadcast, and the rows it meets stay where they are."""
    kept = pin(df)
    kept.count()
    return kept


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    file = kept._jdf.queryExecution().logical().rdd().getCheckpointFile()
    _made(lambda: _delete(df.sparkSession, file.get()))
    return kept


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder by columns, compressed, and cut its lineage: text that a checkpoint
    writes row by row as it is takes half the room, and readers meet only the columns they name."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    _made(lambda: _delete(spark, folder))
    return spark.read.schema(df.schema).parquet(folder)


def finished(make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """The tables `make` gives, stored. All it kept on the way (pins, checkpoints, stored tables and the shuffles
    behind them) is let go of, so that the steps of a job take the disk of the largest, not of all."""
    outer, own = getattr(_of_thread, "step", None), []
    _of_thread.step = own
    try:
        tables = make()
        _of_thread.step = outer  # what is stored now belongs to the step around
        kept = tuple(stored(t) for t in tables)
    finally:
        _of_thread.step = outer
        while own:
            own.pop()()
    spark = kept[0].sparkSession
    del make, tables
    # Spark deletes the files of shuffles when the driver collects garbage, which otherwise happens by chance
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return kept


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
