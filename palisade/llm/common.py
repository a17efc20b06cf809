"""Helpers the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group is hot when it holds more than this share of all rows; so at most its inverse are hot.
HOT_SHARE = 1 / 500


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    That is spark.checkpoint.dir. Only where it is unset and the session is local (tests) a fresh
    temporary folder is used.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffles and checkpoints that no table needs any more.

    Spark deletes their files when the driver collects garbage, which otherwise happens by chance.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let_go() -> None:
    """Give back what Arrow no longer needs in this Python worker, which later work would find taken."""
    pa.default_memory_pool().release_unused()


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def row_key(doc_id: str, text: str) -> Column:
    """Names a row by its id and text; rows equal in both are alike in all results."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.col(text))))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """`rows` left join `groups` (one row a key, `size` of its rows), safe for hot keys.

    Groups with over HOT_SHARE of all grouped rows are fewer than 1 / HOT_SHARE, so broadcasting
    them is bounded; their rows never meet in one task. The rest join by shuffle.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    least = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(groups.where(F.col(size) > least))
    cold = groups.where(F.col(size) <= least)
    return rows.join(hot, keys).unionByName(
        rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, "left"))


class Scratch:
    """Tables of one run in the shared checkpoint folder, each dropped once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
