"""Cutting lineage through the shared checkpoint folder, spreading narrow scans, and ranks over whole tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, set for this context; only on a single machine may that be unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


class Written:
    """A table in the shared folder, as compact Parquet, until drop()."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
        try:
            df.write.parquet(self.path)
        except BaseException:
            self.drop()
            raise
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Workspace:
    """Tables of one run that go together: kept() writes one, and leaving the block deletes all but those that were handed out."""

    def __init__(self) -> None:
        self.tables: list[Written] = []

    def __enter__(self) -> Workspace:
        return self

    def kept(self, df: DataFrame) -> DataFrame:
        self.tables.append(Written(df))
        return self.tables[-1].df

    def drop(self, *frames: DataFrame) -> None:
        for t in [t for t in self.tables if any(t.df is f for f in frames)]:
            self.tables.remove(t)
            t.drop()

    def hand_out(self, df: DataFrame) -> DataFrame:
        """df, whose table stays until this program ends."""
        _handed_out.extend(t for t in self.tables if t.df is df)
        self.tables = [t for t in self.tables if t.df is not df]
        return df

    def __exit__(self, *_: object) -> None:
        for t in self.tables:
            t.drop()
        self.tables = []


_handed_out: list[Written] = []


def durable(df: DataFrame) -> DataFrame:
    """df as written to the shared folder, once, and read from there; a lost executor costs a reread. The table goes when the program ends."""
    _handed_out.append(Written(df))
    return _handed_out[-1].df


@atexit.register
def _drop_handed_out() -> None:
    for t in _handed_out:
        with contextlib.suppress(Exception):  # the session may be gone
            t.drop()


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly where its scan has fewer partitions than the cluster has cores, so that costly columns keep all of them busy."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df


def whole_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows' places, from 1, under a total order, without gathering them in one task.

    Rows are cut into ranges, which are written; a range's places begin after the
    counts of those before it.
    """
    ranges = df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism * 2, *order).withColumn("range_no", F.spark_partition_id())
    held = durable(ranges)
    before = F.coalesce(F.sum("n").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.groupBy("range_no").agg(F.count("*").alias("n")).select("range_no", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("range_no").orderBy(*order))
    return held.join(F.broadcast(starts), "range_no").withColumn(name, (F.col("before") + own).cast("long")).drop("range_no", "before")
