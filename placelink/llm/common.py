"""Shared helpers: shared storage, worker set-up, connected components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents and bytes of an Arrow batch: they bound what a Python worker holds at a time (one row at least).
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20

_written: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    env.setdefault("OMP_NUM_THREADS", "1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where the setting is absent and the master is local, as in tests, is a
    folder of this machine used and set as the checkpoint directory; on a
    cluster its absence is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="placelink-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/placelink/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans it
            return


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage and survives lost executors.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._placelink_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table written by :func:`table` that nothing reads any more."""
    path = getattr(df, "_placelink_path", None)
    if path:
        remove(df.sparkSession, path)


def open_store(uri: str):
    """Filesystem and path of a URI of the shared storage."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(id, component)``.

    ``component`` is the smallest id reachable.  Each round every node points
    to the neighbour (or itself) of the least random priority, and the edges
    are contracted along the pointers, so the nodes that are left shrink by a
    constant factor a round whatever the shape of the graph.  A minimum per
    node is pre-aggregated, so a node with very many neighbours is no hot task.
    Only ids that occur in an edge are returned.  Null ids are dropped.
    """
    spark = edges.sparkSession
    edges = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    left = table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    root: DataFrame | None = None
    for turn in range(1000):
        if left.isEmpty():
            break
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("r"), F.col(c).alias("id"))
        near = both.groupBy(F.col("a").alias("id")).agg(F.min(rank("b")).alias("m"))
        hop = near.select("id", F.when(F.struct(F.xxhash64(F.lit(turn), F.col("id")).alias("r"), F.col("id")) < F.col("m"), F.col("id")).otherwise(F.col("m.id")).alias("to"))
        hop = table(hop, "hop")
        if root is None:
            grown = hop.select("id", F.col("to").alias("root"))
        else:
            grown = root.join(hop.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        grown = table(grown, "root")
        a, b = hop.select(F.col("id").alias("a"), F.col("to").alias("ta")), hop.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        short = left.join(a, "a").join(b, "b").where("ta <> tb")
        short = table(short.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        drop(left)
        drop(hop)
        if root is not None:
            drop(root)
        left, root = short, grown
    if root is None:
        return spark.createDataFrame([], "id long, component long")
    least = root.groupBy("root").agg(F.min("id").alias("component"))
    return root.join(least, "root").select("id", "component")
