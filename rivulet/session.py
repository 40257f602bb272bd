"""Session, input tables and the shared work folder.

Every write this library makes (partitioned tables, topic files, stream
checkpoints, lineage cuts) lands under the folder the cluster names in
``spark.checkpoint.dir``.  Only when that setting is absent -- a laptop or a
unit test -- do we create a private folder and register it as the checkpoint
directory, so that ``DataFrame.checkpoint()`` and our tables share one root.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster passes its own session instead."""
    builder = SparkSession.builder.appName("rivulet")
    if master:
        builder = builder.master(master)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def _checkpoint_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        current = sc.getCheckpointDir()
        if current:
            # SparkContext appends a per-application uuid folder; use its parent.
            root = current.rstrip("/").rsplit("/", 1)[0]
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="rivulet-ckpt-")
        sc.setCheckpointDir(root)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def _hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Spark's own file access; small metadata calls from the driver only."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint root for one job's output.

    It belongs to the application: the driver's JVM deletes it when it ends.
    """
    root = _checkpoint_root(spark)
    path = f"{root.rstrip('/')}/rivulet-work/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    fs, p = _hadoop_path(spark, path)
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p.getParent())
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    return _checkpoint_root(spark)


def is_committed(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` ran to its end (its ``_SUCCESS`` mark is there)."""
    fs, p = _hadoop_path(spark, f"{path.rstrip('/')}/_SUCCESS")
    return fs.exists(p)


def publish(spark: SparkSession, staged: str, path: str) -> bool:
    """Give a finished folder its final name, unless something has that name: one step, won by one writer.

    False means that ``path`` was there already; ``staged`` is left as it is.
    The rename is that of the file system (HDFS and POSIX decide it for one
    of several writers); it never replaces or merges folders.
    """
    fs, src = _hadoop_path(spark, staged)
    _, dst = _hadoop_path(spark, path)
    fs.mkdirs(dst.getParent())
    sc = spark.sparkContext
    none = sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(src), fs.makeQualified(dst), none)
    except Py4JJavaError:
        if not fs.exists(dst):
            raise
        return False
    return True


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop_path(spark, path)
    fs.delete(p, True)


def _numbered_folders(spark: SparkSession, path: str, column: str) -> list[int]:
    fs, p = _hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{column}="))


def committed_values(spark: SparkSession, path: str, column: str, above: int = -1) -> list[int]:
    """The numbers ``v > above`` of the folders ``path/column=v`` whose writes ran to their end, ascending."""
    return [v for v in _numbered_folders(spark, path, column) if v > above and is_committed(spark, f"{path.rstrip('/')}/{column}={v}")]


def last_committed(spark: SparkSession, path: str, column: str) -> int | None:
    """The largest such number, or None.

    Used to restore a counter (a positions version, a batch number) after a
    restart, so it never lives only in driver memory; a half-written folder
    does not count.
    """
    folders = reversed(_numbered_folders(spark, path, column))
    return next((v for v in folders if is_committed(spark, f"{path.rstrip('/')}/{column}={v}")), None)


def input_mark(spark: SparkSession, path: str) -> str:
    """Newest change time and size of a table folder or file: derived tables are kept under it."""
    fs, p = _hadoop_path(spark, path)
    status = fs.getFileStatus(p)
    return f"{status.getModificationTime()}-{fs.getContentSummary(p).getLength()}"
