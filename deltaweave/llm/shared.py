"""The folder that driver and executors share, and tables and files written there.

Lineage is cut by writing a table to that folder and reading it again, so a lost
executor costs a re-read and never a recomputation of what came before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as the session names it. Where it is unset, a temporary one in local runs; on a cluster, whose executors
    couldn't see that, an error."""
    where = spark.conf.get(KEY, None)
    if not where:
        where = spark.sparkContext.getConf().get(KEY, None)
    if not where:
        own = spark.sparkContext.getCheckpointDir()
        if own is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
        if own is None:
            keep = tempfile.TemporaryDirectory(prefix="deltaweave-")
            atexit.register(keep.cleanup)
            spark.sparkContext.setCheckpointDir(f"file://{keep.name}")
            own = f"file://{keep.name}"
        where = own
    return where.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Write df once to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = new_folder(spark, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote; nothing may read them, or what was made from them without a cut, any more."""
    for df in tables:
        drop_folder(df.sparkSession, df.folder)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store by whichever file system holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _place(path: str):
    """(file system, path inside it) for a URI or a plain path."""
    from pyarrow import fs

    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        plain = path[len("file:") :] if scheme else path
        while plain.startswith("//"):
            plain = plain[1:]
        return fs.LocalFileSystem(), plain
    return fs.FileSystem.from_uri(path)


class AtomicFile:
    """A file of the shared folder that appears under its name only when it is whole.

    A retried or speculative task writes its own attempt file; as content depends only
    on the task's rows, whichever attempt moves last leaves the same bytes.
    """

    def __init__(self, path: str):
        self.fs, self.path = _place(path)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.tmp)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.tmp, self.path)
        else:
            self.fs.delete_file(self.tmp)


def open_input(path: str):
    fs, plain = _place(path)
    return fs.open_input_file(plain)
