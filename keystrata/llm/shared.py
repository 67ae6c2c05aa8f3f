"""What several training-data operators need: shared storage, word rules, batch bounds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a Python worker receives at once; whole texts stay whole.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2048

#: Words are runs of ASCII letters and digits and of all non-ASCII characters, with A-Z lowered.
#: One byte table states the rule: a byte that belongs to no word becomes a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8; none for null."""
    return text.encode().translate(WORD_TABLE).split() if text else []


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local master, whose executors are threads of the driver, may go without the setting;
    it then gets a temporary folder, removed when the process ends.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-keystrata-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(f"file://{own}")
    return context.getCheckpointDir().rstrip("/")


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that stored() has written within it, but those it was told to keep.

    What a call returns may lazily read kept tables only. These pass to the scope around, if there is one.
    """
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    stack = _scopes.__dict__.get("stack", [])
    for paths in stack[-2:-1] if keep else stack[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of df's (case-insensitively), built from the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
