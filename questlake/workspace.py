"""Folders shared by all executors, and small files in them written atomically.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which every
executor can read, so a lost executor costs a re-read and never a result. Only where
that setting is absent (tests, a laptop) a local folder is made and set.
"""

from __future__ import annotations

import io
import json
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is set only where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="questlake-")
        spark.sparkContext.setCheckpointDir(root)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/questlake/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, folder: str) -> DataFrame:
    """Write a table once and go on from what was written (cuts the lineage)."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy per row: a table that comes in fewer pieces than there are cores is dealt out evenly.

    Such a table is small beside the cluster: it has at most cores times
    ``spark.sql.files.maxPartitionBytes`` (128 MB a core by default), so no task sends
    more than it would have read for itself. Larger tables are left as they lie.
    """
    planned = df._jdf.queryExecution()
    if "Exchange" in planned.executedPlan().toString():  # counting pieces would run it
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(3 * cores) if planned.toRdd().getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Give the package to all Python workers, once a session, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_questlake_shipped", False):
        return
    root = Path(__file__).parent
    try:
        packed = io.BytesIO()
        with zipfile.PyZipFile(packed, "w") as archive:
            archive.writepy(str(root))
    except OSError:  # compiled files can't be kept beside the sources: ship these
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, f"{root.name}/{path.relative_to(root)}")
    folder = Folder(spark, new_folder(spark, "code"))
    folder.write_bytes("questlake.zip", packed.getvalue())
    context.addPyFile(f"{folder.path}/questlake.zip")
    context._questlake_shipped = True


class Folder:
    """Files of one folder through Hadoop's file system API, on any shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._p("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._p(name))

    def listdir(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._p(name)))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._p(name), True)

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._p(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        self.write_bytes(name, text.encode())

    def write_bytes(self, name: str, content: bytes) -> None:
        stream = self._fs.create(self._p(name), True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write to a side file, then rename; False if the name was already taken."""
        side = f"_{name.replace('/', '_')}.{uuid.uuid4().hex}"
        self.write_text(side, text)
        target = self._p(name)
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(self._p(side), target):
            self.delete(side)
            return False
        return True


class Manifest:
    """Numbered, immutable states of a table; the highest number is the current one.

    A state is a small JSON object (file lists and the last batch), never data. A
    writer that dies before publishing leaves the former state in force. The last
    ``KEEP`` states stay, for readers that are under way; older ones are deleted.
    """

    KEEP = 5

    def __init__(self, folder: Folder, name: str = "manifest"):
        self.folder, self.name = folder, name

    def load(self) -> tuple[int, dict]:
        numbers = [int(f[:-5]) for f in self.folder.listdir(self.name) if f.endswith(".json")]
        if not numbers:
            return 0, {}
        return max(numbers), json.loads(self.folder.read_text(f"{self.name}/{max(numbers):09d}.json"))

    def publish(self, number: int, state: dict) -> None:
        if not self.folder.publish(f"{self.name}/{number:09d}.json", json.dumps(state, sort_keys=True)):
            raise RuntimeError(f"state {number} of {self.folder.path} was published by another writer")
        if number > self.KEEP:
            self.folder.delete(f"{self.name}/{number - self.KEEP:09d}.json")
