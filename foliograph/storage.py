"""Work tables on storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, kind: str = "graph") -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a temporary folder stands in for it on a single
    machine; on a cluster it is an error, since every executor would see a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            root = known.get()
        elif context.master == "local" or context.master.startswith("local["):
            root = tempfile.mkdtemp(prefix="foliograph-")
            context.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


class Folder:
    """A folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path).rstrip("/")
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.at(name) if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(""))] if self.exists() else []

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)

    def read_text(self, name: str) -> str:
        source = self.fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def write_text(self, name: str, text: str) -> None:
        """Written aside and renamed over what is there in one step, so that readers find the old text or the new one."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        aside = f".{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self._path(aside), True)
        out.write(bytearray(text.encode()))
        out.close()
        context = hadoop.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kinds = getattr(hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.OVERWRITE
        context.rename(self.fs.makeQualified(self._path(aside)), self.fs.makeQualified(self._path(name)), how)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back."""
        df.write.parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))
