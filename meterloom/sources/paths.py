"""Folders by the addresses that Spark takes: on the driver through its own file systems, inside tasks through Arrow's."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Names that Hadoop's connectors give to stores which Arrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss", "gcs": "gs"}


def arrow_uri(uri: str) -> str:
    """An address that Arrow takes: schemes by its names, a plain path as it is."""
    found = re.match(r"^([a-zA-Z][a-zA-Z0-9+.-]*):(.*)$", uri)
    if not found:
        return uri
    scheme, rest = found[1].lower(), found[2]
    if scheme == "file":
        return "/" + rest.lstrip("/")
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def arrow_filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of an address and the path there. Credentials and regions come from where Arrow looks for them
    (environment, instance roles), so executors must have them as they have Spark's."""
    at = arrow_uri(uri)
    return (fs.LocalFileSystem(), at) if "://" not in at else fs.FileSystem.from_uri(at)


_own: dict[str, str] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below `spark.checkpoint.dir`; where that is unset, as in tests, below one of this machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="meterloom-"))
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saver(spark: SparkSession, name: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes frames below a new folder and reads them back, so that what follows begins from files: shared work is done
    once, and a lost executor costs its running tasks only."""
    folder = scratch_folder(spark, name)

    def save(df: DataFrame, table: str) -> DataFrame:
        df.write.parquet(f"{folder}/{table}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{table}")

    return save


class DriverFiles:
    """Small text files below one folder, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def has(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def swap(self, name: str, text: str, over: bool) -> bool:
        """Writes a file that is there whole or not at all; with `over` in place of an older one, else only where there is
        none. Whether it has been written: without `over` another writer may have been first."""
        folder, _, last = name.rpartition("/")
        temporary = self._path(f"{folder}/.{last}.{uuid.uuid4().hex}")
        stream = self.fs.create(temporary, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        array[0] = rename.OVERWRITE if over else rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(context.makeQualified(temporary), context.makeQualified(self._path(name)), array)
        except Py4JJavaError as e:
            self.fs.delete(temporary, False)
            if over or not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            return False
        return True

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
