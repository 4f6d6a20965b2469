"""What the document operators share: scratch tables, column views, small helpers used inside tasks."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six bytes that count as white space in every operator here.
WHITE = b" \t\n\x0b\x0c\r"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; where that is unset and all runs on this machine (tests), a temporary folder."""
    conf = spark.sparkContext.getConf()
    if (named := conf.get("spark.checkpoint.dir")) is not None:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="meterloom-")
    return _own_dir[app]


class Scratch:
    """Tables written once to the shared folder, which cut lineage: a lost executor costs only its running tasks.

    `drop` removes a table as soon as no later step reads it. The table behind a returned DataFrame stays, as that
    DataFrame is lazy; whoever owns the shared folder clears it after the application.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def numbered(self, docs: DataFrame, name: str = "rows") -> tuple[DataFrame, str]:
        """`docs` as a written table whose rows carry numbers of their own, and the name of that column."""
        column = fresh(docs, "row")
        return self.save(docs.withColumn(column, F.monotonically_increasing_id()), name), column

    def folder(self, name: str) -> str:
        """The URI of a folder that tasks may write to."""
        root = f"{self.root}/{name}"
        return root if "://" in root else root.replace("file:", "file://", 1) if root.startswith("file:") else root

    def drop(self, *names: str) -> None:
        for name in names:
            self._path(f"{self.root}/{name}")

    def _path(self, path: str) -> None:
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Returns to the system what a Python worker has freed but kept: workers live on between stages, several for each core
    where a stage has several Python steps, and what each of them keeps would add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def thrifty(run):
    """A function of one Arrow table or of two that gives memory back after each call."""

    def of_one(table):
        out = run(table)
        give_back()
        return out

    def of_two(left, right):
        out = run(left, right)
        give_back()
        return out

    return of_one if run.__code__.co_argcount == 1 else of_two


def thrifty_batches(run):
    """A function of an iterator of batches that gives memory back after each of its results and at the end."""

    @functools.wraps(run)
    def call(batches):
        for out in run(batches):
            yield out
            del out
            give_back()
        give_back()

    return call


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so other columns can't clash; a null text is an empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def null_last(column: str) -> list[Column]:
    return [F.col(column).isNull(), F.col(column)]


def text_slices(batch: pa.RecordBatch, text_col: str = "text", most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts in UTF-8) of runs of rows with about `most` bytes; a longer text is a run of its own, a null one empty."""
    texts = batch.column(text_col).cast(pa.binary())
    upto = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_pylist()
    first, before = 0, 0
    for k, end in enumerate(upto):
        if k + 1 == len(upto) or upto[k + 1] - before > most:
            yield first, [t or b"" for t in texts.slice(first, k + 1 - first).to_pylist()]
            first, before = k + 1, end
