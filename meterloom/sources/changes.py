"""What a ledger's commits have changed, as a stream: inserted, updated and deleted rows with their commit and its revision.

`spark.readStream.format("ledger_changes").option("ledger", path).option("schema", ddl)` begins after the commit `after`
(0: all). An offset is a commit's number, so a reader that holds commit n gets exactly what later ones changed, whatever
has been compacted since; where the ledger has forgotten some of that, the reader stops with an error. A task reads one
file of one commit; only manifests are read on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..streaming.ledger import Ledger
from .paths import arrow_filesystem

OWN = "outcome string, commit long, revision_of_store long, committed_at string"


@dataclass
class ChangedFile(InputPartition):
    path: str
    commit: int
    revision: int
    at: str


class ChangeReader(DataSourceStreamReader):
    def __init__(self, ledger: str, after: int, schema: StructType):
        self.ledger, self.after, self.schema = ledger.rstrip("/"), after, schema

    def _manifests(self) -> dict[int, str]:
        files, root = arrow_filesystem(self.ledger)
        listed = files.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
        return {int(f.base_name[:-5]): f.path for f in listed if f.base_name.endswith(".json") and not f.base_name.startswith(".")}

    def initialOffset(self) -> dict:
        return {"commit": self.after}

    def latestOffset(self) -> dict:
        return {"commit": max(self._manifests(), default=self.after)}

    def partitions(self, start: dict, end: dict) -> list[ChangedFile]:
        files, root = arrow_filesystem(self.ledger)
        out = []
        mark = f"{root}/forgotten.json"
        if files.get_file_info(mark).type == fs.FileType.File and start["commit"] < (upto := json.loads(files.open_input_stream(mark).read())["upto"]):
            raise ValueError(f"changes up to commit {upto} are forgotten, this reader holds {start['commit']}")
        for commit, path in sorted(self._manifests().items()):
            if start["commit"] < commit <= end["commit"]:
                manifest = json.loads(files.open_input_stream(path).read())
                if manifest["delta"] is not None:
                    found = files.get_file_info(fs.FileSelector(f"{root}/{manifest['delta']}", recursive=True))
                    out += [ChangedFile(f.path, commit, manifest["revision"], manifest["at"]) for f in found if f.base_name.endswith(".parquet")]
        return out

    def read(self, part: ChangedFile) -> Iterator[pa.RecordBatch]:
        files, _ = arrow_filesystem(self.ledger)
        target = to_arrow_schema(self.schema)
        own = {"commit": part.commit, "revision_of_store": part.revision, "committed_at": part.at}
        for batch in ds.dataset(part.path, filesystem=files, format="parquet").to_batches():
            columns = [pa.array([own[f.name]] * batch.num_rows, f.type) if f.name in own else batch.column(f.name).cast(f.type) for f in target]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    def commit(self, end: dict) -> None:
        pass


class LedgerChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger_changes"

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(self.options["ledger"], int(self.options.get("after", 0)), schema)


def changes(ledger: Ledger, after: int = 0, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The stream of changed rows after a commit: outcome, commit, revision of the store, instant, and columns of records.

    The store must hold records, as its columns are theirs. A deleted row has the values that it had last.
    """
    spark: SparkSession = ledger.spark
    spark.dataSource.register(LedgerChanges)
    records = [f for f in ledger.at().log().schema if f.name not in ("was", "deleted", "bucket", "outcome", "revision")]
    wanted = [f for f in records if columns is None or f.name in columns]
    schema = ", ".join([OWN, *(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted)])
    return spark.readStream.format("ledger_changes").options(ledger=ledger.path, after=after, schema=schema).load()
