"""Token-id files: independent zstandard frames with a trailing seek table and per-frame checksums.

A file is valid in the public seekable zstandard format:

* data frames, each at most FRAME_IDS ids of consecutive documents as little-endian unsigned 32-bit integers, with the
  format's own content checksum; a longer document goes on in the next frame;
* one skippable frame (magic 0x184D2A50) with the document index, itself compressed: ids, then lengths, as 64-bit integers,
  then a byte for each that is 1 where the document has an id;
* the seek table, a skippable frame (magic 0x184D2A5E): for each frame its compressed size, its decompressed size and
  the low 32 bits of the XXH64 of its data; then the number of frames, a descriptor with the checksum flag and the
  magic number 0x8F92EAB1.

A reader fetches footer, table and index, and decompresses only the frames of the documents asked for. Files are
written by range of document id, each under a temporary name and then renamed, so a task that runs again replaces its
own file with the same bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import arrow_filesystem
from .common import Scratch, id_and_text
from .tokens import encoder

FRAME_IDS = 1 << 16
#: Text bytes of one file.
FILE_BYTES = 32 << 20
#: Files whose numbers of ids are added up together.
FILES_OF_RUN = 2000
# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A50
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_FOOTER_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80


class TokenFileWriter:
    """Writes documents, in the order they come, to an open binary file."""

    def __init__(self, out):
        self.out, self.frames, self.ids, self.named, self.lengths = out, [], [], [], []
        self.buffer, self.held = [], 0
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.named.append(doc_id is not None)
        self.lengths.append(len(ids))
        self.buffer.append(ids.astype("<u4"))
        self.held += len(ids)
        if self.held >= FRAME_IDS:
            rest = np.concatenate(self.buffer)
            while len(rest) >= FRAME_IDS:
                self._frame(rest[:FRAME_IDS])
                rest = rest[FRAME_IDS:]
            self.buffer, self.held = [rest], len(rest)

    def _frame(self, ids: np.ndarray) -> None:
        data = ids.tobytes()
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.held:
            self._frame(np.concatenate(self.buffer))
        index = self.packer.compress(np.array(self.ids, "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes() + bytes(self.named))
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(index)) + index)
        self.frames.append((8 + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(table)) + table)


class TokenFile:
    """Reads documents of an open, seekable binary file."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        n, flag, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE_FOOTER_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("not a token file: no seek table at its end")
        table = np.frombuffer(self._read(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.plain, self.sums = table[:-1].T if n > 1 else np.zeros((3, 0), np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.packed)))
        self.upto = np.concatenate(([0], np.cumsum(self.plain // 4)))
        index = zstandard.ZstdDecompressor().decompress(self._read(int(self.at[-1]) + 8, int(table[-1, 0]) - 8))
        n_docs = len(index) // 17
        self.ids, self.lengths = np.frombuffer(index, "<i8", 2 * n_docs).reshape(2, -1)
        self.named = np.frombuffer(index, np.uint8, n_docs, 16 * n_docs) > 0
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> np.ndarray:
        data = zstandard.ZstdDecompressor().decompress(self._read(int(self.at[k]), int(self.packed[k])))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k}: checksum differs")
        return np.frombuffer(data, "<u4")

    def document(self, doc_id: int) -> np.ndarray:
        """The ids of one document, from its own frames only."""
        k = int(np.flatnonzero((self.ids == doc_id) & self.named)[0])
        first, end = int(self.starts[k]), int(self.starts[k] + self.lengths[k])
        a, z = int(np.searchsorted(self.upto, first, "right")) - 1, int(np.searchsorted(self.upto, end, "left"))
        return np.concatenate([self.frame(j) for j in range(a, z)])[first - int(self.upto[a]) : end - int(self.upto[a])]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start, ids) of every document in order, a frame at a time; a document without an id has None."""
        rest, k = np.zeros(0, np.uint32), 0
        for doc_id, named, start, n in zip(self.ids.tolist(), self.named.tolist(), self.starts.tolist(), self.lengths.tolist(), strict=True):
            if len(rest) < n:
                parts = [rest]
                while sum(map(len, parts)) < n:
                    parts.append(self.frame(k))
                    k += 1
                rest = np.concatenate(parts)
            yield doc_id if named else None, start, rest[:n]
            rest = rest[n:]


def _writer(root: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = arrow_filesystem(root)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.ids.zst"
        work = f"{folder}/.{name}.{task.taskAttemptId()}"
        writer, out, n_ids, n_docs = None, None, 0, 0
        for b in batches:
            if b.num_rows and writer is None:
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(work)
                writer = TokenFileWriter(out)
            ids = b.column("doc_id").to_pylist()
            for at in range(0, len(ids), 256):
                texts = b.column("text").slice(at, 256).to_pylist()
                for doc_id, x in zip(ids[at : at + 256], encoder(tokenizer, end_id).encode(texts), strict=True):
                    writer.add(doc_id, x)
                    n_ids, n_docs = n_ids + len(x), n_docs + 1
        if writer is not None:
            writer.close()
            out.close()
            fs.move(work, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (task.partitionId(), name, n_docs, n_ids)], ["part", "file", "n_docs", "n_ids"])

    return run


def write_token_files(docs: DataFrame, root: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """The lazy manifest of the files in `root` (a URI): part, file, n_docs, n_ids. Save it once; its rows are the write.

    Documents go to files in ascending id order. A null text has its end id alone; rows without an id come first;
    rows that repeat an id follow one another. An empty table writes no file.
    """
    rows = id_and_text(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(max(1, -(-total // file_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(_writer(root, tokenizer, end_id), "part long, file string, n_docs long, n_ids long")


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = arrow_filesystem(root)
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                with fs.open_input_file(f"{folder}/{name}") as file:
                    rows = [(i, base + start, len(x), zlib.crc32(x)) for i, start, x in TokenFile(file).documents()]
                ids, starts, counts, sums = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_token_files(manifest: DataFrame, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # sums in runs of files, so that one task orders only as many rows as there are runs
    run = F.floor(F.col("part") / FILES_OF_RUN)
    inside = manifest.withColumn("run", run).withColumn("inside", before(Window.partitionBy("run").orderBy("part")))
    runs = manifest.groupBy(run.alias("run")).agg(F.sum("n_ids").alias("n_ids")).select("run", before(Window.orderBy("run")).alias("outside"))
    spread = inside.join(runs, "run").select("file", (F.col("inside") + F.col("outside")).alias("base")).repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return spread.mapInArrow(_reader(root), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    scratch = Scratch(docs.sparkSession, "token-files")
    uri = scratch.folder("files")
    manifest = scratch.save(write_token_files(docs, uri, tokenizer, end_id, **options), "manifest")
    return read_token_files(manifest, uri)
