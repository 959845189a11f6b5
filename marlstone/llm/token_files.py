"""Token-id files that can be read one document at a time.

A file holds independent zstandard frames of token ids, an index frame that says where each document lies, and a
trailing seek table in the public seekable format: a skippable frame with each frame's compressed size, plain size and
checksum (the low 32 bits of XXH64).  A reader fetches the tail, the index frame and the frames it needs.

    frame*  index-frame  seek-table
    seek-table: 0x184D2A5E, size, (csize, dsize, checksum)*, frames, descriptor, 0x8F92EAB1   (little-endian u32; descriptor is a byte)
    index-frame: header JSON line, then int64 arrays doc_id, frame, place in the frame (ids), number of ids

Documents are dealt out by ranges of doc_id and sorted within each range, so the files in the order of their names hold
ascending doc_ids.  A task begins another file when one holds FILE_BYTES of ids, so files and their indexes stay small
however few tasks there are.  Each file is written under a temporary name and renamed, so a repeated task replaces the
same files with the same bytes; what failed tasks leave is swept away when the manifest is there.

Cases: a null or empty text is the end id alone; a null doc_id sorts first and is kept apart by a flag; rows with the
same doc_id are ordered by a hash of their text; an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import contextlib
import io
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, materialise, new_folder, ship, text_or_empty
from .tokens import WordTokenizer, vocabulary_path

ship(__name__)

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 18
#: Plain bytes of ids after which a task begins another file.
FILE_BYTES = 1 << 30
END_ID = 2


def checksum(plain: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class FrameWriter:
    """Writes one file to an open binary stream."""

    def __init__(self, out, dtype: str, level: int = 3, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.out, self.dtype, self.frame_bytes = out, np.dtype(dtype), frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table: list[tuple[int, int, int]] = []
        self.waiting: list[bytes] = []
        self.size = self.n_ids = 0
        self.docs: list[tuple[int, int, int, int]] = []
        self.null_ids: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if doc_id is None:
            self.null_ids.append(len(self.docs))
        n = len(ids) // self.dtype.itemsize
        self.docs.append((doc_id or 0, len(self.table), self.size // self.dtype.itemsize, n))
        self.waiting.append(ids)
        self.size += len(ids)
        self.n_ids += n
        if self.size >= self.frame_bytes:
            self._frame(b"".join(self.waiting))
            self.waiting, self.size = [], 0

    def _frame(self, plain: bytes) -> None:
        packed = self.compressor.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain), checksum(plain)))

    def close(self) -> None:
        if self.waiting:
            self._frame(b"".join(self.waiting))
        head = json.dumps({"dtype": self.dtype.str, "docs": len(self.docs), "null_ids": self.null_ids, "frames": len(self.table)}).encode() + b"\n"
        self._frame(head + np.array(self.docs, "<i8").reshape(-1, 4).T.tobytes())
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE))


class FrameReader:
    """Reads one file through a seekable stream; only the frames asked for are fetched and decompressed."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.unpack = stream, zstandard.ZstdDecompressor()
        stream.seek(0, io.SEEK_END)
        size = stream.tell()
        stream.seek(size - 9)
        frames, descriptor, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE or descriptor != 0x80:
            raise ValueError("no seek table at the end of the file")
        stream.seek(size - 9 - 12 * frames)
        self.table = [*struct.iter_unpack("<III", stream.read(12 * frames))]
        self.at = np.cumsum([0, *(c for c, _, _ in self.table)]).tolist()
        head, _, rest = self.frame(frames - 1).partition(b"\n")
        self.head = json.loads(head)
        self.dtype = np.dtype(self.head["dtype"])
        self.doc_id, self.in_frame, self.place, self.count = np.frombuffer(rest, "<i8").reshape(4, -1)

    def frame(self, k: int) -> bytes:
        c, d, want = self.table[k]
        self.stream.seek(self.at[k])
        plain = self.unpack.decompress(self.stream.read(c), max_output_size=d)
        if len(plain) != d or checksum(plain) != want:
            raise ValueError(f"frame {k} is damaged")
        return plain

    def documents(self):
        """doc_id and ids of each document in the order of the file, one frame in memory at a time."""
        k, ids, nulls = -1, np.empty(0, self.dtype), set(self.head["null_ids"])
        for i, (d, f, a, n) in enumerate(zip(self.doc_id.tolist(), self.in_frame.tolist(), self.place.tolist(), self.count.tolist(), strict=True)):
            if f != k:
                k, ids = f, np.frombuffer(self.frame(f), self.dtype)
            yield None if i in nulls else d, ids[a : a + n]

    def read_all(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this doc_id (None: of those without one); only their frames are decompressed."""
        null = np.zeros(len(self.doc_id), bool)
        null[self.head["null_ids"]] = True
        wanted = np.flatnonzero(null if doc_id is None else (self.doc_id == doc_id) & ~null)
        out, k, ids = [], -1, np.empty(0, self.dtype)
        for i in wanted.tolist():
            if (f := int(self.in_frame[i])) != k:
                k, ids = f, np.frombuffer(self.frame(f), self.dtype)
            a = int(self.place[i])
            out.append(ids[a : a + int(self.count[i])])
        return out

    def read(self, doc_id: int | None) -> np.ndarray:
        """The ids of one document, the first of several with the same doc_id."""
        if not (found := self.read_all(doc_id)):
            raise KeyError(doc_id)
        return found[0]


def file_system(uri: str):
    """pyarrow's file system and the path in it; a bare path is local to the shared folder's mount."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _plain_uri(uri: str) -> str:
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


#: What pyarrow calls the stores that Hadoop knows by other names.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def shared_uri(spark: SparkSession, folder: str) -> str:
    """The folder as both sides name it: a path without a scheme is where Spark's default file system has it, so driver, tasks
    and Spark's own readers mean the same place.  A store that pyarrow can't open is refused before anything is written."""
    from pyarrow import fs

    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = _plain_uri(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString())
    scheme, rest = uri.split(":", 1)
    uri = f"{SCHEMES.get(scheme, scheme)}:{rest}"
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError) as e:
        raise ValueError(f"token files can't be written to {folder}: pyarrow has no file system for {scheme}") from e
    return uri


MANIFEST = "file string, part bigint, docs bigint, ids bigint, bytes bigint"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, level: int = 3, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all documents in ascending doc_id; returns the manifest, a row for each file: file, part, docs, ids, bytes."""
    folder = shared_uri(docs.sparkSession, folder)

    def write(batches):
        from pyspark import TaskContext

        part, model = TaskContext.get().partitionId(), WordTokenizer.of_process(vocabulary)
        system, base = file_system(folder)
        width, n, writer, trial = model.dtype.itemsize, 0, None, None

        def finished():
            name = f"{base}/part-{part:06d}-{n:06d}.tok"
            writer.close()
            writer.out.close()
            system.move(trial, name)
            row = (name.rpartition("/")[2], part, len(writer.docs), writer.n_ids, system.get_file_info(name).size)
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["file", "part", "docs", "ids", "bytes"])

        try:
            for batch in batches:
                doc_ids, texts = batches_of(["d"], batch)[0], batch.column(batch.schema.get_field_index("t"))
                for at, ids, starts in model.encode_ended(texts, end_id):
                    raw, starts = ids.tobytes(), (starts * width).tolist()
                    for k in range(len(starts) - 1):
                        if writer is None:
                            system.create_dir(base, recursive=True)
                            trial = f"{base}/_trial-{part:06d}-{uuid.uuid4().hex}"
                            writer = FrameWriter(system.open_output_stream(trial, compression=None), model.dtype.str, level)
                        writer.add(doc_ids[at + k], raw[starts[k] : starts[k + 1]])
                        if writer.n_ids * width >= file_bytes:
                            yield finished()
                            writer, n = None, n + 1
            if writer is not None:
                yield finished()
                writer = None
        finally:
            if writer is not None:  # failed on the way
                with contextlib.suppress(OSError):
                    writer.out.close()
                    system.delete_file(trial)

    keyed = docs.select(F.col(id_col).cast("bigint").alias("d"), text_or_empty(text_col).alias("t"), F.xxhash64(text_or_empty(text_col)).alias("h"))
    ranged = keyed.repartitionByRange("d", "h").sortWithinPartitions("d", "h").select("d", "t")
    return ranged.mapInArrow(write, MANIFEST)


def sweep_trials(spark: SparkSession, folder: str) -> None:
    """Remove what tasks that were killed have left; call it when the manifest has been written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(conf)
    for found in system.globStatus(jvm.org.apache.hadoop.fs.Path(where, "_trial-*")) or []:
        system.delete(found.getPath(), False)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of unsigned 32-bit ids), read from the files."""
    folder, spark = shared_uri(manifest.sparkSession, folder), manifest.sparkSession

    def read(batches):
        for batch in batches:
            for file, start in zip(*batches_of(["file", "start"], batch), strict=True):
                system, base = file_system(folder)
                out: tuple[list, ...] = ([], [], [], [])
                with system.open_input_file(f"{base}/{file}") as stream:
                    for d, ids in FrameReader(stream).documents():
                        for column, v in zip(out, (d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            column.append(v)
                        start += len(ids)
                        if len(out[0]) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            out = ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row for each file, of which each holds FILE_BYTES or all that a task had.
    starts, at = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.file):
        starts.append((r.file, at))
        at += r.ids
    rows = spark.createDataFrame(starts, "file string, start bigint")
    return rows.repartition(max(1, len(starts)), "file").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to token files and back."""
    folder = new_folder(spark, "token-files")
    manifest = materialise(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, vocabulary_path()), "token-manifest")
    sweep_trials(spark, folder)
    return read_token_files(manifest, folder)
