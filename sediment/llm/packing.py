"""Token files: independent zstandard frames, a trailing seek table, a checksum for every frame.

A file is a valid zstandard file. Frames hold the ids (little-endian unsigned 32-bit) of consecutive
documents and are compressed on their own, with zstandard's content checksum. Two skippable frames end
the file: a directory of documents (doc_id, number of ids, in file order) and the seek table of the public
"zstd seekable format": for every frame its compressed size, its decompressed size and the low 32 bits of
the XXH64 of its content, then the number of frames, a descriptor byte and the magic number 0x8F92EAB1.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import freed, new_path, partitions, written
from .tokens import encoded, vocabulary

END_ID = 0
#: Bytes of ids after which a frame is closed (a document is never parted).
FRAME_BYTES = 1 << 18
#: Bytes of text for one file, about; and documents that a reader hands on at once.
FILE_BYTES = 256 << 20
READ_DOCS = 4096
_SKIP, _SEEK, _TABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class Writer:
    """Writes one file to ``out`` (a binary stream)."""

    def __init__(self, out, level: int = 1, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids, self.counts, self.known = array("q"), array("q"), bytearray()
        self.held: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        self.doc_ids.append(doc_id or 0)
        self.counts.append(len(ids))
        self.known.append(doc_id is not None)
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            done = self.pack.compress(raw)
            self.out.write(done)
            self.frames.append((len(done), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        directory = np.array(self.doc_ids, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes() + bytes(self.known)
        packed = zstandard.ZstdCompressor(level=1, write_checksum=True).compress(directory)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, _TABLE)
        body = struct.pack("<II", len(self.known), len(packed)) + packed
        # the directory's length stands last in its frame too, so that a reader coming from the end finds it
        body += struct.pack("<I", len(body) + 4)
        self.out.write(struct.pack("<II", _SKIP, len(body)) + body)
        self.out.write(struct.pack("<II", _SEEK, len(table)) + table)


class Reader:
    """Reads documents of one file; ``source`` is seekable. Only frames that hold what is asked for are read."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != _TABLE or flags != 0x80:
            raise ValueError("no seek table")
        table = end - 9 - 12 * n
        self.frames = np.frombuffer(self._at(table, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        (length,) = struct.unpack("<I", self._at(table - 8 - 4, 4))
        body = self._at(table - 8 - length, length - 4)
        docs, packed = struct.unpack("<II", body[:8])
        raw = zstandard.ZstdDecompressor().decompress(body[8 : 8 + packed], max_output_size=17 * docs + 1)
        self.doc_ids, self.counts = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "<i8", docs, 8 * docs)
        self.known = np.frombuffer(raw, np.uint8, docs, 16 * docs).astype(bool)
        self.begin = np.concatenate([[0], np.cumsum(self.counts)]) * 4
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        self._frame = (-1, b"")

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        if self._frame[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.at[k]), int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k}: wrong checksum")
            self._frame = (k, raw)
        return self._frame[1]

    def document(self, i: int) -> np.ndarray:
        k = int(np.searchsorted(self.starts, self.begin[i], "right")) - 1
        if self.counts[i] == 0:
            return np.zeros(0, "<u4")
        at = int(self.begin[i] - self.starts[k])
        return np.frombuffer(self.frame(k), "<u4", int(self.counts[i]), at)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _sweep(spark: SparkSession, folder: str, named: DataFrame) -> None:
    """Delete files of attempts that failed: those in ``folder`` that the manifest does not name (a row a file)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return
    good = {r[0].rsplit("/", 1)[1] for r in named.select("file").collect()}
    for found in store.listStatus(path):
        if found.getPath().getName() not in good:
            store.delete(found.getPath(), False)


def write_token_files(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Token files of ``docs`` (doc_id, text), in ascending doc_id order (null first, then by a hash of the text and the
    text). Returns the manifest, one row a file: file, part, docs, ids.

    Rows are range-partitioned by doc_id, hash of the text and a salt, so neither null ids nor a repeated
    id or row meet in one file; there is a file for about ``FILE_BYTES`` of text, and no fewer than shuffle
    partitions. Each task encodes its rows and writes a file that its attempt names; the manifest names the files
    of the attempts that Spark committed, and others are deleted, so lost executors leave nothing behind that counts.

    Null and empty texts have the end id alone; a special token that a text spells gets its special id; very long
    texts lie in a frame of their own; repeated rows are all written; other columns are not read; an empty table
    gives an empty manifest.
    """
    spark = docs.sparkSession
    folder, path = folder or new_path(spark, "tokens"), path or vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(partitions(spark), -(-size // FILE_BYTES))
    if ":/" not in folder:
        folder = f"file://{folder}"
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    schema = "file string, part int, docs long, ids long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, out, writer, total, docs_n = task.partitionId(), None, None, 0, 0
        store, root = _filesystem(folder)
        name = f"part-{part:06d}-{task.taskAttemptId()}.tokens.zst"
        for batch in batches:
            if writer is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}", compression=None)
                writer = Writer(out)
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids, begin = encoded(path, some.column(1).to_pylist())
                for i, doc_id in enumerate(some.column(0).to_pylist()):
                    own = np.append(ids[begin[i] : begin[i + 1]], np.int32(end_id))
                    writer.add(doc_id, own)
                    total += len(own)
                    docs_n += 1
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "part": pa.array([part], pa.int32()), "docs": [docs_n], "ids": [total]})

    salted = rows.withColumns({"h": F.xxhash64("text"), "salt": F.pmod(F.monotonically_increasing_id(), F.lit(1024))})
    dealt = salted.repartitionByRange(files, "doc_id", "h", "salt").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    manifest = written(dealt.mapInArrow(freed(run), schema), "manifest")
    _sweep(spark, folder, manifest)
    return manifest


def read_token_files(manifest: DataFrame, columns: str = "doc_id long, start long, n_tokens long, ids_crc32 long") -> DataFrame:
    """One row a document from the files of ``manifest``: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32. Files are read frame by frame and handed on in batches of ``READ_DOCS``; an empty manifest gives no rows."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long")).select("file", "base")
    n = max(1, min(manifest.count(), partitions(manifest.sparkSession)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = _filesystem(file)
                with store.open_input_file(at) as source:
                    reader = Reader(source)
                    starts = reader.begin[:-1] // 4 + base
                    for a in range(0, len(reader.counts), READ_DOCS):
                        b = min(a + READ_DOCS, len(reader.counts))
                        crc = [zlib.crc32(reader.document(i)) for i in range(a, b)]
                        yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[a:b], mask=~reader.known[a:b]), pa.array(starts[a:b]), pa.array(reader.counts[a:b]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(n, "file").mapInArrow(freed(run), columns)


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_token_files(write_token_files(docs))
