"""Token-ID output: independent zstandard frames, per-frame checksums and a trailing seek table.

A file holds the ids of documents in ascending doc_id order:

1. data frames: each is a zstandard frame of its own with ``FRAME_IDS`` ids
   (the last one has the rest), 2 bytes an id where the vocabulary allows it;
2. a skippable frame with the documents (a zstandard frame of doc_id, null
   flag and number of ids) behind a head of id width, documents and ids;
3. the seek table of the public seekable zstandard format, a skippable frame
   too: compressed size, plain size and checksum (low 32 bits of XXH64) of each
   data frame, then the number of frames and the format's closing number.

Any zstandard tool unpacks a whole file; a reader that wants one document takes
the table from the end of the file and decompresses the frames it needs.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.bpe import AT_ONCE, encoder
from fleetlens.llm.frames import chunks_of_bytes, texts_of
from fleetlens.session import stored

FRAME_IDS = 1 << 16
# fixed values of the public formats
SKIPPABLE_DOCS = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
TABLE_END = 0x8F92EAB1
CHECKSUMS = 0x80

MANIFEST = "file int, path string, n_docs long, n_ids long, n_bytes long"
DOCUMENT = "file int, position long, doc_id long, start long, ids binary"


def _fs(path: str):
    """The file system of a folder shared by all executors (a URI, or a plain local path)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FileWriter:
    """Writes one file; ``add`` takes documents in order, ``close`` puts the file in its place in one step."""

    def __init__(self, path: str, width: int) -> None:
        import zstandard

        self.fs, self.path = _fs(path)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.pack = zstandard.ZstdCompressor(level=3)
        self.kind, self.left = np.dtype(f"<u{width}"), bytearray()
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.n_ids += len(ids)
        self.left += ids.astype(self.kind).tobytes()
        step = FRAME_IDS * self.kind.itemsize
        while len(self.left) >= step:
            self._frame(bytes(self.left[:step]))
            del self.left[:step]

    def _frame(self, plain: bytes) -> None:
        import xxhash

        packed = self.pack.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> tuple[int, int, int]:
        if self.left:
            self._frame(bytes(self.left))
        docs = self.pack.compress(np.array(self.docs, dtype="<i8").tobytes())
        body = struct.pack("<BQQ", self.kind.itemsize, len(self.docs), self.n_ids) + docs
        self.out.write(struct.pack("<II", SKIPPABLE_DOCS, len(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, TABLE_END)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        size = self.out.tell()
        self.out.close()
        self.fs.move(self.temp, self.path)
        return len(self.docs), self.n_ids, size


class FileReader:
    """Reads documents of one file, decompressing only the frames they stand in."""

    def __init__(self, path: str) -> None:
        import zstandard

        fs, plain = _fs(path)
        self.file, self.unpack = fs.open_input_file(plain), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, flags, end = struct.unpack("<IBI", self._at(size - 9, 9))
        if end != TABLE_END or flags != CHECKSUMS:
            raise ValueError(f"{path}: no seek table at the end")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.plain, self.sums = table[:, 0], table[:, 1], table[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        _, length = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        body = self._at(int(self.starts[-1]) + 8, length)
        width, n_docs, self.n_ids = struct.unpack("<BQQ", body[:17])
        self.kind = np.dtype(f"<u{width}")
        docs = np.frombuffer(self.unpack.decompress(body[17:], max_output_size=max(1, 24 * n_docs)), dtype="<i8").reshape(n_docs, 3)
        self.doc_ids = [None if null else int(i) for i, null, _ in docs]
        self.offsets = np.concatenate([[0], np.cumsum(docs[:, 2])]).astype(np.int64)
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, dtype=self.kind))

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def frame(self, k: int) -> np.ndarray:
        import xxhash

        if self.held[0] != k:
            plain = self.unpack.decompress(self._at(int(self.starts[k]), int(self.sizes[k])), max_output_size=int(self.plain[k]))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.held = (k, np.frombuffer(plain, dtype=self.kind))
        return self.held[1]

    def document(self, position: int) -> np.ndarray:
        """The ids of the document at a place in the file, as unsigned 32-bit integers."""
        start, end = int(self.offsets[position]), int(self.offsets[position + 1])
        parts = [np.zeros(0, dtype=self.kind)]
        for k in range(start // FRAME_IDS, -(-end // FRAME_IDS)):
            base = k * FRAME_IDS
            parts.append(self.frame(k)[max(0, start - base):end - base])
        return np.concatenate(parts).astype("<u4")


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0) -> DataFrame:
    """Encodes ``doc_id``, ``text`` and writes token files under ``folder``; returns the manifest, one row a file.

    Rows are dealt by ranges of (doc_id, text hash) and sorted, so the files in
    order hold ascending doc_ids; a null doc_id comes first, rows with the same
    doc_id follow their text's hash. A null text counts as empty: it has the end
    id only. Other columns are not read. A task that is run again writes the
    same bytes beside its file and moves them into place. An empty table gives
    an empty manifest.
    """
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("__h", F.xxhash64("text"))
    dealt = dealt.repartitionByRange("doc_id", "__h").sortWithinPartitions("doc_id", "__h").drop("__h")
    root, tail = folder.rstrip("/"), [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, to = encoder(tokenizer), TaskContext.get().partitionId(), None
        width, last = 2 if len(own.tokens) <= 1 << 16 else 4, np.array(tail, dtype="<u4")
        path = f"{root}/tokens-{number:07d}.zst"
        for batch in batches:
            for part in chunks_of_bytes(batch, "text", AT_ONCE):
                to = to or FileWriter(path, width)
                for i, ids in zip(part.column("doc_id").to_pylist(), own.encode(texts_of(part.column("text").to_pylist())), strict=True):
                    to.add(i, np.concatenate([ids, last]))
        if to:
            values = (number, path, *to.close())
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["file", "path", "n_docs", "n_ids", "n_bytes"]).cast(
                pa.schema([("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    return stored(dealt.mapInArrow(run, MANIFEST), f"{root}/manifest")


def with_file_starts(manifest: DataFrame) -> DataFrame:
    """Adds ``before``, the number of ids in all files before a file; the window sorts one row a file."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """All documents of the files: file, position in it, doc_id, start (ids of all documents before it), ids.

    ``ids`` are little-endian unsigned 32-bit integers. Every frame's checksum
    is compared. Files are dealt one by one, so one task holds one frame. The
    starts come with the files' names, so documents take part in no join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.int32()), ("position", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for number, path, before in zip(*(batch.column(c).to_pylist() for c in ("file", "path", "before")), strict=True):
                own, rows, held = FileReader(path), [], 0
                for k, doc_id in enumerate(own.doc_ids):
                    ids = own.document(k).tobytes()
                    rows.append((number, k, doc_id, before + int(own.offsets[k]), ids))
                    held += len(ids) + 64
                    if held >= AT_ONCE:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    spark: SparkSession = manifest.sparkSession
    many = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return with_file_starts(manifest).select("file", "path", "before").repartition(many, "path").mapInArrow(run, DOCUMENT)


def read_documents(spark: SparkSession, path: str, positions: list[int]) -> list[np.ndarray]:
    """Random access: the ids of the documents at these places of one file; decompresses their frames only."""
    own = FileReader(path)
    return [own.document(p) for p in positions]
