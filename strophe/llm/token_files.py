"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

A file is, in order: zstandard frames, each whole documents' ids as little-endian unsigned 32-bit integers; a
skippable frame with the document index (itself compressed); the seek table of the public zstandard seekable
format, a skippable frame of (compressed size, size, checksum) for each frame and a footer. A plain
zstandard decoder reads the ids of the whole file; a reader of single documents reads the tail, then the
frames that hold them, and compares each frame's checksum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm import common, tokens

# Fixed values of the zstandard seekable format and of skippable frames.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

#: A frame is closed once it holds so many bytes of ids.
FRAME_BYTES = 1 << 18


def checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Appends documents to one file; ``close`` writes the index and the seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.parts, self.size, self.frames = [], 0, []
        self.docs, self.known, self.counts, self.frame_of = [], [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.counts.append(len(ids) // 4)
        self.frame_of.append(len(self.frames))
        self.parts.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.parts:
            data = b"".join(self.parts)
            small = self.zstd.compress(data)
            self.sink.write(small)
            self.frames.append((len(small), len(data), checksum(data)))
            self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(np.asarray(x, t).tobytes() for x, t in ((self.docs, "<i8"), (self.counts, "<u8"), (self.frame_of, "<u4"), (self.known, "u1")))
        index = struct.pack("<Q", len(self.docs)) + self.zstd.compress(index)
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class Reader:
    """Reads single documents of one file; ``source`` has ``seek`` and ``read``, ``size`` is its length."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self.take(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self.take(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.frames, self.at = table, np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
        magic, length = struct.unpack("<II", self.take(int(self.at[-1]), 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index before the seek table")
        body = self.take(int(self.at[-1]) + 8, length)
        (k,) = struct.unpack("<Q", body[:8])
        index = self.zstd.decompress(body[8:])
        self.docs, self.counts = np.frombuffer(index, "<i8", k), np.frombuffer(index, "<u8", k, 8 * k).astype(np.int64)
        self.frame_of, self.known = np.frombuffer(index, "<u4", k, 16 * k), np.frombuffer(index, "u1", k, 20 * k).astype(bool)

    def take(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        small, size, check = (int(x) for x in self.frames[k])
        data = self.zstd.decompress(self.take(int(self.at[k]), small), max_output_size=size)
        if len(data) != size or checksum(data) != check:
            raise ValueError(f"frame {k} does not match its checksum")
        return data

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids of the file before it, ids) in file order; only frames of ``wanted`` are decompressed."""
        choose = np.ones(len(self.docs), bool) if wanted is None else np.isin(self.docs, list(wanted)) & self.known
        start = np.cumsum(self.counts) - self.counts
        first = np.searchsorted(self.frame_of, np.arange(len(self.frames)))
        for f in np.unique(self.frame_of[choose]):
            data = self.frame(int(f))
            for k in np.flatnonzero(choose & (self.frame_of == f)):
                at = int(start[k] - start[first[f]]) * 4
                yield (int(self.docs[k]) if self.known[k] else None), int(start[k]), data[at : at + int(self.counts[k]) * 4]


def filesystem(uri: str):
    """The file system and path of a shared folder: local mounts, and the object stores that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode documents and write them in ascending doc_id order (nulls first, ties by text) below ``folder``.

    Returns the manifest: part, file, n_docs, n_tokens, n_bytes; ascending ``part`` is ascending doc_id. Each
    task writes a file of its own name, so a task that runs again after a lost executor leaves the
    first file unmentioned, and the manifest, which is checkpointed, names whole files only.
    """
    spec = tokens.read_spec(tokenizer)
    end = b"" if end_id is None else tokens.packed([end_id])

    def write(batches):
        context = TaskContext.get()
        part, writer, sink = context.partitionId(), None, None
        name = f"part-{part:06d}-{context.taskAttemptId()}.ids.zst"
        system, base = filesystem(folder)
        encoder = tokens.encoder(spec)
        total = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    system.create_dir(base, recursive=True)
                    sink = system.open_output_stream(f"{base}/{name}", compression=None)
                    writer = Writer(sink, frame_bytes)
                ids = encoder.encode(text or "") + end
                total += len(ids) // 4
                writer.add(doc, ids)
        if writer is not None:
            writer.close()
            size = sink.tell()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(writer.docs)], "n_tokens": [total], "n_bytes": [size]})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return common.cut(rows.mapInArrow(write, "part long, file string, n_docs long, n_tokens long, n_bytes long"))


def read_files(manifest: DataFrame, folder: str, doc_ids: list[int] | None = None, keep_ids: bool = True) -> DataFrame:
    """Read documents back from written files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 and, with ``keep_ids``, the ids. One task reads one file, frame by frame; with ``doc_ids`` (a short
    list of requests) only the frames that hold them are decompressed."""
    files = max(1, manifest.count())
    # one row a file
    starts = manifest.select("part", "file", "n_bytes", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("before"))

    def read(batches):
        system, base = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{base}/{row['file']}") as source:
                    out = []
                    for doc, at, ids in Reader(source, row["n_bytes"]).documents(doc_ids):
                        out.append((doc, row["before"] + at, len(ids) // 4, zlib.crc32(ids)) + ((np.frombuffer(ids, "<u4").astype(np.int32),) if keep_ids else ()))
                        if len(out) >= (256 if keep_ids else 10_000):
                            yield table(out)
                            out = []
                    yield table(out)

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if keep_ids else [])

    def table(rows):
        columns = list(zip(*rows, strict=True)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return starts.repartition(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int | None = 2, folder: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Write token files to ``folder`` (default: a new one in the shared folder) and read all of them back.

    Null and empty texts hold the end id alone; very long texts are one document in a frame of their own;
    null doc_ids come first and stay null; repeated rows are documents of their own; an empty table writes no
    file and gives no rows; columns other than doc_id and text are not read.
    """
    folder = folder or common.fresh_dir(docs.sparkSession, "token-files")
    return read_files(write_files(docs, folder, tokenizer, end_id), folder, keep_ids=keep_ids)
