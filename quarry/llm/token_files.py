"""Token ids as binary files of patched frame-of-reference blocks, and their reader.

Layout of a ``.qpf`` file (all little-endian):

* magic ``QPF1``;
* chunks, each of up to ``CHUNK_BLOCKS`` blocks of ``BLOCK`` ids: number of blocks (u32), number of
  ids (u32), block minima (u32 each), widths (u8 each), exception counts (u16 each), then each
  block's offsets from its minimum packed at its width, then the exceptions' places (u8 each) and
  offsets (u32 each). The width is that of the block's ``PERCENTILE`` offset; greater offsets are
  the exceptions and stay zero in the packed part;
* footer: document ids (i64), ids of each document (i64), nullness (u8), chunk starts (u64), block
  starts (u64: the byte where each block's packed part begins), then the counts of these and the
  footer's own start (u64 each) and the magic again.

Files are written under a temporary name and moved, so a task that runs again replaces its file.

Nulls: a null text is empty (the end id alone); a null ``doc_id`` sorts first and is read back as null. Repeated rows
are documents of their own, in the table's order. Texts of any length are written; a writer holds one text and one chunk. An empty
table gives no file and no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, text_or_empty
from .encoding import END_ID, default_vocabulary, encoder

MAGIC = b"QPF1"
BLOCK = 256
CHUNK_BLOCKS = 512
PERCENTILE = 0.95


def _bit_length(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def encode_chunk(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """A chunk of ids and the places of its blocks' packed parts, from the chunk's start."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.full(blocks * BLOCK, ids[-1] if n else 0, dtype=np.uint32)
    full[:n] = ids
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1)
    delta = full - low[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = _bit_length(np.partition(delta, at, axis=1)[:, at])
    over = delta > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None]
    row, place = np.nonzero(over)
    values = delta[row, place].astype("<u4")
    delta[over] = 0
    sizes = width.astype(np.int64) * (BLOCK // 8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    packed = np.zeros(starts[-1], dtype=np.uint8)
    for w in np.unique(width):
        if not w:
            continue
        which = np.nonzero(width == w)[0]
        bits = np.unpackbits(delta[which].astype("<u4").view(np.uint8).reshape(len(which), BLOCK, 4), axis=2, bitorder="little", count=int(w))
        packed[starts[which][:, None] + np.arange(sizes[which[0]])] = np.packbits(bits.reshape(len(which), -1), axis=1, bitorder="little")
    head = struct.pack("<II", blocks, n) + low.astype("<u4").tobytes() + width.tobytes() + over.sum(axis=1).astype("<u2").tobytes()
    return head + packed.tobytes() + place.astype(np.uint8).tobytes() + values.tobytes(), len(head) + starts[:-1]


def decode_chunk(data: bytes) -> np.ndarray:
    blocks, n = struct.unpack_from("<II", data)
    at = 8
    low = np.frombuffer(data, "<u4", blocks, at)
    width = np.frombuffer(data, np.uint8, blocks, at := at + 4 * blocks)
    patched = np.frombuffer(data, "<u2", blocks, at := at + blocks)
    at += 2 * blocks
    sizes = width.astype(np.int64) * (BLOCK // 8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    packed = np.frombuffer(data, np.uint8, int(starts[-1]), at)
    at += int(starts[-1])
    out = np.zeros((blocks, BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        which = np.nonzero(width == w)[0]
        rows = packed[starts[which][:, None] + np.arange(sizes[which[0]])]
        bits = np.unpackbits(rows, axis=1, bitorder="little").reshape(len(which), BLOCK, int(w))
        wide = np.zeros((len(which), BLOCK, 16 if w <= 16 else 32), dtype=np.uint8)
        wide[:, :, : int(w)] = bits
        out[which] = np.packbits(wide, axis=2, bitorder="little").view("<u2" if w <= 16 else "<u4")[:, :, 0]
    total = int(patched.sum(dtype=np.int64))
    place = np.frombuffer(data, np.uint8, total, at)
    values = np.frombuffer(data, "<u4", total, at + total)
    out[np.repeat(np.arange(blocks), patched), place] = values
    return (out + low[:, None]).reshape(-1)[:n]


class TokenFileWriter:
    """Writes documents' ids, in the order given, to one file; holds one chunk at a time."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0
        self.pending: list[np.ndarray] = []
        self.waiting = 0
        self.doc_ids, self.nulls, self.lengths, self.chunks, self.blocks = [], [], [], [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK * CHUNK_BLOCKS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        size = BLOCK * CHUNK_BLOCKS
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, dtype="<u4")
        end = len(ids) if last else len(ids) // size * size
        for start in range(0, end, size):
            data, places = encode_chunk(ids[start : min(end, start + size)])
            self.chunks.append(self.at)
            self.blocks.append(self.at + places)
            self._put(data)
        self.pending = [ids[end:].copy()]
        self.waiting = len(ids) - end

    def close(self) -> int:
        self._flush(True)
        start = self.at
        blocks = np.concatenate(self.blocks) if self.blocks else np.zeros(0)
        for column, kind in ((self.doc_ids, "<i8"), (self.lengths, "<i8"), (self.nulls, "u1"), (self.chunks, "<u8"), (blocks, "<u8")):
            self._put(np.asarray(column, dtype=kind).tobytes())
        self._put(struct.pack("<QQQQ", len(self.doc_ids), len(self.chunks), len(blocks), start) + MAGIC)
        self.stream.close()
        return self.at


class TokenFileReader:
    """Reads a token file; ``documents`` streams (doc_id, ids), ``block`` reads any one block by the index."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = file.read_at(36, size - 36)
        if tail[-4:] != MAGIC or file.read_at(4, 0) != MAGIC:
            raise ValueError("not a token file")
        docs, chunks, blocks, self.end = struct.unpack("<QQQQ", tail[:32])
        foot = file.read_at(size - 36 - self.end, self.end)
        self.doc_ids = np.frombuffer(foot, "<i8", docs)
        self.lengths = np.frombuffer(foot, "<i8", docs, 8 * docs)
        self.nulls = np.frombuffer(foot, "u1", docs, 16 * docs)
        self.chunks = np.frombuffer(foot, "<u8", chunks, 17 * docs)
        self.blocks = np.frombuffer(foot, "<u8", blocks, 17 * docs + 8 * chunks)

    def chunk(self, k: int) -> np.ndarray:
        end = int(self.chunks[k + 1]) if k + 1 < len(self.chunks) else self.end
        return decode_chunk(self.file.read_at(end - int(self.chunks[k]), int(self.chunks[k])))

    def block(self, k: int) -> np.ndarray:
        """Block ``k`` alone: its chunk's head, then its packed part, which the index places, and its exceptions."""
        start, j = int(self.chunks[k // CHUNK_BLOCKS]), k % CHUNK_BLOCKS
        blocks, n = struct.unpack("<II", self.file.read_at(8, start))
        head = self.file.read_at(7 * blocks, start + 8)
        low, width = np.frombuffer(head, "<u4", blocks), np.frombuffer(head, np.uint8, blocks, 4 * blocks)
        patched = np.frombuffer(head, "<u2", blocks, 5 * blocks).astype(np.int64)
        w, size = int(width[j]), int(width[j]) * (BLOCK // 8)
        bits = np.unpackbits(np.frombuffer(self.file.read_at(size, int(self.blocks[k])), np.uint8), bitorder="little")
        out = bits.reshape(BLOCK, w).astype(np.uint64) @ (np.uint64(1) << np.arange(w, dtype=np.uint64)) if w else np.zeros(BLOCK, np.uint64)
        places = start + 8 + 7 * blocks + int(width.sum(dtype=np.int64)) * (BLOCK // 8)
        first, count = int(patched[:j].sum()), int(patched[j])
        values = places + int(patched.sum()) + 4 * first
        out[np.frombuffer(self.file.read_at(count, places + first), np.uint8)] = np.frombuffer(self.file.read_at(4 * count, values), "<u4")
        return (out + low[j])[: n - j * BLOCK].astype(np.uint32)

    def documents(self):
        held, k = np.zeros(0, dtype=np.uint32), 0
        for doc_id, null, n in zip(self.doc_ids, self.nulls, self.lengths):
            if len(held) < n:
                parts = [held]
                have = len(held)
                while have < n:
                    parts.append(self.chunk(k))
                    have += len(parts[-1])
                    k += 1
                held = np.concatenate(parts)
            yield None if null else int(doc_id), held[:n]
            held = held[n:]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_token_files(spark: SparkSession, documents: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Writes the ids of all documents, in ascending ``doc_id`` order, as one file for each range of ids.

    Returns the manifest: part, file, n_docs, n_tokens, n_bytes. ``folder`` must be shared by all executors.
    Null texts are empty, a null ``doc_id`` sorts first; rows with equal ids keep the table's order and may be
    parted among files.
    """
    vocabulary = vocabulary or default_vocabulary()
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        part, enc = context.partitionId(), encoder(vocabulary)
        system, root = _filesystem(folder.replace("file:///", "file:/").replace("file:/", "file:///"))
        writer, tokens, temporary = None, 0, f"{root}/.part-{part:06d}-{context.taskAttemptId()}"
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, offsets in enc.encoded(batch.column(1)):
                if writer is None:
                    system.create_dir(root)
                    writer = TokenFileWriter(system.open_output_stream(temporary))
                # Every text's ids with the end id behind them.
                ended = np.insert(ids, offsets[1:], END_ID)
                at = (offsets + np.arange(len(offsets))).tolist()
                tokens += len(ended)
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    writer.add(doc_ids[first + k], ended[a:b])
        if writer is not None:
            size = writer.close()
            system.move(temporary, f"{root}/part-{part:06d}.qpf")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"part-{part:06d}.qpf"], "n_docs": [len(writer.doc_ids)], "n_tokens": [tokens], "n_bytes": [size]})

    # The row's place parts ids that repeat; it is the same when a task runs again.
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("place"))
    ordered = docs.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    manifest = ordered.mapInArrow(run, "part int, file string, n_docs long, n_tokens long, n_bytes long")
    rows = sorted(map(tuple, manifest.collect()))  # one row for each file
    return spark.createDataFrame(rows, manifest.schema)


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    rows, before = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        rows.append((r["file"], before))
        before += r["n_tokens"]

    def run(batches):
        import pyarrow as pa

        system, root = _filesystem(folder.replace("file:///", "file:/").replace("file:/", "file:///"))
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = ([], [], [], [])
                with system.open_input_file(f"{root}/{name}") as file:
                    for doc_id, ids in TokenFileReader(file).documents():
                        for column, value in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                            column.append(value)
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "file string, first long").repartition(max(1, len(rows)))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(spark: SparkSession, documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes all documents to the shared folder and reads them back."""
    folder = scratch_path(spark, "tokens")
    return read_token_files(spark, write_token_files(spark, documents, folder, vocabulary), folder)
