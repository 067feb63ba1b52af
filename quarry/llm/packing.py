"""Sequence packing by shortest-pack-first over the length histogram.

1. Every document is encoded, ended with ``END_ID`` and cut into pieces: full sequences first, then
   a rest. Pieces go to a shared table with their crc32, their task and their rank among the
   task's pieces of one length.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) is packed on the
   driver: lengths are placed longest first, each into the pack with the most room left, and packs
   with the same content are one pattern with a count. Every step empties a length or a pattern,
   so the plan's size depends on ``capacity`` alone.
3. A piece's global rank among those of its length picks its pattern, copy and offset.

Nulls: a null text counts as empty (one piece: the end id); a null ``doc_id`` stays null. Repeated
rows are packed as separate documents. Pieces of equal length are ranked by task and then by place in
the task, so ties fall as the table is read; which sequence they go to differs, its lengths do not. A text of any length is cut
into as many pieces as it needs. An empty table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_path, text_or_empty
from .encoding import END_ID, default_vocabulary, encoder

CAPACITY = 2048
_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, local_rank long"


def plan_packs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order, number of packs) for a histogram of lengths.

    Shortest pack first: each length, longest first, goes to the fullest-room pattern that takes it.
    """
    room: dict[int, list[list]] = {}
    heap: list[int] = []

    def put(left: int, pattern: tuple[int, ...], count: int) -> None:
        if left not in room:
            room[left] = []
            heapq.heappush(heap, -left)
        room[left].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        while todo:
            while heap and not room.get(-heap[0]):
                room.pop(-heapq.heappop(heap), None)
            if not heap or -heap[0] < length:
                # No open pack has room: as many new packs as there are pieces; further pieces of
                # this length join them while they are the shortest.
                fit = capacity // length
                new = -(-todo // fit)
                put(capacity - length, (length,), new)
                todo -= new
                continue
            left = -heap[0]
            entry = room[left][-1]
            n = min(todo, entry[1])
            todo -= n
            entry[1] -= n
            pattern = entry[0]
            if not entry[1]:
                room[left].pop()
            put(left - length, (*pattern, length), n)
    return [(tuple(p), n) for left in sorted(room) for p, n in room[left] if n]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length: first rank, first sequence and offset of each run of equal slots, by rank."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            ranks, sequences, offsets = out.setdefault(length, ([], [], []))
            ranks.append(used.get(length, 0))
            sequences.append(sequence)
            offsets.append(offset)
            used[length] = used.get(length, 0) + count
            offset += length
        sequence += count
    return out


def encoded_pieces(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """Pieces of every document with their rank among the task's pieces of the same length."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, seen, end = encoder(vocabulary), {}, END_ID.to_bytes(4, "little")
        for batch in batches:
            doc_ids, out = batch.column(0).to_pylist(), ([], [], [], [], [], [], [])
            for first, ids, offsets in enc.encoded(batch.column(1)):
                data, at = memoryview(ids.astype("<u4", copy=False).tobytes()), (4 * offsets).tolist()
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    total = (b - a) // 4 + 1
                    for start in range(0, total, capacity):
                        length = min(capacity, total - start)
                        crc = zlib.crc32(data[a + 4 * start : min(b, a + 4 * (start + length))])
                        if start + length == total:
                            crc = zlib.crc32(end, crc)
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        for column, value in zip(out, (doc_ids[first + k], start, length, crc, total, part, rank)):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local_rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return docs.mapInArrow(run, _PIECES)


def pack(spark: SparkSession, documents: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs documents (``doc_id``, ``text``) into sequences of at most ``capacity`` ids; one row for each piece."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    path = scratch_path(spark, "pieces")
    encoded_pieces(docs, vocabulary or default_vocabulary(), capacity).write.parquet(path)
    pieces = spark.read.schema(_PIECES).parquet(path)
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = slots(plan_packs(histogram, capacity))
    # Ranks of a task's pieces begin after those of the tasks before it; one row for each task and length.
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    ranked = pieces.join(first, ["part", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_rank") + F.col("local_rank")).alias("rank")
    )

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            table = batch.to_pydict()
            sequences, offsets = [], []
            for length, rank in zip(table["length"], table["rank"]):
                ranks, bases, starts = where[length]
                at = bisect_right(ranks, rank) - 1
                sequences.append(bases[at] + rank - ranks[at])
                offsets.append(starts[at])
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = [pa.array(table[n] if n in table else {"sequence_id": sequences, "offset": offsets}[n], pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
