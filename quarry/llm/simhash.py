"""SimHash near-duplicate groups by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four segments of 16 bits. If two fingerprints differ in at most
three bits, some segment is equal in both and the next segment (cyclically) differs in at most one
bit: were every equal segment followed by two or more errors, the errors would exceed three. So
each layout's key is one segment as it is and a Golay codeword index of the next, padded to 23
bits; the code gives one or six indices to a segment such that words one bit apart share one.
Fingerprints that share a key are compared exactly. Equal fingerprints are one class throughout, so
groups of copies never meet each other; a bucket of many classes is compared block by block, and only
links that join its parts are emitted.

Nulls: a null text has no words (fingerprint zero); rows with a null ``doc_id`` get a fingerprint and
the component of their class, null where no member has an id. Repeated rows stay, one result each. Ties need no order: a
component is named by its least id, and of rows that share the least id the one of least text hash stays. Texts of any length are read whole.
An empty table gives no rows. ``without_near_duplicates`` returns all columns, whatever their names, as they are.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, text_or_empty, written
from .components import connected_components
from .golay import keys
from .grouping import blocked, labels_of, sorted_groups

SEED = 42
SEGMENTS, SEGMENT_BITS = 4, 16
MAX_BITS = 3
_CHUNK = 1 << 16


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of the word shingles: bit set where over half of the shingles' XXH64 have it set."""
    from xxhash import xxh64_digest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    raw = np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(SEED))), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(raw), _CHUNK):
        ones += np.unpackbits(raw[start : start + _CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(documents: DataFrame, width: int = 3, *others: str) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every document, with its long columns ``others``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [_signed(fingerprint(t.as_py(), width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *others])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *others)
    return docs.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in others)]))


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the fingerprints (uint64) and the keys of each, all layouts together."""
    segments = [((fps >> np.uint64(SEGMENT_BITS * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(SEGMENTS)]
    places, found = [], []
    for k in range(SEGMENTS):
        index, count = keys(segments[(k + 1) % SEGMENTS].astype(np.uint32))
        used = np.arange(6) < count[:, None]
        place = np.nonzero(used)[0]
        places.append(place)
        found.append((k << 28) | (segments[k][place] << 12) | index[used].astype(np.int64))
    return np.concatenate(places), np.concatenate(found)


def _close(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = [], []
    for start in range(0, len(fps), 512):
        a, b = np.nonzero(np.bitwise_count(fps[start : start + 512, None] ^ fps[None, :]) <= max_bits)
        keep = a + start < b
        left.append(a[keep] + start)
        right.append(b[keep])
    return np.concatenate(left), np.concatenate(right)


def fingerprint_links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links u-v between representatives of fingerprint classes (fp, rep) that connect all pairs within ``max_bits``."""
    if max_bits > MAX_BITS:
        raise ValueError("the keys find fingerprints of at most three differing bits")

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            fps, reps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            place, key = fuzzy_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[place]), pa.array(reps[place])], names=["key", "fp", "rep"])

    def compare(batches):
        import pyarrow as pa

        out_u, out_v, size = [], [], 0
        for group in sorted_groups(batches):
            if group.num_rows < 2:
                continue
            fps, reps = group.column(3).to_numpy().view(np.uint64), group.column(4).to_numpy()
            order = np.argsort(reps, kind="stable")
            fps, reps = fps[order], reps[order]
            label = labels_of(len(fps), *_close(fps, max_bits))
            linked = np.nonzero(label != np.arange(len(fps)))[0]
            out_u.append(reps[linked])
            out_v.append(reps[label[linked]])
            size += len(linked)
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], names=["u", "v"])
                out_u, out_v, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], names=["u", "v"])

    members = classes.where("rep is not null").select("fp", "rep").mapInArrow(spread, "key long, fp long, rep long")
    dealt = blocked(members, "key", F.col("fp"), grown=True).select("key", "b1", "b2", "fp", "rep")
    return dealt.mapInArrow(compare, "u long, v long")


def near_duplicates(spark: SparkSession, documents: DataFrame, width: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    fps = written(spark, fingerprints(documents, width), "fingerprints")
    classes = written(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    groups = connected_components(spark, fingerprint_links(classes, max_bits))
    named = classes.join(groups, classes["rep"] == groups["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    # Every fingerprint has its class; the outer join only bars Spark from sending the documents to every task.
    return fps.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_groups(documents: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents with one row of each group, the least by id and then by its text's hash; rows without an id all stay.

    rows: doc_id, digest (``xxhash64`` of the text) and node of every row with an id; groups: node and component of the linked nodes.
    """
    least = rows.groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("row")).join(groups, "node", "left")
    first_id, first_text, own_text, place = (free_name(documents, c) for c in ("first", "digest", "text", "row"))
    first = least.groupBy(F.coalesce("component", "node")).agg(F.min("row").alias("row")).select(F.col("row.doc_id").alias(first_id), F.col("row.digest").alias(first_text))
    named = documents.withColumn(own_text, F.xxhash64("text"))
    kept = named.join(first, (F.col("doc_id") == F.col(first_id)) & (F.col(own_text) == F.col(first_text)), "left_semi")
    # Equal rows of a task are one before they are dealt, so many copies under one id gather nowhere.
    kept = kept.withColumn(place, F.row_number().over(W.partitionBy("doc_id", own_text).orderBy(own_text))).where(F.col(place) == 1).drop(place, own_text)
    return kept.unionByName(documents.where("doc_id is null"))


def without_near_duplicates(spark: SparkSession, documents: DataFrame, width: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with one row of each near-duplicate group, that of its smallest id; rows without an id all stay.

    Groups are of rows: rows with the same id and different texts are in the groups of their own fingerprints.
    """
    texts = documents.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("digest"))
    rows = written(spark, fingerprints(texts, width, "digest"), "fingerprints").withColumnRenamed("fp", "node")
    classes = written(spark, rows.select(F.col("node").alias("fp"), F.col("node").alias("rep")).distinct(), "classes")
    return first_of_groups(documents, rows, connected_components(spark, fingerprint_links(classes, max_bits)))
