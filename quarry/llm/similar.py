"""Near-duplicate groups by SimHash with Golay-code keys, for a Jaccard similarity of word shingles.

Two texts at similarity 0.8 have the cosine 0.89, so a bit of their fingerprints differs with a chance of 0.15 (0.19 where they have four
and five shingles). The 64 bits of op 5 cannot settle that; so the fingerprint of a text's set of shingles has ``BITS`` bits here, cut into
``SEGMENTS`` whole words of the Golay code (23 bits, without padding). A word's keys are the one or six codeword indices
of ``golay.keys``; at that similarity two words share one with a chance of 0.60 (0.46), so two texts share a key of some word with 0.99996 (0.9989).

In a bucket, texts whose sizes allow the similarity and whose first ``CHECK_WORDS`` words of 64 bits differ in at most ``MAX_BITS`` are linked.
The components of these links are small supersets of the groups; in each, all pairs are compared by their whole shingle sets (32-bit hashes),
and only that decides. Buckets and components of any size are compared block by block; only links that join a block pair's parts are
emitted. Texts with the same set are one class throughout.

Nulls: a null text has no words; texts without words are one class. Of fewer words than ``width`` all are one
shingle. Rows without an id are in no group and all stay. Repeated rows are one class; of rows that share the least id the one of least text
hash stays. Texts of any length are read whole. An empty table gives no rows; all columns, whatever their names, come back as they are.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, text_or_empty, written
from .components import connected_components
from .golay import LENGTH, keys
from .grouping import blocked, labels_of, sorted_groups, thinned
from .simhash import SEED, first_of_groups

WIDTH, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, and words of the Golay code in it.
BITS, SEGMENTS = 256, 11
#: 64-bit words that are compared in a bucket, and the bits that may differ in them: at similarity 0.8 more do with a chance of 6e-7
#: (3e-4 for four and five shingles), of unrelated texts as few with 1.5e-9.
CHECK_WORDS, MAX_BITS = 3, 55
#: Classes of a component that are one block, and of a bucket of keys.
BLOCK, BUCKET_BLOCK = 512, 1 << 15
_COLUMNS, _CELLS, _LINKS = 1 << 12, 1 << 19, 1 << 20
_SALTS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BITS // 64), dtype=np.uint64)
_SALTS[1] |= np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS = [f"f{k}" for k in range(BITS // 64)]


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """XXH64 of the text's different word shingles, sorted."""
    from xxhash import xxh64_digest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    found = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(map(xxh64_digest, found, repeat(SEED))), dtype=">u8").astype(np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingle hashes: of ``BITS`` bits, made of each hash, those set that over half of the shingles have set."""
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 255):  # counts of a chunk fit a byte, and eight of them are added as one number
        mixed = (hashes[start : start + 255, None] ^ _SALTS[0]) * _SALTS[1]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).view(np.uint64).sum(axis=0).view(np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(np.int64)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the fingerprints (rows of 64-bit words) and the keys of each: the codeword indices of all its segments."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1)[:, : SEGMENTS * LENGTH].reshape(-1, SEGMENTS, LENGTH)
    words = (bits.astype(np.float32) @ (1 << np.arange(LENGTH)).astype(np.float32)).astype(np.uint32)
    places, found = [], []
    for k in range(SEGMENTS):
        index, count = keys(words[:, k])
        used = np.arange(6) < count[:, None]
        places.append(np.nonzero(used)[0])
        found.append((k << 12) | index[used].astype(np.int64))
    return np.concatenate(places), np.concatenate(found)


def sketches(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, digest (of the text), node (name of the shingle set), its size, the words of its fingerprint and its 32-bit shingle hashes."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            nodes, sizes, fps, sets = [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), width)
                nodes.append(xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                fps.append(fingerprint(found))
                sets.append(np.unique((found >> np.uint64(32)).astype("<u4")).tobytes())
            fps = np.array(fps, dtype=np.int64).reshape(-1, len(_WORDS))
            columns = [pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), *(pa.array(fps[:, k].copy()) for k in range(len(_WORDS)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(sets, pa.binary())], names=["doc_id", "digest", "node", "size", *_WORDS, "shingles"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), text_or_empty().alias("text"))
    return docs.mapInArrow(lean(run), ", ".join(f"{c} long" for c in ("doc_id", "digest", "node", "size", *_WORDS)) + ", shingles binary")


def near(sizes: np.ndarray, words: list[np.ndarray], similarity: float, max_bits: int) -> np.ndarray:
    """Smallest index reachable from each of these fingerprints (by ascending size) by links of at most ``max_bits`` and fit sizes."""
    n = len(sizes)
    left, right, held, start = [], [], 0, 0
    reach = np.searchsorted(sizes, sizes / similarity + 1e-6, side="right")
    while start < n:
        stop = min(n, start + max(8, min(256, _CELLS // int(reach[start] - start))))
        differ = sum(np.bitwise_count(w[start:stop, None] ^ w[start : reach[stop - 1]]) for w in words)
        hits = differ <= max_bits
        np.fill_diagonal(hits, False)
        if hits.any():
            at = np.arange(start, reach[stop - 1])
            hits &= (at > at[: stop - start, None]) & (at < reach[start:stop, None])
        column = np.nonzero(hits.any(axis=0))[0]
        if len(column):
            # A column is linked to its first row, and rows that share a column to each other: as one as all their pairs are.
            hits = hits[:, column]
            left.append(start + hits.argmax(axis=0))
            right.append(start + column)
            dense = hits.astype(np.float32)
            a, b = np.nonzero(np.triu(dense @ dense.T, 1))
            left.append(start + a)
            right.append(start + b)
            held += len(column) + len(a)
            if held > _LINKS:
                left, right, held = [labels_of(n, np.concatenate(left), np.concatenate(right))], [np.arange(n)], n
        start = stop
    return labels_of(n, np.concatenate(left), np.concatenate(right)) if left else np.arange(n)


def similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (of different numbers) with at least this Jaccard similarity."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))], [0, 0]], dtype=np.float64)
    else:
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        inside = shared[column]
        owner = np.repeat(np.arange(len(sets)), sizes)[inside]
        column = (np.cumsum(shared) - 1)[column[inside]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)))
        for start in range(0, int(shared.sum()), _COLUMNS):
            a, b = np.searchsorted(column, [start, start + _COLUMNS])
            dense = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
            dense[owner[a:b], column[a:b] - start] = 1
            common += dense @ dense.T
    return np.nonzero(np.triu((1 + similarity) * common >= similarity * (sizes[:, None] + sizes) - 1e-9, 1))


def near_links(classes: DataFrame, similarity: float = SIMILARITY, max_bits: int = MAX_BITS) -> DataFrame:
    """Links u-v between nodes (node, size and fingerprint words) that connect all that share a Golay key and are near."""
    checked = _WORDS[:CHECK_WORDS]

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            node, size, *fps = (c.to_numpy() for c in batch.columns)
            place, key = golay_keys(np.stack(fps, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, node[place], size[place], *(f[place] for f in fps[:CHECK_WORDS]))], names=["key", "node", "size", *checked])

    def compared(batches):
        for group in sorted_groups(batches):
            if group.num_rows < 2:
                continue
            node, size, *fps = (group.column(k).to_numpy() for k in range(3, 5 + CHECK_WORDS))
            order = np.lexsort((node, size))
            node, size, fps = node[order], size[order], [f[order].view(np.uint64) for f in fps]
            label = near(size, fps, similarity, max_bits)
            linked = np.nonzero(label != np.arange(len(node)))[0]
            if len(linked):
                yield node[linked], node[label[linked]]

    def compare(batches):
        yield from thinned(compared(batches))

    def thin(batches):
        yield from thinned((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows)

    members = classes.where("size > 0").select("node", "size", *_WORDS).mapInArrow(lean(spread), ", ".join(f"{c} long" for c in ("key", "node", "size", *checked)))
    dealt = blocked(members, "key", F.col("node"), block=BUCKET_BLOCK, few=True)
    links = dealt.select("key", "b1", "b2", "node", "size", *checked).mapInArrow(lean(compare), "u long, v long")
    # Texts of a large group meet in many buckets under several least ones: the stars get few links of each.
    return links.repartition("u").mapInArrow(lean(thin), "u long, v long")


def similar_links(groups: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links u-v between nodes that connect all of one group (node, component) with this similarity; sets: node, shingles."""

    def compare(batches):
        import pyarrow as pa

        for group in sorted_groups(batches):
            if group.num_rows < 2:
                continue
            nodes = group.column(3).to_numpy()
            label = labels_of(len(nodes), *similar([np.frombuffer(s.as_py(), dtype="<u4") for s in group.column(4)], similarity))
            linked = np.nonzero(label != np.arange(len(nodes)))[0]
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[label[linked]])], names=["u", "v"])

    dealt = blocked(groups, "component", F.col("node"), block=BLOCK, attach=sets, on="node")
    return dealt.select("component", "b1", "b2", "node", "shingles").mapInArrow(lean(compare), "u long, v long")


def without_similar(spark: SparkSession, documents: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one row of each group of similar texts, that of its smallest id; rows without an id all stay."""
    rows = written(spark, sketches(documents.where("doc_id is not null"), width), "sketches")
    classes = written(spark, rows.select("node", "size", *_WORDS).distinct(), "classes")
    near_groups = connected_components(spark, near_links(classes, similarity))
    # One row of each class gives its set.
    first = rows.groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("row"))
    first = first.join(near_groups, "node", "left_semi").select("node", "row.*")
    sets = rows.join(first, ["node", "doc_id", "digest"], "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    return first_of_groups(documents, rows, connected_components(spark, similar_links(near_groups, sets, similarity)))
