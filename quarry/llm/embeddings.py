"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

Vectors are normalised, so a cosine of c is a distance of sqrt(2 - 2c). Each of L tables takes k random
projections, shifted and quantised at ``WIDTH``; vectors with equal quantised values share a bucket. k grows
with the logarithm of the number of vectors, so chance buckets stay small, and L follows from it: a pair at exactly
the least cosine shares a bucket with a chance of ``RECALL`` or more, a closer one with more. Members of a bucket are
compared exactly, in double precision.

Equal vectors are one class throughout, so copies never meet each other. Buckets with one member go before vectors
are attached; large ones are compared block by block. A pair that shares several buckets counts in the
first of them alone, which both vectors tell, so counts need no list of pairs.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of
different lengths never link. A null ``vec_id`` counts as a vector of its own, with itself (null) as component. Repeated
rows are separate vectors with one id: each links to the others. Ties need no order: a component is named by its least id. An empty table
gives no rows; columns other than ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .components import connected_components
from .grouping import BLOCK_MEMBERS, blocked, labels_of, sorted_groups

MIN_COSINE = 0.95
WIDTH = 1.0
RECALL = 0.97
SEED = 11
#: Groups of at most SMALL members are compared together, in lots of about LOT_ROWS; pairs of vectors held at once.
SMALL, LOT_ROWS, PAIRS = 24, 8192, 50_000


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection is equal for two vectors at this distance."""
    if distance <= 0:
        return 1.0
    r = width / distance
    phi = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(count: int, min_cosine: float = MIN_COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Projections in a table and number of tables for this many vectors."""
    near, far = collision(math.sqrt(2 - 2 * min_cosine)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(count, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**k))))


def bucket_keys(vectors: np.ndarray, k: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Keys (n, tables) of normalised vectors."""
    rng = np.random.default_rng((seed, vectors.shape[1]))
    directions = rng.standard_normal((vectors.shape[1], tables * k))
    shift = rng.random(tables * k) * WIDTH
    cells = np.floor((vectors @ directions + shift) / WIDTH).astype(np.int64).reshape(len(vectors), tables, k)
    out = np.tile(np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(vectors.shape[1]), (len(vectors), 1))
    for j in range(k):
        out = (out ^ cells[:, :, j].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _unit(column) -> np.ndarray:
    values = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(values), -1)
    return v / np.linalg.norm(v, axis=1)[:, None]


def _by_length(column):
    """Places of the vectors of each length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return [np.nonzero(lengths == n)[0] for n in np.unique(lengths)]


def close_pairs(unit: np.ndarray, min_cosine: float):
    """Lots of pairs a < b of unit vectors with at least this cosine."""
    for start in range(0, len(unit), 256):
        a, b = np.nonzero(unit[start : start + 256] @ unit[start:].T >= min_cosine)
        keep = a < b
        a, b = a[keep] + start, b[keep] + start
        for lot in range(0, len(a), PAIRS):
            yield a[lot : lot + PAIRS], b[lot : lot + PAIRS]


def close_in_groups(unit: np.ndarray, names: tuple[np.ndarray, ...], min_cosine: float):
    """The same within each run of rows with equal names, all small runs at once."""
    new = np.append(True, np.any([x[1:] != x[:-1] for x in names], axis=0))
    end = np.append(np.nonzero(new)[0][1:], len(unit))[np.cumsum(new) - 1]
    count = end - np.arange(len(unit)) - 1
    a = np.repeat(np.arange(len(unit)), count)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
    for lot in range(0, len(a), PAIRS):
        i, j = a[lot : lot + PAIRS], b[lot : lot + PAIRS]
        close = np.einsum("ij,ij->i", unit[i], unit[j]) >= min_cosine
        yield i[close], j[close]


def linked_vectors(spark: SparkSession, vectors: DataFrame, min_cosine: float = MIN_COSINE, block: int = BLOCK_MEMBERS, small: int = SMALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding); ``block``: members of a bucket that are one block."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    fine = F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = rows.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0))).alias("v"))
    # Classes get their least id as name.
    classes = written(spark, rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    k, tables = tables_for(classes.count(), min_cosine)

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            reps, v = batch.column(0).to_numpy(), batch.column(1)
            for at in _by_length(v):
                for lot in np.array_split(at, max(1, len(at) // 2000)):
                    keys = bucket_keys(_unit(v.take(pa.array(lot))), k, tables)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(reps[lot], tables))], names=["key", "rep"])

    def compare(batches):
        import pyarrow as pa

        def found_in(table, apart):
            """Links of one lot of small groups, or of one group (``apart``: cut into blocks)."""
            table = table.combine_chunks()
            v, columns = table.column("v").chunk(0), {c: table.column(c).to_numpy() for c in ("key", "rep", "n", "own", "b1", "b2")}
            for at in _by_length(v):
                if len(at) < 2:
                    continue
                unit = _unit(v.take(pa.array(at)))
                key, rep, n, own, b1, b2 = (columns[c][at] for c in ("key", "rep", "n", "own", "b1", "b2"))
                pairs = close_pairs(unit, min_cosine) if apart else close_in_groups(unit, (key, b1, b2), min_cosine)
                links, left, right = np.zeros(len(at), dtype=np.int64), [], []
                for a, b in pairs:
                    keep = (own[a] != own[b]) | (b1[a] == b2[a])
                    a, b = a[keep], b[keep]
                    if not len(a):
                        continue
                    # A pair counts in the first table in which it shares a bucket. Only linked vectors are hashed again.
                    used, local = np.unique(np.concatenate([a, b]), return_inverse=True)
                    keys = bucket_keys(unit[used], k, tables)
                    i, j = local[: len(a)], local[len(a) :]
                    first = keys[i, (keys[i] == keys[j]).argmax(axis=1)] == key[a]
                    a, b = a[first], b[first]
                    np.add.at(links, a, n[b])
                    np.add.at(links, b, n[a])
                    left.append(a)
                    right.append(b)
                if not links.any():
                    continue
                order = np.argsort(rep, kind="stable")
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                label = labels_of(len(at), rank[np.concatenate(left)], rank[np.concatenate(right)])
                have = np.nonzero(links)[0]
                yield pa.RecordBatch.from_arrays([pa.array(rep[have]), pa.array(rep[order[label[rank[have]]]]), pa.array(links[have])], names=["u", "v", "links"])

        held, size = [], 0
        for group in sorted_groups(batches):
            if group.num_rows > small:
                yield from found_in(group, True)
            elif group.num_rows > 1:
                held.append(group)
                size += group.num_rows
                if size >= LOT_ROWS:
                    yield from found_in(pa.concat_tables(held), False)
                    held, size = [], 0
        if held:
            yield from found_in(pa.concat_tables(held), False)

    members = classes.select("rep", "v").mapInArrow(spread, "key long, rep long")
    dealt = blocked(members, "key", F.col("rep"), block=block, attach=classes, on="rep").select("key", "b1", "b2", "own", "rep", "n", "v")
    found = written(spark, dealt.mapInArrow(compare, "u long, v long, links long"), "links")
    groups = connected_components(spark, found.select("u", "v"))
    counts = found.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    named = classes.join(counts, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    named = named.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(named, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
