"""Streaming over the sorted groups of a shuffle partition, and links within a group without its pairs."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a bucket that are compared in one task. Larger buckets are cut into blocks, and every
#: two blocks meet in a task of their own.
BLOCK_MEMBERS = 2048


def blocked(members: DataFrame, key: str, member: Column, block: int = BLOCK_MEMBERS, attach: DataFrame | None = None, on: str | None = None, few: bool = False, grown: bool = False) -> DataFrame:
    """Members of buckets that hold two or more, with the pair of blocks (b1, b2) in which they are compared, and their own block.

    ``attach``: a table joined on ``on`` to the members that remain, for columns too wide to deal out with every key.
    ``few``: there are few enough keys to send their sizes to every task, so the members are dealt only once.
    ``grown``: a function made many members of each row of a smaller table. Spark takes them to be as few as those
    rows, so it would send members or sizes to every task by way of the driver's memory; they are merged instead.

    A bucket of at most ``block`` members is one block. Of a larger one, n = ceil(size / block) blocks are
    made by a hash of the member, and a member goes to the n block pairs that hold its own block. Rows are
    dealt by (key, b1, b2) and sorted, so a task never needs more than two blocks at once, whatever the bucket.
    """
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sizes = F.broadcast(sizes) if few else sizes.hint("merge") if grown else sizes
    n = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member), n.cast("long")).cast("int")
    out = members.join(sizes, key).select(*members.columns, own.alias("_own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("_other"))
    out = out.select(*members.columns, F.least("_own", "_other").alias("b1"), F.greatest("_own", "_other").alias("b2"), F.col("_own").alias("own"))
    if attach is not None:
        out = out.join(attach, on)
    return out.repartition(key, "b1", "b2").sortWithinPartitions(key, "b1", "b2")


def sorted_groups(batches, columns: int = 3):
    """Slices (record batches as tables) of equal values in the first ``columns`` columns, across batch borders."""
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        arrays = [table.column(k).to_numpy() for k in range(columns)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for a in arrays:
            change[1:] |= a[1:] != a[:-1]
        first = tuple(a[0] for a in arrays)
        change[0] = last is not None and first != last
        cuts = np.nonzero(change)[0]
        starts = [0, *cuts.tolist(), batch.num_rows] if not (len(cuts) and cuts[0] == 0) else [0, *cuts[1:].tolist(), batch.num_rows]
        if change[0] and held:
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(starts, starts[1:]):
            held.append(table.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.concat_tables(held) if len(held) > 1 else held[0]
                held = []
        last = tuple(a[-1] for a in arrays)
    if held:
        yield pa.concat_tables(held)


def labels_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the links left-right."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as join the nodes that the links u-v join: of each node to the least it reaches."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = labels_of(len(nodes), place[: len(u)], place[len(u) :])
    linked = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[linked], nodes[label[linked]]


def thinned(links, most: int = 1 << 20):
    """Record batches u, v of a task's links (pairs of arrays), each of some ``most`` links made a forest."""
    import pyarrow as pa

    left, right, size = [], [], 0
    for u, v in itertools.chain(links, [(None, None)]):
        if u is not None:
            left.append(u)
            right.append(v)
            size += len(u)
        if size > most or u is None and size:
            found = forest(np.concatenate(left), np.concatenate(right))
            left, right, size = [found[0]], [found[1]], len(found[0])
            if size > most // 2 or u is None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["u", "v"])
                left, right, size = [], [], 0
