"""Removal of word passages that repeat across documents, by recompression.

A document's words are recompressed in rounds: the first names every run of equal symbols, and each
round names pairs: symbols fall into a left and a right half by a bit of their name, and a left one
followed by a right one becomes a new symbol. A name is a hash of what it stands for, so names agree
over the whole corpus, in every task, without a table of names. Whether two symbols pair depends on
those two alone. So the part of a window's parse that does not depend on its surroundings, its
core, is known from the window: drop the runs at its borders, then in each round a first symbol of
the right half and a last one of the left half. Equal windows have equal cores, at every level.

1. Every window of ``window`` words chooses from its core at the highest level that leaves one the
   symbol with the longest span (ties: least name, then leftmost); a window without one (say, one word
   repeated) chooses from its words. Records hold the symbol's name, its document and place, which windows
   chose it, and a name of each of these. What repeats within a task is settled there; where the least
   document holds the same record again, the later places follow the names in its one record.
2. Records meet by symbol. Windows with the same symbol and name (64 bits each) are equal; those in a
   document with a greater id than the least are marked.
3. Marks are joined to the documents, and the words that marked windows cover go.

Only steps 2 and 3 shuffle: about a fifth of the words as records, then the texts.

Nulls: a null text has no words; a document without id is returned whole and is no source. Rows with
the same id are one document's: none is a source for the other. Of equal passages the one of the least id stays, in all its
places. Texts of any length are read whole. An empty table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.

No word is compared again: with 64 bits of a symbol's name and 64 of a window's, two different windows of 13 words count as
one with a chance of 2**-128 a pair; within a symbol that 10**8 different windows choose, 5 * 10**15 pairs at 2**-64 make about 0.0003 such cases. Rows that share an id and differ in text take marks that are not theirs with a
chance of 2**-16.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, text_or_empty, written

WINDOW = 13
ROUNDS = 3
#: Units of 4 bytes of a window's name in the records; a later place of a record's windows in the same text takes one.
NAME_UNITS = 2
UNIT_BYTES = 4
#: Bits of a text's hash that tell rows with the same doc_id apart.
TAG_BITS = 16
#: Words parsed at once, words of a task whose records are settled together, and records handed on at once: they bound a task's memory only.
BATCH_WORDS, SETTLED_WORDS, HANDED_RECORDS = 100_000, 6_000_000, 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
#: Salts of the levels and rounds.
_LEVEL = np.arange(1, 65, dtype=np.uint64) * _MIX


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX2
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_names(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_digest

    return np.frombuffer(b"".join(map(xxh64_digest, words)), dtype=">u8").astype(np.uint64)


def parse_levels(names: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS):
    """Levels of the parse of concatenated documents.

    names: of the words; doc: number of each word's document. Yields (name, begin, end, place, right)
    per level: symbols with their word spans, for each symbol of the level below the place of the symbol that holds it,
    and for that level below which symbols are in the right half (None for runs).
    """
    n = len(names)
    new = np.ones(n, dtype=bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    begin = np.nonzero(new)[0]
    end = np.append(begin[1:], n)
    name, own = names[begin], doc[begin]
    length = (end - begin).astype(np.uint64)
    name = np.where(length > 1, _mixed(name + length * _MIX), name)
    yield name, begin, end, np.cumsum(new) - 1, None
    for k in range(rounds):
        right = (_mixed(name + _LEVEL[k]) >> np.uint64(63)).astype(bool)
        pair = ~right[:-1] & right[1:] & (own[:-1] == own[1:])
        second = np.zeros(len(name), dtype=bool)
        second[1:] = pair
        head = np.nonzero(~second)[0]
        joined = np.zeros(len(name), dtype=bool)
        joined[:-1] = pair
        joined = joined[head]
        tail = np.minimum(head + 1, len(name) - 1)
        paired = _mixed(_mixed(name[head] * np.uint64(3) + np.uint64(k + 1)) ^ (name[tail] * _MIX + np.uint64(1)))
        end = np.where(joined, end[tail], end[head])
        begin, own = begin[head], own[head]
        name = np.where(joined, paired, name[head])
        yield name, begin, end, np.cumsum(~second) - 1, right


def chosen_symbols(names: np.ndarray, doc: np.ndarray, starts: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS):
    """The symbol that each window at ``starts`` chooses: name, level and first word."""
    levels = [(names, np.arange(len(names)), np.arange(1, len(names) + 1), starts, starts + window)]
    lo = hi = None
    for name, begin, end, place, right in parse_levels(names, doc, rounds):
        if right is None:
            lo = place[starts] + 1
            hi = place[starts + window - 1]
        else:
            known = lo < hi
            first, last = np.where(known, lo, 0), np.where(known, hi - 1, 0)
            low, high = lo + right[first], hi - ~right[last]
            known &= low < high
            top = len(place) - 1
            lo = np.where(known, place[np.minimum(low, top)], 0)
            hi = np.where(known, place[np.clip(high - 1, 0, top)] + 1, 0)
        levels.append((name, begin, end, lo, hi))
    todo = np.ones(len(starts), dtype=bool)
    chosen = np.zeros(len(starts), dtype=np.uint64)
    where = np.zeros(len(starts), dtype=np.int64)
    level = np.zeros(len(starts), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name, begin, end, lo, hi = levels[k]
        which = np.nonzero(todo & (lo < hi))[0]
        if not len(which):
            continue
        todo[which] = False
        left, right = lo[which], hi[which]
        span = np.minimum(end - begin, 62).astype(np.uint64)
        rank = ((np.uint64(63) - span) << np.uint64(58)) | (_mixed(name) >> np.uint64(6))
        best, at = rank[left], left.copy()
        for t in range(1, int((right - left).max())):
            place = np.minimum(left + t, len(rank) - 1)
            better = (left + t < right) & (rank[place] < best)
            best = np.where(better, rank[place], best)
            at = np.where(better, place, at)
        chosen[which] = _mixed(name[at] + _LEVEL[k])
        where[which] = begin[at]
        level[which] = k
    return chosen, level, where


def window_names(names: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit name of each window's word sequence."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in range(window):
        out = (out ^ names[starts + k]) * _MIX
        out ^= out >> np.uint64(29)
    return _mixed(out)


def _batches(texts):
    """Words of consecutive texts in lots of about BATCH_WORDS: (first text, list of word lists)."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").split()
        held.append(words)
        size += len(words)
        if size >= BATCH_WORDS:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def _emptied(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; the list is emptied."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _settled(parts, found, doc_ids, tags, window):
    """Record batches of the records of some lots (name, row, pos, mask, spread, count) and their window names; empties the lists."""
    import pyarrow as pa

    if not found:
        return
    name, row, pos, mask, spread, count = map(_emptied, parts)
    found = _emptied(found)
    doc_id = doc_ids[row]
    # Records with the same name and windows: the least document's stay, greater ones are marked.
    order = np.lexsort((row, doc_id, mask, spread, name))
    fresh = np.ones(len(order), dtype=bool)
    a, b = order[1:], order[:-1]
    fresh[1:] = (name[a] != name[b]) | (spread[a] != spread[b]) | (mask[a] != mask[b])
    del spread
    least = doc_id[order[fresh]][np.cumsum(fresh) - 1]
    marked = order[doc_id[order] > least]
    # A later place in the same row goes with the row's first record; another document may yet be their source.
    first = fresh
    first[1:] |= row[a] != row[b]
    at_least = doc_id[order] == least
    del least, a, b
    later = at_least & ~first
    keep = order[at_least & first]
    # The places in ``keep`` of the later ones' first records, ascending.
    owner = (np.cumsum(at_least & first) - 1)[later]
    later_pos = pos[order[later]]
    del order, fresh, first, at_least, later
    more = np.bincount(owner, minlength=len(keep))
    names_at = np.cumsum(count, dtype=np.int64) - count

    def batch(key, which, offsets, data):
        binary = pa.BinaryArray.from_buffers(pa.binary(), len(which), [None, pa.py_buffer((offsets * UNIT_BYTES).astype(np.int32)), pa.py_buffer(data)])
        at = (pos[which].astype(np.int64) << (window + TAG_BITS)) | (tags[row[which]].astype(np.int64) << window) | mask[which]
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc_id[which]), pa.array(at), binary], names=["key", "doc_id", "place", "windows"])

    # The records in the order of their names' bytes, each followed by its later places.
    for start in range(0, len(keep), HANDED_RECORDS):
        which, behind = keep[start : start + HANDED_RECORDS], more[start : start + HANDED_RECORDS]
        n = count[which].astype(np.int64)
        size = n * NAME_UNITS + behind
        ends = np.cumsum(size)
        data = np.zeros(int(ends[-1]), dtype="<u4")
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        to = np.repeat(ends - size, n) + nth * NAME_UNITS
        window_name = found[np.repeat(names_at[which], n) + nth]
        data[to] = window_name & np.uint64(0xFFFFFFFF)
        data[to + 1] = window_name >> np.uint64(32)
        p, q = np.searchsorted(owner, [start, start + len(which)])
        own = owner[p:q] - start
        nth = np.arange(q - p) - (np.cumsum(behind) - behind)[own]
        data[ends[own] - behind[own] + nth] = later_pos[p:q]
        yield batch(name[which], which, np.append(0, ends), data)
    for start in range(0, len(marked), HANDED_RECORDS):
        which = marked[start : start + HANDED_RECORDS]
        yield batch(_mixed(doc_id[which].astype(np.uint64)), which, np.zeros(len(which) + 1, dtype=np.int64), np.zeros(0, dtype="<u4"))


_RECORD = "key long, doc_id long, place long, windows binary"


def records(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Records of step 1 from (doc_id, text, digest); marks already known have no windows and their document's hash as key.

    ``place`` holds a bit for each window (how many words it starts before the symbol), above these the text's tag, then the symbol's first word.
    """

    def run(batches):
        for batch in batches:
            ids, tags = batch.column(0).to_pylist(), batch.column(2).to_numpy() & ((1 << TAG_BITS) - 1)
            doc_ids = np.array([i or 0 for i in ids], dtype=np.int64)
            parts, found, held = tuple([] for _ in range(6)), [], 0
            for first, lists in _batches(t.as_py() for t in batch.column(1)):
                lists = [w if ids[first + k] is not None and len(w) >= window else [] for k, w in enumerate(lists)]
                sizes = np.array([len(w) for w in lists])
                if not sizes.sum():
                    continue
                names = word_names([x for w in lists for x in w])
                doc = np.repeat(np.arange(len(lists)), sizes)
                base = np.cumsum(sizes) - sizes
                starts = np.nonzero(np.arange(len(names)) - base[doc] + window <= sizes[doc])[0]
                name, level, begin = chosen_symbols(names, doc, starts, window)
                place = begin * 8 + level
                order = np.argsort(place, kind="stable")
                place = place[order]
                cut = np.ones(len(order), dtype=bool)
                cut[1:] = place[1:] != place[:-1]
                cut = np.nonzero(cut)[0]
                rel = (begin - starts)[order]
                windows = window_names(names, starts, window)[order]
                lead = order[cut]
                own = doc[begin[lead]]
                records_of_lot = (
                    name[lead],
                    (first + own).astype(np.int32),
                    (begin[lead] - base[own]).astype(np.int32),
                    np.bitwise_or.reduceat(np.left_shift(1, rel), cut).astype(np.int32),
                    np.add.reduceat(_mixed(windows + rel.astype(np.uint64) * _MIX), cut),
                    np.diff(np.append(cut, len(order))).astype(np.int32),
                )
                for column, values in zip(parts, records_of_lot):
                    column.append(values)
                found.append(windows)
                held += len(names)
                if held >= SETTLED_WORDS:
                    yield from _settled(parts, found, doc_ids, tags, window)
                    held = 0
            yield from _settled(parts, found, doc_ids, tags, window)

    return documents.mapInArrow(run, _RECORD)


def _marked(key, doc_id, mask, offsets, data, window):
    """Of records of whole groups, the masks of windows that also start in a document with a smaller id; offsets in units."""
    out = np.zeros(len(key), dtype=np.int64)
    full = offsets[1:] > offsets[:-1]
    out[~full] = mask[~full]
    shared = np.zeros(len(key), dtype=bool)
    shared[1:] |= key[1:] == key[:-1]
    shared[:-1] |= key[1:] == key[:-1]
    which = np.nonzero(full & shared)[0]
    if not len(which):
        return out
    down = np.arange(window - 1, -1, -1)
    row, bit = np.nonzero((mask[which, None] >> down) & 1)
    rel, record = down[bit], which[row]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    at = offsets[record] + nth * NAME_UNITS
    name = data[at].astype(np.uint64) | (data[at + 1].astype(np.uint64) << np.uint64(32))
    order = np.lexsort((doc_id[record], name, key[record]))
    fresh = np.ones(len(order), dtype=bool)
    a, b = order[1:], order[:-1]
    fresh[1:] = (key[record[a]] != key[record[b]]) | (name[a] != name[b])
    least = doc_id[record[order[fresh]]][np.cumsum(fresh) - 1]
    dup = order[doc_id[record[order]] > least]
    return out + np.bincount(record[dup], weights=np.left_shift(1, rel[dup]).astype(np.float64), minlength=len(key)).astype(np.int64)


def marks(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Marked windows: doc_id and for each record that has any its place: pos, tag and mask in one number."""

    def emit(table):
        import pyarrow as pa

        table = table.combine_chunks()
        binary = table.column("windows").chunk(0)
        offsets = np.frombuffer(binary.buffers()[1], dtype=np.int32)[binary.offset : binary.offset + len(binary) + 1].astype(np.int64) // UNIT_BYTES
        # A value's length is a multiple of the unit, so the values' own bytes are whole units.
        units = int(offsets[-1])
        data = np.frombuffer(binary.buffers()[2], dtype="<u4", count=units) if units else np.zeros(0, "<u4")
        doc_id, place = table.column("doc_id").to_numpy(), table.column("place").to_numpy()
        mask = place & ((1 << window) - 1)
        out = _marked(table.column("key").to_numpy(), doc_id, mask, offsets, data, window)
        have = np.nonzero(out)[0]
        pos = place[have] >> (window + TAG_BITS)
        # Later places of the same windows, behind their names.
        names = np.bitwise_count(mask[have]).astype(np.int64) * NAME_UNITS
        more = np.maximum(offsets[have + 1] - offsets[have] - names, 0)
        nth = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
        at = np.repeat(offsets[have] + names, more) + nth
        later = data[at].astype(np.int64)
        have, pos = np.concatenate([have, np.repeat(have, more)]), np.concatenate([pos, later])
        tag = (place[have] >> window) & ((1 << TAG_BITS) - 1)
        marked = (pos << (window + TAG_BITS)) | (tag << window) | out[have]
        return pa.RecordBatch.from_arrays([pa.array(doc_id[have]), pa.array(marked)], names=["doc_id", "place"])

    def run(batches):
        import pyarrow as pa

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            key = table.column("key").to_numpy()
            # The records of the last name wait for the next batch.
            other = np.nonzero(key != key[-1])[0]
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut or (held and held[0].column("key")[0].as_py() != key[0]):
                yield emit(pa.concat_tables([*held, table.slice(0, cut)]))
                held = []
            held.append(table.slice(cut))
        if held:
            yield emit(pa.concat_tables(held))

    dealt = found.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "doc_id long, place long")


def without_repeats(spark: SparkSession, documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without the repeated passages: doc_id, kept_text, n_words, n_removed, kept_sha256."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = written(spark, marks(records(docs.withColumn("digest", F.xxhash64("text")), window), window), "marks")
    release(spark)
    joined = docs.join(found.groupBy("doc_id").agg(F.collect_list("place").alias("places")), "doc_id", "left")
    joined = joined.select("doc_id", "text", "places", F.xxhash64("text").alias("digest"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept, total, gone, sha = [], [], [], []
            places, digests = batch.column(2), batch.column(3).to_numpy()
            for k, text in enumerate(batch.column(1)):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                total.append(len(words))
                marked = places[k]
                if marked.is_valid:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    packed = marked.values.to_numpy()
                    packed = packed[((packed >> window) ^ digests[k]) & ((1 << TAG_BITS) - 1) == 0]
                    pos, mask = packed >> (window + TAG_BITS), packed & ((1 << window) - 1)
                    for r in range(window):
                        start = pos[((mask >> r) & 1) == 1] - r
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + window, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                gone.append(total[-1] - len(words))
                out = b" ".join(words)
                sha.append(hashlib.sha256(out).hexdigest())
                kept.append(out.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "kept_text", "n_words", "n_removed", "kept_sha256"],
            )

    return joined.mapInArrow(run, "doc_id long, kept_text string, n_words long, n_removed long, kept_sha256 string")
