"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters the network as a learned vector of the word itself beside the mean of the learned
vectors of its character n-grams (word borders included). Two recurrent passes read a window of
``WINDOW`` words, attention pools their states, and a logistic unit scores the pool. All windows of
a text, each half over the next, are scored; the text's score is calibrated from its greatest
window score and the sum of all of them.

Labels belong to texts, so training picks windows: at first those with the most telling words, then
twice anew those that the network itself scores highest, of toxic and of clean texts alike. It runs
on the driver over at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled rows, chosen by a hash of their id among
those not held out; scoring covers every whole text.

Nulls and empty texts have no words and get the score of no evidence, near 0. Rows without an id are scored
and never held out or learned from. Without labels of both kinds every score is the share of
toxic labels. Of rows that share an id, and of labels that do, one is learned from (the least hash of the text, the toxic label);
each is scored by its own text, so repeated rows score alike. A text of any length is scored whole, at a memory of its own words. Ties at 0.5
count as toxic. An empty table gives no rows. ``without_toxic`` returns all columns, whatever their names, as they are.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, lean, text_or_empty

MAX_TOXIC, MAX_CLEAN = 1200, 2000
WINDOW, STRIDE = 64, 32
UNITS, WORD_DIM, CHAR_DIM = 8, 8, 8
WORD_ROWS = CHAR_ROWS = 1 << 16
NGRAMS = (3, 4, 5)
HELD_OUT_MOD = 5
#: Words scored at once, and windows in one pass of the network.
LOT_WORDS, LOT_WINDOWS = 150_000, 4096
#: Training: passes over the chosen windows between choices, rows in a step, step sizes.
PASSES, BATCH, RATE, TABLE_RATE = (4, 3, 3), 64, 0.012, 0.18
NO_EVIDENCE = -8.0
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: row of the word table, rows of the n-gram table, and the word of each of these."""
    raw = [w.strip(_STRIP).encode("utf-8", "surrogatepass") for w in words]
    word = np.fromiter((crc32(w) & (WORD_ROWS - 1) for w in raw), dtype=np.int64, count=len(raw))
    data = np.frombuffer(b"".join([b"<" + w + b">" for w in raw]), dtype=np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 2
    owner = np.repeat(np.arange(len(raw)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))
    rows, owners = [], []
    for n in NGRAMS:
        at = np.nonzero(left >= n)[0]
        h = np.full(len(at), n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ data[at + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        rows.append((h & np.uint32(CHAR_ROWS - 1)).astype(np.int32))
        owners.append(owner[at].astype(np.int32))
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return word, rows[order], owners[order]


def _tanh_half(x: np.ndarray) -> np.ndarray:
    """Logistic function."""
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Network:
    """Parameters, forward pass and training steps."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *s, scale=1.0: (rng.standard_normal(s) * scale).astype(np.float32)
        d, u = WORD_DIM + CHAR_DIM, UNITS
        self.p = {
            "W": f(2, d, 3 * u, scale=0.6 / np.sqrt(d) * 2),
            "U": f(2, u, 3 * u, scale=0.5 / np.sqrt(u)),
            "b": np.zeros((2, 3 * u), np.float32),
            "v": f(2 * u, scale=0.5),
            "w": f(2 * u, scale=0.5),
            "c": np.zeros(1, np.float32),
        }
        self.words = np.zeros((WORD_ROWS, WORD_DIM), np.float32)
        self.chars = np.zeros((CHAR_ROWS, CHAR_DIM), np.float32)
        self.calibration = np.array([1.0, 0.0, 0.0])

    def inputs(self, word, rows, owners) -> np.ndarray:
        """Input vectors of distinct words; the last row, of zeros, is for padding."""
        out = np.zeros((len(word) + 1, WORD_DIM + CHAR_DIM), np.float32)
        out[:-1, :WORD_DIM] = self.words[word]
        if len(rows):
            starts = np.nonzero(np.r_[True, owners[1:] != owners[:-1]])[0]
            ends = np.append(starts[1:], len(rows))
            for k in range(0, len(starts), 20_000):
                a, b = starts[k : k + 20_000], ends[k : k + 20_000]
                sums = np.add.reduceat(self.chars[rows[a[0] : b[-1]]], a - a[0], axis=0)
                out[owners[a], WORD_DIM:] = sums / (b - a)[:, None].astype(np.float32)
        return out

    def _pass(self, x, ids, direction, keep=False):
        """States (T, B, units) of one direction; x: projected inputs of distinct words."""
        u, (size, steps) = UNITS, ids.shape
        weights = self.p["U"][direction]
        h = np.zeros((size, u), np.float32)
        states, saved = np.empty((steps, size, u), np.float32), []
        for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
            g = x[ids[:, t]]
            gates = _tanh_half(g[:, : 2 * u] + h @ weights[:, : 2 * u])
            r, z = gates[:, :u], gates[:, u:]
            rh = r * h
            n = np.tanh(g[:, 2 * u :] + rh @ weights[:, 2 * u :])
            new = n + z * (h - n)
            if keep:
                saved.append((t, h, r, z, n, rh))
            states[t] = h = new
        return states, saved

    def forward(self, x, ids, real, keep=False):
        """Logits of windows ``ids`` (rows of x; ``real``: not padding)."""
        p = self.p
        proj = [x @ p["W"][k] + p["b"][k] for k in (0, 1)]
        (hf, sf), (hb, sb) = self._pass(proj[0], ids, 0, keep), self._pass(proj[1], ids, 1, keep)
        h = np.concatenate([hf, hb], axis=2)
        e = np.where(real.T, h @ p["v"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        a = e / e.sum(axis=0)
        pool = (a[:, :, None] * h).sum(axis=0)
        logit = pool @ p["w"] + p["c"][0]
        return (logit, (h, a, pool, sf, sb)) if keep else logit

    def gradients(self, x, ids, real, y):
        """Gradients of the mean log loss: of the parameters and of x's rows."""
        p, u = self.p, UNITS
        logit, (h, a, pool, sf, sb) = self.forward(x, ids, real, True)
        d_logit = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["w"], g["c"] = pool.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pool = d_logit[:, None] * p["w"]
        d_a = (h * d_pool).sum(axis=2)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["v"] = np.einsum("tb,tbk->k", d_e, h)
        d_h = a[:, :, None] * d_pool + d_e[:, :, None] * p["v"]
        d_x = np.zeros_like(x)
        for k, saved in ((0, sf), (1, sb)):
            weights, own = p["U"][k], d_h[:, :, k * u : (k + 1) * u]
            back = np.zeros_like(own[0])
            d_steps = np.empty((*ids.shape, 3 * u), np.float32)
            for t, h0, r, z, n, rh in reversed(saved):
                d = own[t] + back
                d_n = d * (1 - z) * (1 - n * n)
                d_z = d * (h0 - n) * z * (1 - z)
                d_rh = d_n @ weights[:, 2 * u :].T
                d_r = d_rh * h0 * r * (1 - r)
                d_gate = np.concatenate([d_r, d_z], axis=1)
                back = d * z + d_rh * r + d_gate @ weights[:, : 2 * u].T
                g["U"][k][:, : 2 * u] += h0.T @ d_gate
                g["U"][k][:, 2 * u :] += rh.T @ d_n
                d_steps[:, t, : 2 * u], d_steps[:, t, 2 * u :] = d_gate, d_n
            d_proj = _summed(ids.reshape(-1), d_steps.reshape(-1, 3 * u), len(x))
            g["W"][k], g["b"][k] = x.T @ d_proj, d_proj.sum(axis=0)
            d_x += d_proj @ p["W"][k].T
        d_x[-1] = 0
        return g, d_x


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of each row number under n."""
    order = np.argsort(rows, kind="stable")
    starts = np.nonzero(np.r_[True, rows[order][1:] != rows[order][:-1]])[0]
    out = np.zeros((n, values.shape[1]), values.dtype)
    out[rows[order][starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of each window of texts of these sizes; a last window ends with its text."""
    count = np.where(sizes > WINDOW, -(-(sizes - WINDOW) // STRIDE) + 1, np.minimum(sizes, 1))
    text = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return np.maximum(0, np.minimum(nth * STRIDE, sizes[text] - WINDOW)), text


def distinct(lists: list[list[str]]) -> tuple[list[str], np.ndarray]:
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for words in lists for w in words), dtype=np.int32, count=sum(map(len, lists)))
    return list(known), ids


def window_ids(ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, text: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    first = (np.cumsum(sizes) - sizes)[text] + starts
    place = first[:, None] + np.arange(WINDOW)
    real = starts[:, None] + np.arange(WINDOW) < sizes[text][:, None]
    return np.where(real, ids[np.minimum(place, max(0, len(ids) - 1))] if len(ids) else padding, padding), real


def best_windows(network: Network, types: list[str], ids: np.ndarray, sizes: np.ndarray, features=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its greatest window logit, the sum of its windows' probabilities, and the first word of that window."""
    best, at = np.full(len(sizes), NO_EVIDENCE), np.zeros(len(sizes), dtype=np.int64)
    starts, text = windows_of(sizes)
    if not len(starts):
        return best, np.zeros(len(sizes)), at
    x = network.inputs(*(features or word_features(types)))
    logits = np.empty(len(starts))
    for k in range(0, len(starts), LOT_WINDOWS):
        part = slice(k, k + LOT_WINDOWS)
        logits[part] = network.forward(x, *window_ids(ids, sizes, starts[part], text[part], len(types)))
    order = np.lexsort((-logits, text))
    lead = order[np.r_[True, text[order][1:] != text[order][:-1]]]
    best[text[lead]], at[text[lead]] = logits[lead], starts[lead]
    return best, np.bincount(text, weights=1 / (1 + np.exp(-np.clip(logits, -30, 30))), minlength=len(sizes)), at


def scores(network: Network, texts) -> np.ndarray:
    """Calibrated scores of whole texts, in lots of about LOT_WORDS words."""
    out, held, size = [], [], 0

    def flush():
        sizes = np.array([len(w) for w in held], dtype=np.int64)
        best, count, _ = best_windows(network, *distinct(held), sizes)
        a, b, c = network.calibration
        out.append(1 / (1 + np.exp(-np.clip(a * best + b * np.log1p(count) + c, -30, 30))))

    for text in texts:
        held.append(words_of(text))
        size += len(held[-1])
        if size >= LOT_WORDS:
            flush()
            held, size = [], 0
    if held:
        flush()
    return np.concatenate(out) if out else np.zeros(0)


def _telling(features, ids, sizes, y, types: int) -> np.ndarray:
    """A first guess of each word's weight: the greatest log odds among its n-grams by texts that hold them."""
    _, rows, owners = features
    start = np.searchsorted(owners, np.arange(types + 1))
    counts = np.zeros((2, CHAR_ROWS))
    ends = np.cumsum(sizes)
    for k, (first, end) in enumerate(zip(ends - sizes, ends)):
        word = np.unique(ids[first:end])
        n = start[word + 1] - start[word]
        which = np.repeat(start[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        counts[int(y[k]), np.unique(rows[which])] += 1
    miss, hit = counts
    odds = np.log((hit + 0.5) / (y.sum() + 1)) - np.log((miss + 0.5) / ((1 - y).sum() + 1))
    odds *= hit + miss >= 5
    out = np.zeros(types)
    np.maximum.at(out, owners, odds[rows])
    return out


def train(texts: list[str], labels: list[int], prior: float | None = None, seed: int = 7) -> Network:
    """Fits a network to labelled texts; ``prior``: share of toxic texts where the sample's differs."""
    rng, network = np.random.default_rng(seed), Network(seed)
    y = np.asarray(labels, dtype=np.float64)
    share = min(max(prior if prior is not None else (y.mean() if len(y) else 0.0), 1e-6), 1 - 1e-6)
    if not len(y) or y.min() == y.max():
        network.calibration = np.array([0.0, 0.0, np.log(share / (1 - share))])
        return network
    known: dict[str, int] = {}
    parts = [np.fromiter((known.setdefault(w, len(known)) for w in words_of(t)), dtype=np.int32) for t in texts]
    sizes, ids, types = np.array([len(p) for p in parts], dtype=np.int64), np.concatenate(parts), list(known)
    del parts, known
    features = word_features(types)
    word, rows, owners = features
    first_row = np.searchsorted(owners, np.arange(len(types) + 1))
    starts, text = windows_of(sizes)
    weight = np.append(_telling(features, ids, sizes, y, len(types)), 0)
    guess = rng.random(len(starts)) * 1e-3
    for k in range(0, len(starts), LOT_WINDOWS):
        part = slice(k, k + LOT_WINDOWS)
        guess[part] += np.sort(weight[window_ids(ids, sizes, starts[part], text[part], len(types))[0]], axis=1)[:, -3:].sum(axis=1)
    order = np.lexsort((-guess, text))
    lead = order[np.r_[True, text[order][1:] != text[order][:-1]]]
    # Clean texts start with two windows, a likely one and any one.
    some = rng.permutation(np.nonzero(y[text] == 0)[0])[: len(lead) // 2]
    windows = np.concatenate([lead, some])
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    word_sq, char_sq, step = np.full(WORD_ROWS, 1e-8, np.float32), np.full(CHAR_ROWS, 1e-8, np.float32), 0
    for k, passes in enumerate(PASSES):
        if k:
            best, _, at = best_windows(network, types, ids, sizes, features)
            hard = window_ids(ids, sizes, at[sizes > 0], np.nonzero(sizes > 0)[0], len(types))
            extra = window_ids(ids, sizes, starts[some], text[some], len(types))
            data = [np.concatenate(z) for z in zip(hard, extra)]
            target = np.concatenate([y[sizes > 0], y[text[some]]])
        else:
            data, target = list(window_ids(ids, sizes, starts[windows], text[windows], len(types))), y[text[windows]]
        for _ in range(passes):
            for part in np.array_split(rng.permutation(len(target)), max(1, len(target) // BATCH)):
                used, local = np.unique(data[0][part], return_inverse=True)
                if used[-1] != len(types):
                    used = np.append(used, len(types))
                real_words = used[:-1]
                n = first_row[real_words + 1] - first_row[real_words]
                own = np.repeat(np.arange(len(real_words)), n)
                row = rows[np.repeat(first_row[real_words] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                x = network.inputs(word[real_words], row, own)
                g, d_x = network.gradients(x, local.reshape(len(part), WINDOW), data[1][part], target[part])
                step += 1
                for name, value in network.p.items():
                    a, b = m[name]
                    a += 0.1 * (g[name] - a)
                    b += 0.001 * (g[name] ** 2 - b)
                    value -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6)
                for table, squares, at, grad in (
                    (network.words, word_sq, word[real_words], d_x[:-1, :WORD_DIM]),
                    (network.chars, char_sq, row, (d_x[:-1, WORD_DIM:] / np.maximum(n, 1)[:, None])[own]),
                ):
                    spots, back = np.unique(at, return_inverse=True)
                    total = _summed(back, grad, len(spots))
                    squares[spots] += (total**2).mean(axis=1)
                    table[spots] -= TABLE_RATE * total / np.sqrt(squares[spots])[:, None]
    best, count, _ = best_windows(network, types, ids, sizes, features)
    _calibrate(network, best, count, y, share)
    return network


def _calibrate(network: Network, best, count, y, share) -> None:
    """Logistic regression of the label on the best window and the sum of the windows, moved to the prior."""
    features = np.stack([best, np.log1p(count), np.ones(len(y))], axis=1)
    beta = np.array([1.0, 0.0, 0.0])
    ridge = np.diag([1e-2, 1.0, 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        slope = features.T @ (p - y) + ridge @ (beta - [1.0, 0.0, 0.0])
        beta = beta - np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + ridge, slope)
    sample = y.mean()
    beta[2] += np.log(share / (1 - share)) - np.log(sample / (1 - sample))
    network.calibration = beta


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_MOD == 0, F.lit(False))


def trained(documents: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Network:
    """A network from the labelled documents that are not held out: at most max_toxic and max_clean rows, by hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_hash = lambda kind, n: known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = by_hash(1, max_toxic).union(by_hash(0, max_clean))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # The sample has at most max_toxic + max_clean rows, so it may be broadcast.
    # Of rows with one id, the one of least hash is learned from, so no more rows reach the driver than the sample has.
    labelled = docs.join(F.broadcast(sample), "doc_id").withColumn("digest", F.xxhash64("text"))
    least = labelled.groupBy("doc_id").agg(F.min("digest").alias("digest"))
    labelled = labelled.join(F.broadcast(least), ["doc_id", "digest"]).groupBy("doc_id", "digest").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = labelled.select("doc_id", "text", "toxic").toPandas().sort_values(["doc_id", "text"])
    total = counts.get(0, 0) + counts.get(1, 0)
    return train(rows["text"].tolist(), rows["toxic"].tolist(), counts.get(1, 0) / total if total else 0.0)


def scored(documents: DataFrame, network: Network, name: str = "score") -> DataFrame:
    """All columns of the documents, and the score of every one under ``name``, which they must not have."""
    shared = documents.sparkSession.sparkContext.broadcast(network)  # of a fixed size

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = scores(shared.value, (t.as_py() or "" for t in batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*documents.schema.fields]).add(name, DoubleType())
    return documents.mapInArrow(lean(run), schema)


def without_toxic(documents: DataFrame, network: Network, least: float = 0.5) -> DataFrame:
    """The documents, with their own columns, that score under ``least``."""
    name = free_name(documents, "score")
    return scored(documents, network, name).where(F.col(name) < least).select(*(F.col(f"`{c}`") for c in documents.columns))


def toxicity(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    network = trained(documents, labels)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out = scored(docs, network).select("doc_id", held_out().alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
