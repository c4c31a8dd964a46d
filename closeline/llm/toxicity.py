"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Each word is an embedding of its own, its log-odds among the training texts, and the mean
of embeddings of its character trigrams (bytes, A-Z folded, with word edges). Windows of
``WINDOW`` words, half of it apart, cover every text whole; a forward and a backward gated
recurrent network read each, attention pools their states, and a logistic unit scores the
window. A text's score is that of its worst window.

The network is fitted on at most ``PER_CLASS`` labelled texts of either class, none over
``FIT_BYTES`` bytes, chosen by a hash of the id: documented bounds of the sample alone. As
labels are of texts and not of windows, a toxic text lends its window with the greatest
log-odds, a clean one that window and a random one. Scoring is bounded by slices of a few
MB per task and covers every text whole.

A null text is an empty one; a text without words scores 0. Repeated rows and ties score
alike. A null id is scored and counts as not held out. With labels of one class only, or
none, every score is the share of toxic ones. An empty table gives no rows. Further
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from closeline.llm import texts

PER_CLASS = 3000
FIT_BYTES = 20_000
WINDOW, STRIDE = 32, 16
STATES = 8
WORD_SIZE, CHAR_SIZE = 6, 6
CHAR_CELLS = 1 << 13
LEAST_TEXTS = 3
EPOCHS, BATCH, RATE = 5, 256, 0.01
STEPS = 150  # at least, where a small sample has few batches
CUT = 0.3


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tokens(s: texts.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, words per row, trigram cells of all words, first cell and number of cells per word."""
    data = texts.FOLD[s.data]
    starts, ends = texts.spans(s, texts.IS_SPACE)
    # Surrounding ASCII marks are no part of a word's identity.
    plain = np.isin(np.arange(256), list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256)))
    inner = np.flatnonzero(plain[data]) if len(data) else np.zeros(0, np.int64)
    a, z = np.searchsorted(inner, starts), np.searchsorted(inner, ends)
    some = z > a
    starts, ends = starts.copy(), ends.copy()
    starts[some], ends[some] = inner[a[some]], inner[z[some] - 1] + 1
    wide = np.concatenate((np.zeros(1, np.uint64), data.astype(np.uint64), np.zeros(1, np.uint64)))
    n = ends - starts
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat(starts - first, n)
    before, after = wide[at], wide[at + 2]
    before[first], after[first + n - 1] = 0, 0
    cells = (texts.mix(before << np.uint64(16) | wide[at + 1] << np.uint64(8) | after) & np.uint64(CHAR_CELLS - 1)).astype(np.int64)
    return texts.hashes(data, starts, ends), s.per_row(starts), cells, first, n


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and length of every window of rows of so many words."""
    per = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(len(counts)), per)
    place = (np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)) * STRIDE
    base = np.cumsum(counts) - counts
    return row, base[row] + place, np.minimum(WINDOW, counts[row] - place)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The network; ``forward`` keeps what ``backward`` needs."""

    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        size = WORD_SIZE + 1 + CHAR_SIZE
        self.vocabulary, self.odds = vocabulary, odds.astype(np.float32)
        self.p = {"word": draw(len(vocabulary) + 1, WORD_SIZE) * 0.3, "char": draw(CHAR_CELLS, CHAR_SIZE), "att": draw(2 * STATES, STATES), "att_b": draw(STATES), "att_v": draw(STATES), "out": draw(2 * STATES), "out_b": np.zeros(1, np.float32)}
        for d in ("f", "b"):
            self.p |= {f"{d}_in": draw(size, 3 * STATES), f"{d}_bias": np.zeros(3 * STATES, np.float32), f"{d}_state": draw(STATES, 3 * STATES)}

    def places(self, words: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary; its length where it is unknown."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), max(len(self.vocabulary) - 1, 0))
        return np.where(self.vocabulary[at] == words, at, len(self.vocabulary)) if len(self.vocabulary) else np.zeros(len(words), np.int64)

    def inputs(self, words: np.ndarray, cells: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word in the vocabulary and its input vector."""
        at = self.places(words)
        chars = np.add.reduceat(self.p["char"][cells], first, axis=0) / n[:, None] if len(first) else np.zeros((0, CHAR_SIZE), np.float32)
        return at, np.concatenate((self.p["word"][at], np.append(self.odds, 0)[at][:, None], chars), axis=1).astype(np.float32)

    def forward(self, x: np.ndarray, start: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logit of each window of the word vectors."""
        steps = int(length.max())
        at = start[:, None] + np.minimum(np.arange(steps), length[:, None] - 1)
        there = (np.arange(steps) < length[:, None]).astype(np.float32)
        states = np.zeros((len(start), steps, 2 * STATES), np.float32)
        kept = {}
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            inner = x @ self.p[f"{d}_in"] + self.p[f"{d}_bias"]
            h = np.zeros((len(start), STATES), np.float32)
            for t in order:
                i, g, m = inner[at[:, t]], h @ self.p[f"{d}_state"], there[:, t, None]
                gates = _sigmoid(i[:, :2 * STATES] + g[:, :2 * STATES])
                z, r = gates[:, :STATES], gates[:, STATES:]
                n = np.tanh(i[:, 2 * STATES:] + r * g[:, 2 * STATES:])
                if keep:
                    kept[d, t] = h, z, r, n, g[:, 2 * STATES:]
                h = h + m * (1 - z) * (n - h)
                states[:, t, (0 if d == "f" else STATES):(STATES if d == "f" else 2 * STATES)] = h
        u = np.tanh(states @ self.p["att"] + self.p["att_b"])
        e = np.exp(np.clip(u @ self.p["att_v"], -30, 30)) * there
        weight = e / e.sum(axis=1, keepdims=True)
        pooled = np.einsum("bt,bts->bs", weight, states)
        logit = pooled @ self.p["out"] + self.p["out_b"][0]
        return (logit, (at, there, states, u, weight, pooled, kept)) if keep else logit

    def backward(self, x: np.ndarray, delta: np.ndarray, saved) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the word vectors, for gradients of the logits."""
        at, there, states, u, weight, pooled, kept = saved
        g = {"out": delta @ pooled, "out_b": delta.sum(keepdims=True)}
        d_pooled = delta[:, None] * self.p["out"]
        d_states = weight[:, :, None] * d_pooled[:, None, :]
        d_weight = np.einsum("bs,bts->bt", d_pooled, states)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        d_u = d_e[:, :, None] * self.p["att_v"] * (1 - u * u)
        g["att_v"] = np.einsum("bt,bts->s", d_e, u)
        g["att"] = np.einsum("bti,bto->io", states, d_u)
        g["att_b"] = d_u.sum(axis=(0, 1))
        d_states = d_states + d_u @ self.p["att"].T
        dx = np.zeros_like(x)
        steps = at.shape[1]
        for d, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            part = slice(0, STATES) if d == "f" else slice(STATES, 2 * STATES)
            w = self.p[f"{d}_state"]
            g[f"{d}_state"] = np.zeros_like(w)
            d_in = np.zeros((len(x), 3 * STATES), np.float32)
            dh = np.zeros((len(at), STATES), np.float32)
            for t in order:
                h, z, r, n, hn = kept[d, t]
                dh = dh + d_states[:, t, part]
                now = dh * there[:, t, None]
                dn = now * (1 - z) * (1 - n * n)
                dz = now * (h - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                d_gate = np.concatenate((dz, dr, dn * r), axis=1)
                g[f"{d}_state"] += h.T @ d_gate
                np.add.at(d_in, at[:, t], np.concatenate((dz, dr, dn), axis=1))
                dh = dh - now * (1 - z) + d_gate @ w.T
            g[f"{d}_in"], g[f"{d}_bias"] = x.T @ d_in, d_in.sum(axis=0)
            dx += d_in @ self.p[f"{d}_in"].T
        return g, dx

    def scores(self, s: texts.Slice) -> np.ndarray:
        """Greatest window probability of each row; 0 without words."""
        words, counts, cells, first, n = tokens(s)
        out = np.zeros(s.rows)
        if not len(words):
            return out
        _, x = self.inputs(words, cells, first, n)
        row, start, length = windows(counts)
        for at in range(0, len(row), 8192):
            part = slice(at, at + 8192)
            np.maximum.at(out, row[part], _sigmoid(self.forward(x, start[part], length[part]).astype(np.float64)))
        return out


class Constant:
    """Stands in where there is nothing to tell apart."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, s: texts.Slice) -> np.ndarray:
        return np.full(s.rows, self.share)


def fit(sample: list[tuple[str, int]], seed: int = 7):
    """Network of (text, label) pairs."""
    labels = np.array([y for _, y in sample], np.int64)
    if not len(labels) or labels.min() == labels.max():
        return Constant(float(labels.mean()) if len(labels) else 0.0)
    # Slice by slice, so that only the compact arrays are as large as the sample.
    parts = [(w, c, x.astype(np.uint16), k.astype(np.int32)) for w, c, x, _, k in (tokens(s) for s in texts.slices(pa.array([t for t, _ in sample]), 1 << 19))]
    words, counts, cells, n = (np.concatenate(x) for x in zip(*parts))
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(labels)), counts)
    seen, of = texts.distinct(words, row)
    vocabulary, inverse = np.unique(seen, return_inverse=True)
    hits = [np.bincount(inverse[labels[of] == y], minlength=len(vocabulary)) for y in (0, 1)]
    often = hits[0] + hits[1] >= LEAST_TEXTS
    sizes = [(labels == y).sum() for y in (0, 1)]
    odds = np.log((hits[1] + 0.5) / (sizes[1] + 1)) - np.log((hits[0] + 0.5) / (sizes[0] + 1))
    odds = np.maximum(odds, 0) * ((hits[1] > 0) & often)
    net = Network(vocabulary[often], odds[often], seed)

    rng = np.random.default_rng(seed)
    win_row, start, length = windows(counts)
    at = net.places(words)
    sums = np.concatenate(([0], np.cumsum(np.append(net.odds, 0)[at] ** 2)))
    worth = sums[start + length] - sums[start]
    order = np.lexsort((worth, win_row))
    best = order[np.append(win_row[order][1:] != win_row[order][:-1], True)]
    per = np.bincount(win_row, minlength=len(labels))
    clean = np.flatnonzero((labels == 0) & (per > 0))
    chance = (np.cumsum(per) - per)[clean] + (rng.random(len(clean)) * per[clean]).astype(np.int64)
    chosen = np.concatenate((best, chance))
    target = labels[win_row[chosen]].astype(np.float32)

    first_m = {k: np.zeros_like(v) for k, v in net.p.items()}
    second_m = {k: np.zeros_like(v) for k, v in net.p.items()}
    net.p["out_b"][0] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    step = 0
    for _ in range(max(EPOCHS, STEPS * BATCH // len(chosen))):
        shuffled = rng.permutation(len(chosen))
        for b in range(0, len(chosen), BATCH):
            pick = shuffled[b:b + BATCH]
            # Words of the batch alone, renumbered.
            w_start, w_len = start[chosen[pick]], length[chosen[pick]]
            local = np.repeat(w_start - (np.cumsum(w_len) - w_len), w_len) + np.arange(int(w_len.sum()))
            c_n = n[local]
            c_first = np.cumsum(c_n) - c_n
            c_at = cells[np.repeat(first[local] - c_first, c_n) + np.arange(int(c_n.sum()))]
            where, x = net.inputs(words[local], c_at, c_first, c_n)
            logit, saved = net.forward(x, np.cumsum(w_len) - w_len, w_len, True)
            delta = ((_sigmoid(logit) - target[pick]) / len(pick)).astype(np.float32)
            g, dx = net.backward(x, delta, saved)
            g["word"] = np.zeros_like(net.p["word"])
            np.add.at(g["word"], where, dx[:, :WORD_SIZE])
            g["word"][-1] = 0
            g["char"] = np.zeros_like(net.p["char"])
            np.add.at(g["char"], c_at, np.repeat(dx[:, WORD_SIZE + 1:] / c_n[:, None], c_n, axis=0))
            step += 1
            for k, v in g.items():
                first_m[k] = 0.9 * first_m[k] + 0.1 * v
                second_m[k] = 0.999 * second_m[k] + 0.001 * v * v
                net.p[k] = (net.p[k] - RATE * (first_m[k] / (1 - 0.9 ** step)) / (np.sqrt(second_m[k] / (1 - 0.999 ** step)) + 1e-6)).astype(np.float32)
    net.p["word"][-1] = 0
    return net


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most PER_CLASS texts of either class, none of them held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picks = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS) for y in (0, 1)]
    chosen = picks[0].union(picks[1]).select(F.col("doc_id").alias("_id"), "toxic")
    short = docs.where(F.octet_length(text_col) <= FIT_BYTES).select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    rows = short.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).dropDuplicates(["_id"]).orderBy("_id").select("text", "toxic").collect()
    return [(r["text"], int(r["toxic"])) for r in rows]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, id_col, text_col)))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in texts.slices(batch.column(1), 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.array(model.value.scores(s))], ["doc_id", "score"])

    kind = frame.schema["doc_id"].dataType.simpleString()
    scored = frame.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
