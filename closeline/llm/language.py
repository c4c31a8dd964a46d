"""Language ID by a linear-chain conditional random field over words, in numpy.

The states are the languages of the training rows. A word's features are hashed prefixes
and suffixes of one to three bytes, its byte bigrams and trigrams, the word itself, and
whether a lexicon (words that the training texts of one language have mostly to
themselves) names it for a language; transitions between neighbouring words are learned.
Training runs are pieces of texts of different languages in turn, as in code-switched
text, each word labelled with its text's language; gradients come from forward-backward.
A text is labelled in chains of ``CHAIN`` words, word by word, by forward-backward; its
language has the greatest sum of marginals over words with letters, and the score is its
share of that sum.

At most ``PER_LANGUAGE`` different texts of a language are learned from, chosen by a hash
of the text; of a text over ``FIT_BYTES`` bytes one piece, chosen by its hash, stands for
it. Copies count once. These are documented bounds of the sample alone. Scoring covers
every text whole, by slices of a few MB.

A null text, an empty one, or one without letters is ``und`` with score 0; so is every
text if no language could be learned. Repeated rows and ties score alike, a tie between
languages going to the first by name. An empty table gives no rows. Further columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from closeline.llm import texts

PER_LANGUAGE = 150
FIT_BYTES = 8_000
SLICE_BYTES = 1 << 18  # of texts judged together
CELLS = 1 << 16
LEXICON_CELLS = 1 << 17
LEXICON_SHARE, LEXICON_LEAST = 0.9, 3
CHAIN = 128
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.2, 1e-4
UNKNOWN = "und"
_LETTER = np.isin(np.arange(256), list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Words:
    """Words of a slice with their features: affix cells (word by six) and n-gram cells (ragged)."""

    def __init__(self, s: texts.Slice):
        data = texts.FOLD[s.data]
        starts, ends = texts.spans(s, texts.IS_SPACE)
        self.counts = s.per_row(starts)
        self.hashes = texts.hashes(data, starts, ends)
        self.lettered = np.concatenate(([0], np.cumsum(_LETTER[s.data])))
        self.lettered = self.lettered[ends] > self.lettered[starts]
        wide = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint64)
        n = ends - starts
        affixes = []
        for size in (1, 2, 3):
            front, back = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
            for j in range(size):
                front = front << np.uint64(8) | np.where(n > j, wide[np.minimum(starts + j, len(wide) - 1)], np.uint64(0))
                back = back << np.uint64(8) | np.where(n > j, wide[np.maximum(ends - 1 - j, 0)], np.uint64(0))
            affixes += [self._cell(front, size), self._cell(back, size + 3)]
        self.affixes = np.stack(affixes, axis=1) if affixes else np.zeros((0, 6), np.int64)
        self.n = n
        self.first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(starts - self.first, n)
        left = np.repeat(ends, n) - at
        two = np.where(left > 1, wide[at] << np.uint64(8) | wide[at + 1], np.uint64(0))
        three = np.where(left > 2, two << np.uint64(8) | wide[at + 2], np.uint64(0))
        self.grams = np.stack((self._cell(two, 7), self._cell(three, 8)), axis=1)

    @staticmethod
    def _cell(value: np.ndarray, kind: int) -> np.ndarray:
        return (texts.mix(value | np.uint64(kind) << np.uint64(32)) & np.uint64(CELLS - 1)).astype(np.int64)


class Field:
    """Weights of features and transitions, with the lexicon."""

    def __init__(self, languages: list[str]):
        k = len(languages)
        self.languages = languages
        self.cells = np.zeros((CELLS, k), np.float32)
        self.words = np.zeros((k + 1, k), np.float32)  # by what the lexicon says, its last row: nothing
        self.transitions = np.zeros((k, k), np.float32)
        self.lexicon = np.full(LEXICON_CELLS, k, np.int8)
        self.check = np.zeros(LEXICON_CELLS, np.uint32)

    def learn_lexicon(self, words: np.ndarray, language: np.ndarray) -> None:
        kinds, at = np.unique(words, return_inverse=True)
        k = len(self.languages)
        table = np.bincount(at * k + language, minlength=len(kinds) * k).reshape(-1, k)
        total, most = table.sum(axis=1), table.max(axis=1)
        sure = (total >= LEXICON_LEAST) & (most >= LEXICON_SHARE * total)
        order = np.argsort(total[sure], kind="stable")  # the more frequent word keeps a shared cell
        chosen, says = kinds[sure][order], table[sure].argmax(axis=1)[order]
        cell = (chosen & np.uint64(LEXICON_CELLS - 1)).astype(np.int64)
        self.lexicon[cell] = says
        self.check[cell] = (chosen >> np.uint64(32)).astype(np.uint32)

    def named(self, words: np.ndarray) -> np.ndarray:
        cell = (words & np.uint64(LEXICON_CELLS - 1)).astype(np.int64)
        right = self.check[cell] == (words >> np.uint64(32)).astype(np.uint32)
        return np.where(right, self.lexicon[cell], len(self.languages))

    def emissions(self, w: Words) -> np.ndarray:
        if not len(w.n):
            return np.zeros((0, len(self.languages)), np.float32)
        out = self.words[self.named(w.hashes)].copy()
        for j in range(w.affixes.shape[1]):
            out += self.cells[w.affixes[:, j]]
        grams = self.cells[w.grams[:, 0]] + self.cells[w.grams[:, 1]]
        return out + np.add.reduceat(grams, w.first, axis=0) / w.n[:, None]

    def marginals(self, emissions: np.ndarray, start: np.ndarray, length: np.ndarray, pairs: bool = False):
        """Posterior of every word of the chains; with ``pairs`` also the summed posterior of neighbours."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        steps = int(length[0]) if len(length) else 0
        jump = np.exp(self.transitions.astype(np.float64))
        here = [int(np.searchsorted(-length, -t, "left")) for t in range(steps)]
        value = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64)
        ahead = []
        a = None
        for t in range(steps):
            v = value[start[:here[t]] + t]
            a = v if a is None else (a[:here[t]] @ jump) * v
            a = a / a.sum(axis=1, keepdims=True)
            ahead.append(a)
        out = np.zeros_like(value)
        total = np.zeros_like(jump)
        b = np.ones((0, value.shape[1]))
        for t in range(steps - 1, -1, -1):
            if len(b) < here[t]:
                b = np.concatenate((b, np.ones((here[t] - len(b), value.shape[1]))))
            m = ahead[t] * b
            out[start[:here[t]] + t] = m / m.sum(axis=1, keepdims=True)
            if t:
                vb = value[start[:here[t]] + t] * b
                if pairs:
                    joint = ahead[t - 1][:here[t], :, None] * jump * vb[:, None, :]
                    total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                b = vb @ jump.T
                b = b / b.sum(axis=1, keepdims=True)
        return (out, total) if pairs else out

    def judge(self, s: texts.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Place of each row's language (-1: none) and its share."""
        w = Words(s)
        k = len(self.languages)
        post = self.marginals(self.emissions(w), *chains(w.counts))
        row = np.repeat(np.arange(s.rows), w.counts)[w.lettered]
        sums = np.stack([np.bincount(row, post[w.lettered, j], s.rows) for j in range(k)], axis=1)
        best, total = sums.argmax(axis=1), sums.sum(axis=1)
        ascii_letter = _LETTER & (np.arange(256) < 128)
        plain = np.diff(np.concatenate(([0], np.cumsum(ascii_letter[s.data])))[s.edges]) > 0
        for i in np.flatnonzero((total > 0) & ~plain).tolist():  # other scripts, or marks only
            if not any(c.isalpha() for c in s.data[s.edges[i]:s.edges[i + 1]].tobytes().decode()):
                total[i] = 0
        return np.where(total > 0, best, -1), np.where(total > 0, sums[np.arange(s.rows), best] / np.maximum(total, 1e-12), 0.0)


def chains(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of every chain of rows of so many words."""
    per = -(-counts // CHAIN)
    row = np.repeat(np.arange(len(counts)), per)
    place = (np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)) * CHAIN
    return (np.cumsum(counts) - counts)[row] + place, np.minimum(CHAIN, counts[row] - place)


def fit(sample: list[tuple[str, str]], seed: int = 5) -> Field | None:
    """Field of (text, language) pairs; None without any word."""
    languages = sorted({lang for _, lang in sample})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    label = np.array([languages.index(lang) for _, lang in sample])
    # Pieces of 5 to 40 words, all texts mixed, are the training run.
    pieces, of = [], []
    for (text, _), y in zip(sample, label.tolist()):
        words = (text or "").encode().split()
        at = 0
        while at < len(words):
            n = int(rng.integers(5, 41))
            pieces.append(b" ".join(words[at:at + n]))
            of.append(y)
            at += n
    if not pieces:
        return None
    order = rng.permutation(len(pieces))
    s = next(texts.slices(pa.array([pieces[i] for i in order], pa.binary()), 1 << 40))
    w = Words(s)
    y = np.repeat(np.array(of)[order], w.counts)
    field = Field(languages)
    field.learn_lexicon(w.hashes, y)
    k = len(languages)
    says = field.named(w.hashes)
    start, length = chains(np.array([len(y)]))
    squares = [np.full_like(x, 1e-6) for x in (field.cells, field.words, field.transitions)]
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(start))
        for b in range(0, len(start), BATCH):
            pick = np.sort(shuffled[b:b + BATCH])
            n = length[pick]
            at = np.repeat(start[pick] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            part = _Part(w, at)
            post, pairs = field.marginals(field.emissions(part), np.cumsum(n) - n, n, True)
            post[np.arange(len(at)), y[at]] -= 1
            post = post / len(at)
            inner = np.ones(len(at), bool)
            inner[(np.cumsum(n) - n)] = False
            seen = np.bincount(y[at - 1][inner] * k + y[at][inner], minlength=k * k).reshape(k, k)
            g_cells = np.zeros_like(field.cells)
            spread = np.repeat(post / part.n[:, None], part.n, axis=0)
            index = np.concatenate((part.affixes.T.ravel(), part.grams.T.ravel()))
            for j in range(k):
                g_cells[:, j] = np.bincount(index, np.concatenate((np.tile(post[:, j], 6), np.tile(spread[:, j], 2))), CELLS)
            g_words = np.stack([np.bincount(says[at], post[:, j], k + 1) for j in range(k)], axis=1)
            for x, g, q in zip((field.cells, field.words, field.transitions), (g_cells, g_words, (pairs - seen) / len(at)), squares):
                g = g + DECAY * x / len(start)
                q += g * g
                x -= (RATE * g / np.sqrt(q)).astype(np.float32)
    return field


class _Part:
    """Some of the words, renumbered."""

    def __init__(self, w: Words, at: np.ndarray):
        self.hashes, self.affixes, self.n = w.hashes[at], w.affixes[at], w.n[at]
        self.first = np.cumsum(self.n) - self.n
        self.grams = w.grams[np.repeat(w.first[at] - self.first, self.n) + np.arange(int(self.n.sum()))]


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most PER_LANGUAGE different texts of each language, none of them held out; of a long one a piece."""
    space = "\\\\x20\\\\x09-\\\\x0D"
    pieces = f"regexp_extract_all(text, '[^{space}](?s:.{{0,{FIT_BYTES // 4 - 101}}})[^{space}]{{0,100}}', 0)"
    piece = f"if(octet_length(text) <= {FIT_BYTES}, text, array_min(transform({pieces}, x -> struct(xxhash64(x) as h, x))).x)"
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.select(F.expr(piece).alias("text"), "lang").where("text is not null").withColumn("h", F.xxhash64("text"))
    # Hashes are told apart first, so that copies take one place and only the chosen texts are shuffled.
    at = "row_number() over (partition by lang order by {})"
    keys = rows.select("lang", "h").distinct().withColumn("at", F.expr(at.format("h"))).where(F.col("at") <= PER_LANGUAGE).select("lang", "h")
    chosen = rows.join(F.broadcast(keys), ["lang", "h"]).select("lang", "h", "text").distinct()
    chosen = chosen.withColumn("at", F.expr(at.format("h, text"))).where(F.col("at") <= PER_LANGUAGE)
    return [(r["text"], r["lang"]) for r in chosen.orderBy("lang", "at").collect()]


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text."""
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, id_col, text_col)))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in texts.slices(batch.column(1), SLICE_BYTES):
                if model.value is None:
                    names, share = [UNKNOWN] * s.rows, np.zeros(s.rows)
                else:
                    best, share = model.value.judge(s)
                    names = np.array([*model.value.languages, UNKNOWN], object)[best]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.array(names, pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    kind = frame.schema["doc_id"].dataType.simpleString()
    found = texts.mapped(frame, run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a known language, whatever its share; columns stay. Nothing but the sample is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, id_col, text_col)))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in texts.slices(batch.column(batch.schema.get_field_index(text_col)), SLICE_BYTES):
                if model.value is not None:
                    best, _ = model.value.judge(s)
                    yield batch.slice(s.first, s.rows).filter(pa.array(best >= 0))

    return texts.mapped(docs, run, docs.schema)
