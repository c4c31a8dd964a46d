"""Spelling variants of words by variable-length grams.

A word is a run of Latin letters (A-Z, a-z and U+00C0 to U+00FF; A-Z are folded) with at
least ``LENGTH`` code points that occurs at least ``OCCURS`` times. A sample of spelling
errors is part of its definition: where ERRORS divides the crc32 of "id:run", the run
loses one code point. Two words are near if one inserted, deleted or replaced code point
makes one the other. A word's form is its near word of the largest count, if that is at
least twice its own; roots follow forms to the last.

Grams. Words get a mark at both ends. A gram starts at every place and has two symbols,
and more, up to five, while what it has so far is a frequent gram: one at over ``FREQUENT``
places. The gram dictionary is what the frequency cut leaves: the frequent grams of two to
four symbols, as bit maps bounded by the alphabet (92 symbols: 9 MB). A gram depends on
its own symbols only, so one edit affects just the grams that it falls into; the most that
it can affect, counted over all places of the word, is the word's bound. Near words share
all their other grams, at equal places before the edit and shifted by the difference of
lengths behind it. So the rarest shared gram is among the bound plus one rarest grams of
both words: only these go into the lists, keyed by gram, place and length. A shorter word
takes part in the lists of words one longer, at both places.

Lists are merged in tasks, hot ones in tiles, and each pair there is verified by its
common start and end: these leave no more than one symbol. Only near pairs are written.
The order of rarity is by counters of gram hashes, of fixed number; where two grams share a
counter the order is still one and the same for all words.

A null text has no words; a null id counts as an empty one in the sample of errors. Rows
with equal ids and texts count like any others. Very long texts and words are processed
whole. Of near words with the same count the least in code-point order is the form. An
empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from closeline.llm import texts, tiles
from closeline.session import cut_lineage

LENGTH = 5
OCCURS = 3
ERRORS = 97
LEAST_GRAM, LONGEST = 2, 5
FREQUENT = 128
COUNTERS = 1 << 18
PIECE = 2048  # rows of a list compared within one tile
BUFFER = 1 << 16
PAIRS = 1 << 18  # pairs verified together
WIDE = 32  # longer words are verified one by one
SLICE = 4 << 20
ROUNDS = 64

_LEAD = 0xC3  # first UTF-8 byte of U+00C0 to U+00FF
_ALPHABET = 92
_START, _END = 90, 91
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(26)
_SYMBOL[192:256] = np.arange(26, 90)
_GAP = np.ones(256, bool)
_GAP[[*range(65, 91), *range(97, 123), _LEAD]] = False


def runs(s: texts.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes; start and end of each run of letters."""
    data = texts.FOLD[s.data]
    marks = data.copy()
    marks[1:][data[:-1] == _LEAD] = _LEAD
    return data, *texts.spans(texts.Slice(s.first, s.last, marks, s.edges), _GAP)


def _erred(word: bytes, h: int) -> bytes:
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words and how often they occur."""
    frame = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = [zlib.crc32(i.encode() + b":") for i in batch.column(0).to_pylist()]
            for s in texts.slices(batch.column(1), SLICE):
                data, starts, ends = runs(s)
                leads = np.concatenate(([0], np.cumsum(data == _LEAD)))
                long = ends - starts - leads[ends] + leads[starts] >= LENGTH
                starts, ends = starts[long], ends[long]
                if not len(starts):
                    continue
                key, row = texts.hashes(data, starts, ends), s.row_of(starts)
                order = np.lexsort((key, row))
                first = np.flatnonzero(np.concatenate(([True], (np.diff(row[order]) != 0) | (key[order][1:] != key[order][:-1]))))
                n = np.diff(np.append(first, len(order)))
                at = order[first]
                raw = data.tobytes()
                begin, end = starts[at].tolist(), ends[at].tolist()
                of = [prefix[s.first + r] for r in row[at].tolist()]
                h = np.fromiter((zlib.crc32(raw[a:z], p) for a, z, p in zip(begin, end, of)), np.int64, len(at))
                wrong = h % ERRORS == 0
                words = [_erred(raw[begin[i]:end[i]], int(h[i])) for i in np.flatnonzero(wrong).tolist()]
                times = n[wrong].tolist()
                _, where, group = np.unique(key[at[~wrong]], return_index=True, return_inverse=True)
                right = np.flatnonzero(~wrong)[where].tolist()
                words += [raw[begin[i]:end[i]] for i in right]
                times += np.bincount(group, n[~wrong]).astype(np.int64).tolist() if len(right) else []
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["word", "n"])

    found = frame.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= OCCURS) & (F.length("word") >= LENGTH))


def latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as one byte a code point, and their edges."""
    s = next(texts.slices(column, 1 << 40))
    lead = s.data == _LEAD
    after = np.concatenate(([False], lead[:-1]))
    data = np.where(after, s.data + 0x40, s.data).astype(np.uint8)[~lead]
    return data, s.edges - np.concatenate(([0], np.cumsum(lead)))[s.edges]


@dataclass
class Grams:
    """A gram for each place of each word but the end mark: code, place, size; places per word."""

    code: np.ndarray
    place: np.ndarray
    size: np.ndarray
    word: np.ndarray
    edges: np.ndarray
    length: np.ndarray


def _marked(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with marks at both ends; then for each place but end marks: symbol index, symbols from there on, word."""
    length = np.diff(edges)
    word = np.repeat(np.arange(len(length)), length)
    out = np.empty(len(data) + 2 * len(length), np.int64)
    first = edges[:-1] + 2 * np.arange(len(length))
    out[first] = _START
    out[first + length + 1] = _END
    out[np.arange(len(data)) + 2 * word + 1] = _SYMBOL[data]
    owner = np.repeat(np.arange(len(length)), length + 1)
    at = np.arange(len(owner)) + owner
    return np.concatenate((out, np.zeros(LONGEST, np.int64))), at, (first + length + 2)[owner] - at, owner


def _codes(symbols: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    code = np.zeros(len(at), np.int64)
    for j in range(size):
        code = code * _ALPHABET + symbols[at + j]
    return code


def decomposed(data: np.ndarray, edges: np.ndarray, frequent: dict[int, np.ndarray]) -> Grams:
    """The grams of words; ``frequent`` has a bit map for each size below the longest."""
    symbols, at, left, owner = _marked(data, edges)
    size = np.full(len(at), LEAST_GRAM)
    for q in range(LEAST_GRAM, LONGEST):
        more = np.flatnonzero((size == q) & (left > q))
        code = _codes(symbols, at[more], q)
        bits = frequent[q]
        size[more[bits[code >> 6] >> (code & 63).astype(np.uint64) & np.uint64(1) > 0]] = q + 1
    code = np.zeros(len(at), np.int64)
    for q in range(LEAST_GRAM, LONGEST + 1):
        of = np.flatnonzero(size == q)
        code[of] = _codes(symbols, at[of], q) * (LONGEST + 1) + q
    length = np.diff(edges)
    starts = np.concatenate(([0], np.cumsum(length + 1)))
    return Grams(code, np.arange(len(at)) - starts[owner], size, owner, starts, length)


def bounds(g: Grams) -> np.ndarray:
    """The most grams of each word that one edit can fall into."""
    first = g.edges[:-1] + np.arange(len(g.length))  # a slot more than grams per word
    slot = first[g.word] + g.place
    n = len(g.code) + len(g.length) + 1

    def covered(shift: int, end: np.ndarray) -> np.ndarray:
        change = np.bincount(slot + shift, minlength=n + 1) - np.bincount(end, minlength=n + 1)
        return np.cumsum(change)[:n]

    symbol = covered(0, slot + g.size)  # replaced or deleted at a symbol
    between = covered(1, slot + g.size)  # inserted before a symbol
    both = np.maximum(symbol, between)
    both[first] = 0  # the start mark itself is never edited
    ends = first + g.length + 1
    both[ends] = between[ends]  # nor the end mark; before it symbols can be inserted
    return np.maximum.reduceat(both, first) if len(first) else np.zeros(0, np.int64)


def _counter(code: np.ndarray) -> np.ndarray:
    return (texts.mix(code.view(np.uint64)) % np.uint64(COUNTERS)).astype(np.int64)


def _map(rows: DataFrame) -> dict[int, np.ndarray]:
    """Bit maps of the codes in (q, code), joined in the cluster; their size is the alphabet's."""
    out = {q: np.zeros(_ALPHABET ** q // 64 + 1, np.uint64) for q in range(LEAST_GRAM, LONGEST)}
    bits = rows.groupBy("q", F.expr("code div 64 as at")).agg(F.expr("bit_or(shiftleft(1L, cast(code % 64 as int))) as bits")).toPandas()
    for q, part in bits.groupby("q"):
        out[q][part["at"].to_numpy(int)] = part["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def dictionary(words: DataFrame, frequent: int = FREQUENT) -> dict[int, np.ndarray]:
    """The frequent grams of each size below the longest, as bit maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                symbols, at, left, _ = _marked(*latin(batch.column(0)))
                for q in range(LEAST_GRAM, LONGEST):
                    code, n = np.unique(_codes(symbols, at[left >= q], q), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), q, np.int32)), pa.array(code), pa.array(n)], ["q", "code", "n"])

    grams = words.select("word").mapInArrow(run, "q int, code long, n long").groupBy("q", "code").agg(F.sum("n").alias("n"))
    return _map(grams.where(F.col("n") > frequent).select("q", "code"))


def _rarity(words: DataFrame, grams) -> np.ndarray:
    """How many places have a gram of each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            if batch.num_rows:
                n += np.bincount(_counter(decomposed(*latin(batch.column(0)), grams.value).code), minlength=COUNTERS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    sums = words.select("word").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # COUNTERS rows at most
    out = np.zeros(COUNTERS, np.int64)
    out[sums["at"].to_numpy(int)] = sums["n"].to_numpy(np.int64)
    return out


def listed(g: Grams, rarity: np.ndarray) -> np.ndarray:
    """Places of the grams that go into lists: the bound plus one rarest of each word."""
    order = np.lexsort((g.place, g.code, rarity[_counter(g.code)], g.word))
    rank = np.arange(len(order)) - g.edges[g.word[order]]
    return order[rank <= bounds(g)[g.word[order]]]


def _keys(code: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    return texts.mix(texts.mix(code.view(np.uint64)) ^ (place.astype(np.uint64) << np.uint64(32) | length.astype(np.uint64))).view(np.int64)


def entries(g: Grams, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, word, whether the word is the shorter one there, and gram of each list entry."""
    code, place, word, length = g.code[at], g.place[at], g.word[at], g.length[g.word[at]]
    ends = place + g.size[at] == length + 2  # has the end mark: moves with the end
    starts = place == 0
    own, fix, moved = np.ones(len(at), bool), ~ends, ~starts
    key = [_keys(code, place, length), _keys(code[fix], place[fix], length[fix] + 1), _keys(code[moved], place[moved] + 1, length[moved] + 1)]
    short = [np.full(int(m.sum()), s) for m, s in ((own, False), (fix, True), (moved, True))]
    return np.concatenate(key), np.concatenate([word, word[fix], word[moved]]), np.concatenate(short), np.concatenate([code, code[fix], code[moved]])


def _matrix(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows from the left, and reversed; cut at WIDE."""
    length = np.diff(edges)
    width = int(min(length.max(initial=1) + 1, WIDE + 1))
    place = np.arange(width)
    inside = place < length[:, None]
    padded = np.append(data, np.uint8(0))
    ahead = np.where(inside, padded[np.minimum(edges[:-1, None] + place, len(data))], 0)
    back = np.where(inside, padded[np.maximum(edges[1:, None] - 1 - place, 0)], 0)
    return ahead.astype(np.uint8), back.astype(np.uint8)


def one_apart(x: bytes, y: bytes) -> bool:
    """Whether one inserted, deleted or replaced symbol makes one the other."""
    if len(x) > len(y):
        x, y = y, x
    if x == y or len(y) - len(x) > 1:
        return False
    i = next((i for i in range(len(x)) if x[i] != y[i]), len(x))
    return x[i:] == y[i + 1:] or (len(x) == len(y) and x[i + 1:] == y[i + 1:])


def near(data: np.ndarray, edges: np.ndarray, a: np.ndarray, b: np.ndarray, sides: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which pairs (a, b) of different words are one edit apart: what start and end have in common leaves one symbol at most."""
    length = np.diff(edges)
    short, long = np.minimum(length[a], length[b]), np.maximum(length[a], length[b])
    out = (long - short <= 1) & (long <= WIDE)
    common = sum((side[a] != side[b]).argmax(axis=1) for side in sides)
    out &= common >= long - 1
    for i in np.flatnonzero((long - short <= 1) & (long > WIDE)).tolist():
        out[i] = one_apart(*(data[edges[w[i]]:edges[w[i] + 1]].tobytes() for w in (a, b)))
    return out


def near_pairs(words: DataFrame, frequent: int = FREQUENT, piece: int = PIECE) -> DataFrame:
    """(a, na, b, nb): each pair of near words once, in either order, with their counts."""
    context = words.sparkSession.sparkContext
    grams = context.broadcast(dictionary(words, frequent))
    rarity = context.broadcast(_rarity(words, grams))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                g = decomposed(*latin(batch.column(0)), grams.value)
                key, word, short, code = entries(g, listed(g, rarity.value))
                suspect = 3 * rarity.value[_counter(code)] > piece
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(word)), batch.column(1).take(pa.array(word)), pa.array(short), pa.array(suspect)], ["key", "member", "n", "short", "suspect"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tiles.buffers(batches, BUFFER):
            begin, end, whole = tiles.partners(rows)
            short = rows.column("short").to_numpy()
            word, n = (rows.column(c).combine_chunks() for c in ("member", "n"))
            data, edges = latin(word)
            sides = _matrix(data, edges)
            per = np.where(whole & short, 0, np.maximum(end - begin, 0))  # shorter words come last in a whole tile
            ahead = np.concatenate(([0], np.cumsum(per)))
            for at in range(0, int(ahead[-1]), PAIRS):
                pair = np.arange(at, min(at + PAIRS, int(ahead[-1])))
                a = np.searchsorted(ahead, pair, "right") - 1
                b = begin[a] + pair - ahead[a]
                differ = ~(short[a] & short[b])
                a, b = a[differ], b[differ]
                hit = near(data, edges, a, b, sides)
                a, b = pa.array(a[hit]), pa.array(b[hit])
                if len(a):
                    yield pa.RecordBatch.from_arrays([word.take(a), n.take(a), word.take(b), n.take(b)], ["a", "na", "b", "nb"])

    keyed = words.select("word", "n").mapInArrow(spread, "key long, member string, n long, short boolean, suspect boolean")
    tiled = tiles.tiled(keyed.drop("suspect"), piece, keyed.where("suspect").select("key"), ("short",))
    found = tiled.select(*tiles.TILE, "member", "n", "short").mapInArrow(merge, "a string, na long, b string, nb long").where("a <> b")
    swap = F.col("a") > F.col("b")
    pairs = found.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("na", "nb"), ("b", "a"), ("nb", "na"))])
    return pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each word with a form: pointers double until none moves."""
    roots = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(ROUNDS):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        roots = moved.select("word", "root")
    raise RuntimeError(f"roots not found in {ROUNDS} rounds")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, piece: int = PIECE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word."""
    words = cut_lineage(counted(docs, id_col, text_col))
    pairs = cut_lineage(near_pairs(words, frequent, piece))
    both = pairs.select(F.col("a").alias("word"), "na", F.col("b").alias("other"), F.col("nb").alias("n")).union(pairs.select("b", "nb", "a", "na"))
    # A count per word fits in a pair (-n, other), whose least is the form.
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("best"))
    known = cut_lineage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.n") >= 2 * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.n")).alias("n"))).alias("f")))
    known = known.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.n").alias("form_n"))
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
