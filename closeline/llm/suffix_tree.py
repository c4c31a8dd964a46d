"""LM scoring by probabilistic suffix trees over words and, for single words, over bytes.

A text is its words, A-Z folded, each followed by a space, and an end. The tree predicts
byte after byte from the longest retained context. Contexts are the last 0 to ``DEPTH``
bytes, across words. A context is retained if its divergence test holds: its share of all
training bytes, times the divergence of what follows it from what follows the context
one byte shorter, is at least ``GAIN`` nats; with a context its shorter ones stay. At each
depth the shares times divergences sum to at most the entropy of a byte, so there are at
most log(256) / GAIN retained contexts per depth, whatever the corpus: the tree may be
collected and broadcast. The counts it is drawn from are of all training texts.

Next-byte distributions are interpolated with those of the shorter context, weighted by
the number of different bytes seen after the context. Scoring walks all texts in step,
in pieces that start ``DEPTH`` bytes early, through the automaton of the retained contexts.

Above the bytes stands a tree of words: the states are the last one to ``BACK`` words of a
text, its root the unigram. A state is retained if it stands ``LEAST`` times at least and
if predicting its own training words, each left out in turn, gains ``EVIDENCE`` nats over
the state one word shorter. Both bounds are absolute, so states only come in as the corpus
grows. Depth follows depth: what a state is followed by is its longer states' counts, so
only states that stand often enough are ever looked at, up to ``BACK`` words. A retained state gives a word its count there less ``DISCOUNT``, as a share of the
state's count, plus the discounted mass times what the shorter state gives; a state not
retained gives what the shorter one does. As in the
unigram base, all unknown words are one symbol; the root gives it the share of training
tokens that stand once (Good-Turing); of the rest, a known word gets its count less ``DISCOUNT``, as a share of all tokens, plus the discounted
mass times the byte tree's probability of it where it stands.

Counts of words, of what follows states, and of ends of training texts are exact, for the
model and for the unigram base. Words with at least the share ``FREQUENT`` of the tokens, at
most 1 / FREQUENT, are broadcast; the others meet their counts in a join by 64-bit hashes.
Every token goes, with the words before it, to the block of the last of these: there all
states that end in that word are counted, judged and used for the scores, so that neither
counts of states nor what they give are sent anywhere; only sums of each text are.

A null text is an empty one: a lone end. Repeated rows are scored alike, each counted in
training as often as it stands there. A null id is never held out. An empty table gives
no rows. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from closeline.llm import candidates, texts
from closeline.session import cut_lineage, stored

DEPTH = 5
GAIN = 1e-5
DISCOUNT = 0.4
BACK = 3
FREQUENT = 4e-7
LEAST, EVIDENCE = 4, 3.0
PIECE = 512
SPACE, END, START = 32, 10, 9  # the last two never stand in a word
_NEVER = (9, 11, 12, 13)
MERGE = 1 << 21
TOGETHER, BLOCK = 1 << 20, 1 << 21  # tokens that a task packs together, and of a block on average
ROUND = 1 << 20  # tokens of a block that are judged together, on average
SLICE = 1 << 20


def held_out(id_col: str = "doc_id", parts: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == 0, F.lit(False))


def stream(s: texts.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All rows as one run of bytes, length of each row; per token its first place, its row and hash (ends: 0)."""
    data = np.concatenate((texts.FOLD[s.data], np.zeros(1, np.uint8)))
    starts, ends = texts.spans(s, texts.IS_SPACE)
    rows = np.arange(s.rows)
    none = np.zeros(s.rows, np.int64)
    row = np.concatenate((np.repeat(rows, s.per_row(starts)), rows))
    order = np.argsort(row, kind="stable")
    row = row[order]
    a = np.concatenate((starts, none))[order]
    size = np.concatenate((ends - starts, none))[order] + 1
    keys = np.concatenate((texts.hashes(data[:-1], starts, ends), none.astype(np.uint64)))[order]
    stop = np.cumsum(size)
    at = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(a - (stop - size), size)
    out = data[np.minimum(at, len(data) - 1)]
    out[stop - 1] = np.where(size == 1, END, SPACE)
    return out, np.bincount(row, size, s.rows).astype(np.int64), stop - size, row, keys.view(np.int64)


def packed(run: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """At each byte: itself in the low byte, the DEPTH bytes before it above, START before the row."""
    place = np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = run.astype(np.uint64)
    wide = np.concatenate((np.zeros(DEPTH, np.uint64), run.astype(np.uint64)))
    for j in range(1, DEPTH + 1):
        before = np.where(place >= j, wide[DEPTH - j:len(wide) - j], np.uint64(START))
        out |= before << np.uint64(8 * j)
    return out


class Tally:
    """Counts by key; what has come in is merged whenever it grows."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        self.put(*np.unique(keys, return_counts=True))

    def put(self, found: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(found)
        self.counts.append(n)
        self.size += len(found)
        if self.size > MERGE and len(self.keys) > 8:
            self.keys, self.counts = [[x] for x in self.total()]
            self.size = len(self.keys[0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(counts[order], first)


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers byte by byte in planes, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), "zstd", asbytes=True)


def _loose(data: bytes, n: int, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


_COUNTS = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("size", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])


def counted(training: DataFrame) -> DataFrame:
    """(kind, key, n): kind 0 words by hash, kind 1 packed byte windows, over the one text column."""
    parts = candidates.BLOCKS_PER_PARTITION * int(training.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = Tally(), Tally()
        for batch in batches:
            for s in texts.slices(batch.column(0)):
                symbols, lengths, _, _, keys = stream(s)
                tallies[0].add(keys.view(np.uint64))
                tallies[1].add(packed(symbols, lengths))
        for kind, tally in enumerate(tallies):
            if tally.size:
                keys, n = tally.total()  # windows that start alike stay together: from one to the next are few bytes
                part = ((texts.mix(keys >> np.uint64(24)) if kind else keys) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(edges)).tolist():
                    i = order[edges[p]:edges[p + 1]]
                    yield pa.RecordBatch.from_pylist([{"part": p, "kind": kind, "size": len(i), "keys": _squeeze(np.diff(keys[i], prepend=np.uint64(0))), "n": _squeeze(n[i])}], _COUNTS)

    def merged(part: pa.Table) -> pa.Table:
        out = []
        for kind in (0, 1):
            tally = Tally()
            for rows in part.to_batches(64):
                for m in rows.to_pylist():
                    if m["kind"] == kind:
                        tally.put(np.cumsum(_loose(m["keys"], m["size"], np.uint64), dtype=np.uint64), _loose(m["n"], m["size"], np.int64))
            if tally.size:
                keys, n = tally.total()
                out.append(pa.table([np.full(len(keys), kind, np.int8), keys.view(np.int64), n], names=["kind", "key", "n"]))
        return pa.concat_tables(out)

    sent = texts.mapped(training, run, "part int, kind byte, size int, keys binary, n binary")
    return sent.groupBy("part").applyInArrow(merged, "kind byte, key long, n long")


def retained(windows: DataFrame) -> DataFrame:
    """(depth, context, symbol, n) of the contexts that the divergence test keeps."""
    total = windows.agg(F.sum("n")).first()[0] or 0
    floor = GAIN * total / log(256)  # fewer occurrences can't make up the gain
    masks = ", ".join(f"named_struct('depth', {d}, 'context', shiftright(key, 8) & {(1 << 8 * d) - 1}L)" for d in range(DEPTH + 1))
    rows = windows.select(F.expr(f"inline(array({masks}))"), F.expr("cast(key & 255 as int)").alias("symbol"), "n")
    rows = rows.groupBy("depth", "context", "symbol").agg(F.sum("n").alias("n"))
    sums = rows.groupBy("depth", "context").agg(F.sum("n").alias("c")).where(F.col("c") >= floor)
    rows = cut_lineage(rows.join(sums, ["depth", "context"]))
    parent = rows.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("suffix"), "symbol", F.col("n").alias("pn"), F.col("c").alias("pc"))
    shorter = F.expr("context & (shiftleft(1L, 8 * (depth - 1)) - 1L)")
    gain = (rows.where("depth > 0").withColumn("suffix", shorter).join(parent, ["depth", "suffix", "symbol"])
            .groupBy("depth", "context").agg(F.expr(f"sum(n * ln((n / c) / (pn / pc))) / {max(total, 1)}").alias("gain")).where(F.col("gain") >= GAIN))
    ends = ", ".join(f"if(depth >= {d}, named_struct('depth', {d}, 'context', context & {(1 << 8 * d) - 1}L), null)" for d in range(DEPTH + 1))
    keep = gain.select(F.expr(f"explode(array({ends}))").alias("s")).where("s is not null").select("s.*").distinct()
    root = rows.where("depth = 0")
    return rows.where("depth > 0").join(keep, ["depth", "context"], "left_semi").union(root).select("depth", "context", "symbol", "n")


class Automaton:
    """Transitions and log10 distributions of the longest retained context at each state."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        found: dict[bytes, dict[int, int]] = {b"": {}}
        for depth, context, symbol, n in rows:
            found.setdefault(int(context).to_bytes(depth, "big"), {})[symbol] = n
        states: dict[bytes, int] = {b"": 0}
        for length in range(1, DEPTH + 1):
            for context in found:
                if len(context) >= length:
                    states.setdefault(context[:length], len(states))
        shape = (len(states), 256)
        self.step = np.zeros(shape, np.int32)
        self.log = np.zeros(shape, np.float32)
        p: dict[bytes, np.ndarray] = {}
        for context in sorted(found, key=len):
            n = np.zeros(256)
            n[list(found[context])] = list(found[context].values())
            if context:
                weight = max(1, int((n > 0).sum()))
                p[context] = (n + weight * p[context[1:]]) / (n.sum() + weight)
            else:
                n += 0.5
                n[list(_NEVER)] = 0
                p[context] = n / n.sum()
        for text, i in states.items():  # shorter states come first
            fail = states[b""]
            for j in range(1, len(text) + 1):
                if text[j:] in states:
                    fail = states[text[j:]]
                    break
            with np.errstate(divide="ignore"):
                self.log[i] = np.log10(p[text]) if text in p else self.log[fail]
            if text:
                self.step[i] = self.step[fail]
            for b in range(256):
                child = states.get(text + bytes([b]))
                if child is not None:
                    self.step[i, b] = child
        self.start = 0
        for _ in range(DEPTH):
            self.start = int(self.step[self.start, START])

    def logs(self, run: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each byte of the run."""
        first = np.cumsum(lengths) - lengths
        pieces = -(-lengths // PIECE)
        row = np.repeat(np.arange(len(lengths)), pieces)
        offset = (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        size = np.minimum(PIECE, lengths[row] - offset)
        order = np.argsort(-size, kind="stable")
        row, offset, size = row[order], offset[order], size[order]
        at = first[row] + offset
        state = np.full(len(row), self.start, np.int32)
        inner = offset > 0
        state[inner] = 0
        for j in range(DEPTH, 0, -1):
            state[inner] = self.step[state[inner], run[at[inner] - j]]
        out = np.zeros(len(run))
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, "left"))
            symbol = run[at[:n] + t]
            out[at[:n] + t] = self.log[state[:n], symbol]
            state[:n] = self.step[state[:n], symbol]
        return out


def _kin(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of scrambled numbers: which of the distinct ones each is, and the place of one of each."""
    order = texts.together(x)
    ahead = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ahead[1:] != ahead[:-1]
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return which, order[new]


def _then(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a state with a word after it."""
    return texts.mix(state ^ texts.mix(word + np.uint64(7)))


class Words:
    """Common words and their counts, by key and by rank: the code of a word is its rank."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        order = np.argsort(-n, kind="stable")
        self.keys, self.rank = keys, np.empty(len(keys), np.int64)
        self.rank[order] = np.arange(len(keys))
        self.by_rank = np.concatenate((np.array([0, _START], np.uint64), keys[order].view(np.uint64)))
        self.counts = np.concatenate((np.zeros(2, np.int64), n[order]))  # after the codes NONE and BEFORE

    def codes(self, tokens: np.ndarray) -> np.ndarray:
        """Code of each common word, -1 of others."""
        if not len(self.keys):
            return np.full(len(tokens), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, tokens), len(self.keys) - 1)
        return np.where(self.keys[at] == tokens, self.rank[at] + 2, -1)


_SUMS = pa.schema([("batch", pa.int64()), ("signs", pa.binary()), ("n", pa.int32()), *((x, pa.binary()) for x in ("rows", "score", "base", "known"))])
ALONE = 2  # of a rare word that stands once, where others are not asked for (0) or are (1)
NONE, BEFORE = 0, 1  # codes of no state, and of the place before a text
_START = 0x5DEECE66D1CE4E5B
_FIELDS = {"block": "int", "batch": "long", "size": "int", "signs": "binary", "asked": "binary", "rare": "binary", "codes": "binary", "own": "binary"}
_SENT = pa.schema([(k, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[v]) for k, v in _FIELDS.items()])


def _sent(frame: DataFrame, model, words: DataFrame, below: float, blocks: int) -> DataFrame:
    """Tokens of (sign, text, learnt) with up to ``BACK`` words before them, packed for the block of the last of these.

    All states that end in a word meet what follows them in its block, whatever their depth.
    A word that can't stand ``LEAST`` times is no part of a state. Tokens are ordered by the
    word before and themselves, so that what they share takes little room. A row's tokens are
    known by their batch and its place there; with its first token go its sign and what its common words
    add to the base, to the known ones and to all. A rare word of a text learnt from that isn't
    there twice is there once.
    """
    able, twice = (candidates.Sieve(words.where((F.col("n") >= n) & (F.col("key") != 0)).select(F.col("key").alias("node"))) for n in (LEAST, 2))

    together = TOGETHER

    def pack(batch: int, signs: np.ndarray, learnt: np.ndarray, row: np.ndarray, tokens: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = model.value[1]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        code = words.codes(tokens)
        far = np.flatnonzero(code < 0)
        rare, code[far] = np.unique(tokens[far], return_inverse=True)
        alone = np.zeros(len(rare), bool)
        alone[code[far[learnt[row[far]]]]] = True
        alone &= ~twice.holds(rare)
        code[far] += len(words.by_rank)
        near = np.flatnonzero(code < len(words.by_rank))
        n = words.counts[code[near]]
        whole = np.stack((signs, np.bincount(row[near], np.log10((n + 0.1) / below), len(signs)).astype(float).view(np.int64),
                          np.bincount(row[near], n > 0, len(signs)).astype(np.int64), np.bincount(row, minlength=len(signs))))
        state = code.copy()
        state[far[~able.holds(tokens[far])]] = NONE
        columns = [code.astype(np.uint32)]
        for d in range(1, BACK + 1):
            back = np.concatenate((np.zeros(d, np.int64), state))[:len(row)].astype(np.uint32)
            back[place < d] = BEFORE if d == 1 else NONE
            back[place == d - 1] = BEFORE
            columns.append(back)
        columns.append((2 * row + learnt[row]).astype(np.uint32))
        lut = np.concatenate((words.by_rank, rare.view(np.uint64)))
        block = texts.mix(lut[np.where(columns[1] == NONE, columns[0], columns[1])] + np.uint64(3)) % np.uint64(blocks)
        order = np.argsort(block << np.uint64(48) | columns[1].astype(np.uint64) << np.uint64(24) | columns[0])
        block, columns, own = block[order].astype(np.int64), [c[order] for c in columns], own[order]
        edges = np.searchsorted(block, np.arange(blocks + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            i = slice(edges[b], edges[b + 1])
            named = [c[i].copy() for c in columns]
            away = [c >= len(words.by_rank) for c in named[:-1]]
            seen = np.unique(np.concatenate([c[x] for c, x in zip(named, away)]))
            for c, x in zip(named, away):
                c[x] = np.searchsorted(seen, c[x]) + len(words.by_rank)
            asked = np.zeros(len(seen), np.uint8)
            asked[named[0][away[0]] - len(words.by_rank)] = 1
            asked[alone[seen - len(words.by_rank)]] = ALONE
            first = np.sort(named[-1][named[1] == BEFORE] >> 1)
            named[0][1:] -= named[0][:-1].copy()
            yield pa.RecordBatch.from_pylist([{"block": b, "batch": batch, "size": len(named[0]), "signs": whole[:, first].tobytes() if len(first) else b"", "asked": _squeeze(asked),
                                               "rare": rare[seen - len(words.by_rank)].tobytes(), "codes": b"".join(_framed(c) for c in named), "own": _squeeze(own[i])}], _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size, batch_no = [], 0, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            signs, learnt = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for s in texts.slices(batch.column(1), SLICE):
                symbols, lengths, first, row, tokens = stream(s)
                tree = model.value[0]
                own = (10.0 ** np.add.reduceat(tree.logs(symbols, lengths), first)).astype(np.float32) if tree else np.zeros(len(row), np.float32)
                held.append((signs[s.first:s.last], learnt[s.first:s.last], row + rows, tokens, own))
                rows, size = rows + s.rows, size + len(row)
                if size >= together:
                    yield from pack(batch_no, *map(np.concatenate, zip(*held)))
                    held, rows, size, batch_no = [], 0, 0, batch_no + 1
        if held:
            yield from pack(batch_no, *map(np.concatenate, zip(*held)))
            held.clear()
        texts.give_back()

    return texts.mapped(frame, run, ", ".join(f"{k} {v}" for k, v in _FIELDS.items())).repartition(blocks, "block")


def _framed(values: np.ndarray) -> bytes:
    data = _squeeze(values)
    return len(data).to_bytes(4, "little") + data


def _columns(m: dict, *wanted: int) -> list[np.ndarray]:
    """Columns of a message: words, the words before them, then the rows and whether these are learnt from."""
    data, out = memoryview(m["codes"]), []
    for d in range(BACK + 2):
        length = int.from_bytes(data[:4], "little")
        if d in wanted:
            code = _loose(data[4:4 + length], m["size"], np.uint32)
            out.append(code if d else np.cumsum(code, dtype=np.uint32))
        data = data[4 + length:]
    return out


def _met(sent: DataFrame, words: DataFrame, model, n_all: int, schema: str, found: Callable, table: Callable) -> DataFrame:
    """``table`` of what is ``found`` in the rounds of each block: its tokens with the counts of their words, of which the rare ones are fetched by a join.

    What follows single words is counted over the whole block, run by run. Longer states are
    judged in rounds, by the word before the last, so that the block of a word that is
    everywhere takes no more memory than others.
    """

    limit = ROUND

    def ask(block: pa.Table) -> pa.Table:
        held = [np.frombuffer(x, np.int64) for x in block.column("rare").to_pylist()]
        keys = np.unique(np.concatenate([x[_loose(a, len(x), np.uint8) == 1] for x, a in zip(held, block.column("asked").to_pylist())]))
        return pa.table({"block": np.full(len(keys), block.column("block")[0].as_py(), np.int32), "key": keys})

    def meet(block: pa.Table, counts: pa.Table) -> pa.Table:
        common = model.value[1]
        order = np.argsort(counts.column("key").to_numpy(), kind="stable")
        keys, n = counts.column("key").to_numpy()[order], counts.column("n").to_numpy()[order]
        rounds = -(-sum(block.column("size").to_pylist()) // limit)

        def messages() -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
            """Each message with the keys and the counts of its codes."""
            for rows in block.to_batches(1):
                for m in rows.to_pylist():
                    rare = np.frombuffer(m["rare"], np.int64)
                    near = np.minimum(np.searchsorted(keys, rare), max(len(keys) - 1, 0))
                    rare_n = np.where(keys[near] == rare, n[near], 0) if len(keys) else np.zeros(len(rare), np.int64)
                    rare_n[_loose(m["asked"], len(rare), np.uint8) == ALONE] = 1
                    yield m, np.concatenate((common.by_rank, rare.view(np.uint64))), np.concatenate((common.counts, rare_n))

        pairs = Pairs(n_all)
        for m, lut, lut_n in messages():
            word, last, mark = _columns(m, 0, 1, BACK + 1)
            pairs.add(word, last, lut, lut_n, mark & 1)
        pairs.judge()
        results = []
        for r in range(rounds):
            parts, batches, size = [], [], 0
            for m, lut, lut_n in messages():
                *code, mark = _columns(m, *range(BACK + 2))
                i = np.flatnonzero(texts.mix(lut[np.where(code[2] == NONE, code[0], code[2])] + np.uint64(5)) % np.uint64(rounds) == r)
                code = np.stack(code)[:, i]
                a, b, share = pairs.of(code[0], code[1], lut)
                parts.append((lut[code], code != NONE, lut_n[code[0]], mark[i], _loose(m["own"], m["size"], np.float32)[i], code[0] < len(common.by_rank), a, b, share))
                batches.append((m["batch"], slice(size, size + len(i)), b"" if r else m["signs"]))
                size += len(i)
            key, there, count, mark, own, known, a, b, share = (np.concatenate(x, axis=-1) for x in zip(*parts))
            del parts
            found_keys = judged(key, there, (mark & 1).astype(bool), a, b, share)
            results.append(found(key[0], count, mark, own, known, a, b, [] if r else pairs.kept, found_keys, batches))
            del key, there, count, mark, own, known, a, b, share
            texts.give_back()
        return table(results)

    asked = sent.groupBy("block").applyInArrow(ask, "block int, key long")
    counts = asked.join(words.select("key", "n"), "key").select("block", "key", "n")
    return sent.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(meet, schema)


def _verdict(n: np.ndarray, of: np.ndarray, p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether states of c tokens are retained; shares of what follows them (n times, p without the state), and of what is left.

    A token left out of its state in turn is predicted by what is left. One that stands
    there once is left to the shorter state, whatever its share there: only tokens that
    stand twice are judged by what the shorter state gives them.
    """
    k, once, twice = np.bincount(of, n > 0, len(c)), np.bincount(of, n == 1, len(c)), n > 1
    held = np.maximum(c, 2)
    s = of[twice]
    gain = np.bincount(s, n[twice] * np.log(((n[twice] - 1 - DISCOUNT) / p[twice] + DISCOUNT * k[s]) / (held[s] - 1)), len(c)).astype(float)
    gain += once * np.log(DISCOUNT * np.maximum(k, 1) / (held - 1))
    kept = (c >= LEAST) & (gain >= EVIDENCE)
    return kept, np.where(kept[of], np.maximum(n - DISCOUNT, 0) / held[of], 0), np.where(kept, DISCOUNT * k / held, 1)


class Pairs:
    """Single words as states: counts of what follows them, merged as they come in."""

    def __init__(self, n_all: int):
        self.n_all, self.held, self.size = n_all, [], 0

    @staticmethod
    def runs(word: np.ndarray, last: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First places of equal pairs side by side, their states and keys."""
        first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (last[1:] != last[:-1]))[:len(word)])
        state = texts.mix(lut[last[first]] + np.uint64(1))
        return first, state, _then(state, lut[word[first]])

    def add(self, word: np.ndarray, last: np.ndarray, lut: np.ndarray, lut_n: np.ndarray, learnt: np.ndarray) -> None:
        first, state, key = self.runs(word, last, lut)
        n = np.add.reduceat(learnt.astype(np.int64), first)
        use = (n > 0) & (last[first] != NONE)
        self.held.append((key[use], state[use], n[use], lut_n[word[first]][use]))
        self.size += int(use.sum())
        if self.size > MERGE and len(self.held) > 8:
            self.merge()
            self.size = len(self.held[0][0])

    def merge(self) -> None:
        key, state, n, count = (np.concatenate(x) for x in zip(*self.held))
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
        self.held = [(key[first], state[order][first], np.add.reduceat(n[order], first) if len(first) else n, count[order][first])]

    def judge(self) -> None:
        self.merge()
        self.key, state, n, count = self.held[0]
        of, at = _kin(state)
        c = np.bincount(of, n)
        kept, self.a, b = _verdict(n, of, count / max(self.n_all, 1), c)
        self.share = n / c[of]
        order = np.argsort(state[at])
        self.state, self.b = state[at][order], b[order]
        self.kept = [self.key[kept[of]], texts.mix(state[at][kept] + np.uint64(1))]

    def of(self, word: np.ndarray, last: np.ndarray, lut: np.ndarray) -> list[np.ndarray]:
        """A, B and share of each token: p is A + B times the root's."""
        first, _, key = self.runs(word, last, lut)
        changed = np.append(True, last[1:] != last[:-1])[:len(last)]
        after = np.flatnonzero(changed)
        out = []
        for i, keys, wanted, values in ((first, self.key, key, ((self.a, 0.0), (self.share, 0.0))), (after, self.state, texts.mix(lut[last[after]] + np.uint64(1)), ((self.b, 1.0),))):
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            hit = (keys[at] == wanted) & (last[i] != NONE) if len(keys) else np.zeros(len(wanted), bool)
            for x, none in values:
                out.append(np.repeat(np.where(hit, x[at], none) if len(keys) else np.full(len(wanted), none), np.diff(np.append(i, len(word)))))
        return [out[0], out[2], out[1]]


def judged(key: np.ndarray, there: np.ndarray, learnt: np.ndarray, a_all: np.ndarray, b_all: np.ndarray, shorter: np.ndarray) -> list[np.ndarray]:
    """Puts states of two words and more into A and B of each token; the keys of retained states and what follows them.

    Words may depend on two before them that say nothing one by one: a state is judged
    wherever it stands ``LEAST`` times, whether or not shorter ones are retained.
    """
    at, keys = np.flatnonzero(there[1]), []
    for depth in range(2, BACK + 1):
        at = at[there[depth][at]]
        state = texts.mix(key[depth][at] + np.uint64(1))
        for d in range(depth - 1, 0, -1):
            state = _then(state, key[d][at])
        of, _ = _kin(state)
        c = np.bincount(of, learnt[at])
        often = c >= LEAST
        i = np.flatnonzero(often[of])
        at, state, of, c = at[i], state[i], (np.cumsum(often) - 1)[of[i]], c[often]
        if not len(at):
            break
        both = _then(state, key[0][at])
        pair, first = _kin(both)
        n, s = np.bincount(pair, learnt[at]), of[first]
        kept, a, b = _verdict(n, s, shorter[at][first], c)
        on = kept[of]
        keys += [both[first][kept[s] & (n > 0)], np.unique(texts.mix(state[on] + np.uint64(depth)))]
        a_all[at[on]] = a[pair[on]] + b[of[on]] * a_all[at[on]]
        b_all[at[on]] *= b[of[on]]
        shorter[at] = (n / c[s])[pair]
    return keys


def kept_states(training: DataFrame, words: DataFrame, n_all: int) -> tuple[DataFrame, int]:
    """(key) of retained states and of what follows them; and the greatest depth."""
    spark = training.sparkSession
    model = spark.sparkContext.broadcast((None, Words(np.zeros(0, np.int64), np.zeros(0, np.int64))))
    sent = _sent(training.select(F.xxhash64("text").alias("sign"), "text", F.lit(True).alias("learnt")), model, words, 1.0, _blocks(spark, n_all))

    def found(word, count, mark, own, common_word, a, b, pairs, longer, batches) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *pairs, *longer]).view(np.int64)

    return _met(sent, words, model, n_all, "key long", found, lambda keys: pa.table({"key": np.concatenate(keys)})), BACK


def _blocks(spark, n_all: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_all // BLOCK + 1)


def fit(counts: DataFrame) -> Automaton:
    rows = retained(counts.where("kind = 1").select("key", "n")).collect()  # bounded by DEPTH and GAIN
    return Automaton([tuple(r) for r in rows])


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    spark = docs.sparkSession
    frame = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), training.alias("learnt"))
    counts = stored(counted(frame.where("learnt").select("text")))
    words = counts.where("kind = 0").select("key", "n")
    n_all, kinds, once = (int(x) for x in words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.expr("count_if(n = 1)")).first())
    unknown = (once + 0.5) / (n_all + 1)
    below = n_all + 0.1 * (kinds + 1)
    mass = DISCOUNT * kinds / n_all if n_all else 1.0
    least = max(1, int(np.ceil(FREQUENT * n_all)))
    common = words.where((F.col("n") >= least) | (F.col("key") == 0)).orderBy("key").toPandas()  # at most 1 / FREQUENT rows, and the end
    model = spark.sparkContext.broadcast((fit(counts), Words(common["key"].to_numpy(np.int64), common["n"].to_numpy(np.int64))))

    def found(word, count, mark, own, common_word, a, b, pairs, longer, batches) -> list[tuple]:
        """Sums of each batch: of which rows, scores, and what their rare words add to the base and to the known ones; signs in the block of first tokens."""
        known = (1 - unknown) * (np.maximum(count - DISCOUNT, 0) / max(n_all, 1) + mass * own.astype(float))
        a = a + b * np.where((count > 0) | (word == 0), known, unknown)
        logs, rare = np.log10(a), ~common_word
        out = []
        for batch, i, signs in batches:
            rows, at = np.unique(mark[i] >> 1, return_inverse=True)
            x, n = at[rare[i]], count[i][rare[i]]
            sums = [np.bincount(at, logs[i], len(rows)).astype(float), np.bincount(x, np.log10((n + 0.1) / below), len(rows)).astype(float), np.bincount(x, n > 0, len(rows)).astype(np.uint32)]
            out.append((batch, signs, rows, *sums))
        return out

    def table(rounds: list[list[tuple]]) -> pa.Table:
        out = []
        for of in zip(*rounds):  # one batch in each round
            rows, at = np.unique(np.concatenate([x[2] for x in of]), return_inverse=True)
            score, base, known = (np.bincount(at, np.concatenate([x[i] for x in of]), len(rows)).astype(float) for i in (3, 4, 5))
            out.append({"batch": of[0][0], "signs": of[0][1], "n": len(rows), "rows": _squeeze(np.diff(rows, prepend=np.uint32(0))),
                        "score": score.tobytes(), "base": _squeeze(base), "known": _squeeze(known.astype(np.uint32))})
        return pa.Table.from_pylist(out, _SUMS)

    def joined(batch: pa.Table) -> pa.Table:
        sign, base, known, tokens = next(np.frombuffer(x, np.int64).reshape(4, -1) for x in batch.column("signs").to_pylist() if x)
        base, known, score = base.view(float).copy(), known.copy(), np.zeros(len(sign))
        for m in batch.to_pylist():
            n = m["n"]
            at = np.cumsum(_loose(m["rows"], n, np.uint32), dtype=np.uint32)
            score[at] += np.frombuffer(m["score"])
            base[at] += _loose(m["base"], n, float)
            known[at] += _loose(m["known"], n, np.uint32)
        return pa.table([sign, score, base, known, tokens], names=["sign", "score", "base", "known", "tokens"])

    sign = F.xxhash64("text").alias("sign")
    sent = _sent(frame.select(sign, "text", F.coalesce("learnt", F.lit(False)).alias("learnt")), model, words, below, _blocks(spark, n_all))
    parts = _met(sent, words.where((F.col("n") < least) & (F.col("key") != 0)), model, n_all, "batch long, signs binary, n int, rows binary, score binary, base binary, known binary", found, table)
    scored = parts.groupBy("batch").applyInArrow(joined, "sign long, score double, base double, known long, tokens long")
    # Copies of a text have equal sums but for the order of adding.
    sums = scored.groupBy("sign").agg(*[F.max(x).alias(x) for x in ("score", "base", "known", "tokens")])
    return (frame.select("doc_id", sign).join(sums, "sign")
            .select("doc_id", F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score"))
