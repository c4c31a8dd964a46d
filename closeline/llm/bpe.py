"""Byte-level BPE encoding and decoding through a serialised sentencepiece BPE model.

The model file is written here, field by field, from a rank file: each vocabulary entry
is a piece whose bytes are mapped one to one to letters, its score the negative rank,
the normalisation the identity. Pre-tokens (matches of a pattern) are encoded one by
one; ids map back to ranks and to bytes.

A null text is empty; an empty text has no ids; each row is encoded alone, so ties and
repeated rows come out alike; an empty table gives no rows. Only the id and the text
column are read: further columns, whatever their names, are left out of the result.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from closeline.llm import texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHED = 120_000  # pre-tokens that a task remembers, and as many it met before those
OUT_BYTES = 1 << 19  # of texts or ids taken together

# Letters that stand for the 256 bytes: none is a space, all differ.
LETTERS = [chr(0x100 + b) for b in range(256)]
_AS_LETTERS = dict(enumerate(LETTERS))


def read_ranks(content: bytes) -> list[bytes]:
    """Vocabulary entries by rank, from lines of base64 bytes and rank."""
    pairs = [line.split() for line in content.splitlines() if line.strip()]
    ranks = {int(r): base64.b64decode(b) for b, r in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def letters(data: bytes) -> str:
    return data.decode("latin-1").translate(_AS_LETTERS)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value) -> bytes:
    """One field of the protobuf wire format: text and bytes, float, or whole number."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(vocabulary: list[bytes]) -> bytes:
    """Model file: piece 0 is unknown, piece r + 1 the entry of rank r.

    Field numbers are those of the published sentencepiece model format.
    """
    pieces = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))]
    pieces += [_field(1, _field(1, letters(b)) + _field(2, -float(r)) + _field(3, 1)) for r, b in enumerate(vocabulary)]
    trainer = _field(3, 2) + _field(4, len(vocabulary) + 1) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one task. Inside, ids are those of the pieces: rank + 1."""

    def __init__(self, content: bytes, pattern: str):
        self.vocabulary = read_ranks(content)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @cached_property
    def whole(self) -> dict[bytes, bytes]:
        return {b: struct.pack("<I", r + 1) for r, b in enumerate(self.vocabulary)}

    @cached_property
    def model(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=serialise(self.vocabulary))

    def _learn(self, tokens: set[str]) -> None:
        missing = []
        for t in tokens:
            data = t.encode()
            piece = self.whole.get(data)
            if piece is not None:
                self.known[t] = piece  # an entry as a whole needs no merges
            else:
                missing.append((t, letters(data)))
        pieces = self.model.encode([x for _, x in missing], num_threads=1)
        for (t, _), ids in zip(missing, pieces):
            self.known[t] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, several: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        tokens = [self.split(text) for text in several]
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = {t for found in tokens for t in found if t not in known}
        if older:
            again = missing & older.keys()
            known.update((t, older[t]) for t in again)
            missing -= again
        if missing:
            self._learn(missing)
        return [(np.frombuffer(b"".join(map(known.__getitem__, found)), "<u4") - np.uint32(1)).tobytes() for found in tokens]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _portions(column: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of each run of values that have OUT_BYTES together, or of one value."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + OUT_BYTES, "right")))
        yield at, to - at
        at = to


def _mapped(frame: DataFrame, column: str, carried: list[str], out: list[str], content: bytes, pattern: str) -> DataFrame:
    """The carried columns, with ``ids`` of the column's texts, what ids stand for (``decoded``), or both from one worker."""
    shared = frame.sparkSession.sparkContext.broadcast(content)  # the vocabulary file: its size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)
        for batch in batches:
            for at, n in _portions(batch.column(column)):
                part = batch.slice(at, n)
                values = part.column(column).to_pylist()
                done = [codec.encode([x or "" for x in values])] if "ids" in out else []
                if "decoded" in out:
                    done.append([codec.decode(x or b"") for x in (done[0] if done else values)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *(pa.array(x, pa.binary()) for x in done)], [*carried, *out])
        del codec
        texts.give_back()

    schema = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in carried)
    return texts.mapped(frame, run, ", ".join([schema, *(f"{x} binary" for x in out)]))


def _vocabulary(path: str | None) -> bytes:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): packed little-endian unsigned 32-bit ids of every whole text."""
    return _mapped(_texts(docs, id_col, text_col), "text", ["doc_id"], ["ids"], _vocabulary(vocabulary), pattern)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for; null ids are none."""
    return _mapped(encoded.select("doc_id", "ids"), "ids", ["doc_id", "ids"], ["decoded"], _vocabulary(vocabulary), public_tokenizers.PATTERN)


def there_and_back(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ``decode`` of ``encode``, both in one worker, so that a task holds one codec."""
    return _mapped(_texts(docs, id_col, text_col), "text", ["doc_id"], ["ids", "decoded"], _vocabulary(vocabulary), pattern)


def digests(docs: DataFrame) -> DataFrame:
    """Per document: token count, and SHA-256 of its ids and of what they decode to."""
    return there_and_back(docs).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
