"""Rule bitmask ledger: every quality rule evaluated once, policies applied afterwards.

``measure`` reads each whole text once. ``ledger`` keeps the measurements and sets bit i
of ``failed`` where rule i fails. A policy is a versioned set of rules; what it keeps,
and what each of its rules alone decides, follows from the bits without the texts.

A null or empty text has no words and fails ``few_words`` alone. Rows are judged one by
one, so repeated rows and ties come out alike; an empty table gives an empty ledger, and
ablations of zero. Only the id and text column are read; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from closeline.llm import texts

REPEAT_WORDS = 3
_SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_LEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a character
_LINE_BREAK = np.arange(256) == 10
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

# Failure conditions in integers; the place in the tuple is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "1": ("few_words", "repeated_words", "symbols"),
    "2": tuple(BITS),
}


def _repeated(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per value: does its row hold it again; does its row hold it earlier in sort order."""
    order = np.lexsort((values, rows))
    same = (values[order][1:] == values[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    again, earlier = np.zeros(len(values), bool), np.zeros(len(values), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    earlier[order[1:]] = same
    return again, earlier


def _measure(s: texts.Slice) -> list[np.ndarray]:
    rows = s.rows
    starts, ends = texts.spans(s, texts.IS_SPACE)
    words, counts = texts.hashes(s.data, starts, ends), s.per_row(starts)
    row = np.repeat(np.arange(rows), counts)
    leads = np.concatenate(([0], np.cumsum(_LEAD[s.data])))
    chars = np.bincount(row, leads[ends] - leads[starts], rows).astype(np.int64)
    symbols = np.diff(np.concatenate(([0], np.cumsum(_SYMBOLS[s.data])))[s.edges])

    begin, end = texts.spans(s, _LINE_BREAK)
    first = np.searchsorted(starts, begin)
    worded = first < np.searchsorted(starts, end)
    line_row = s.row_of(begin)[worded]
    _, earlier = _repeated(texts.hashes(s.data, begin, end)[worded], line_row)

    covered = np.zeros(len(words), bool)
    full = np.where(counts >= REPEAT_WORDS, counts, 0)
    in_full = np.repeat(full > 0, counts)
    grams, per = texts.shingles(words[in_full], full, REPEAT_WORDS)
    gram_row = np.repeat(np.arange(rows), per)
    base = np.cumsum(counts) - counts
    at = base[gram_row] + np.arange(len(grams)) - (np.cumsum(per) - per)[gram_row]
    again, _ = _repeated(grams, gram_row)
    for j in range(REPEAT_WORDS):
        covered[at[again] + j] = True
    count = lambda r: np.bincount(r, minlength=rows).astype(np.int64)
    return [counts, chars, symbols, count(line_row), count(line_row[earlier]), count(row[covered])]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements) of every whole text."""
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in texts.slices(batch.column(1)):
                values = [pa.array(v.astype(np.int64)) for v in _measure(s)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), *values], ["doc_id", *MEASURES])

    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, failed): bit i of ``failed`` is rule i."""
    bits = " | ".join(f"if({rule}, {BITS[name]}L, 0L)" for name, rule in RULES)
    return measure(docs, id_col, text_col).withColumn("failed", F.expr(bits))


def mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def fails(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and kept without it.

    One aggregate over distinct bit patterns; the texts are not read again. A last row
    has the bits that some, and that all, documents fail.
    """
    whole = mask(policy)
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    bits = F.col("bits")
    entries = [F.struct(F.lit(name).alias("rule"), total(bits.bitwiseAND(BITS[name]) != 0).alias("failing"), total(bits == BITS[name]).alias("failing_alone"),
                        total(bits.bitwiseAND(whole & ~BITS[name]) == 0).alias("kept_without")) for name in POLICIES[policy]]
    sums = patterns.agg(F.array(*entries).alias("entries"), F.bit_or("bits").alias("any_failed"), F.bit_and("bits").alias("all_failed"))
    return sums.select(F.inline("entries"), "any_failed", "all_failed").withColumn("policy", F.lit(policy))


def judge(docs: DataFrame, policy: str = "2") -> DataFrame:
    """The ledger with the verdicts of the base policy and of ``policy``."""
    book = ledger(docs)
    return book.withColumn("base_failed", fails("base")).withColumn("kept", ~fails("base") & ~fails(policy))


_KEPT = " or ".join(f"({rule})" for _, rule in RULES)
SQL = rf"""
with d as (select doc_id, row_number() over () as k, coalesce(text, '') as text from documents),
w as (select k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
    [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as ls from d),
g as (select k, i, ws[i:i + 2] as gram from (select k, ws, unnest(range(1, len(ws) - 1)) as i from w)),
r as (select k, i from (select k, i, count(*) over (partition by k, gram) as n from g) as counted where n > 1),
c as (select k, count(distinct i + j) as n from r cross join (values (0), (1), (2)) as steps(j) group by k),
m as (select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) as n_lines,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words from w left join c using (k))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
    n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not ({_KEPT}) as kept from m
"""
