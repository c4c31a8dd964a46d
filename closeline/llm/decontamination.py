"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check.

Words are lower-cased runs outside white space; shingles are five words (all, if fewer).
A document's windows have as many words as an item (the whole text, if it is shorter), at
every start. Of a window of m shingles that is ``SIMILARITY`` alike to an item of its size
at least m * 2 * SIMILARITY / (1 + SIMILARITY) stand in the item, whatever their order; so
the first that does has at most the rest before it, and every window that starts so far
before a shared shingle, or nearer, is taken: no other can be alike. Each distinct window
gets a 64-bit SimHash, every occurrence of a shingle voting once. Fingerprints are cut into
``RADIUS + 1`` blocks: those within ``RADIUS`` bits agree on one block at least, so the
join on (words in the item, block, value) finds all of them. Candidates within the radius
are verified: the sum of least over the sum of greatest shingle counts, window against
item, is at least ``SIMILARITY``. At that similarity fingerprints differ in about ten
bits; the radius leaves room for more than three standard deviations.

Built-in functions only. Item shingles are broadcast where their number, counted first,
is at most ``BROADCAST_ROWS``; otherwise both sides are shuffled, with the same result. Places
of shared shingles are gathered per text and turned into starts, each once; these meet their
text by id, null or not, and the text's hash.

Null or empty texts, and items without words, match nothing. Repeated documents, items
and ids are each matched on their own; pairs are distinct. Empty tables give no pairs.
Further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from closeline.session import cut_lineage

WORDS = 5
SIMILARITY = 0.8
RADIUS = 20
BITS = 64
BROADCAST_ROWS = 200_000

_LOWERED = "lower(coalesce(cast({} as string), ''))"


def _bound(name: str, value: str, body: str) -> str:
    """SQL for ``body`` where ``name`` is ``value``, worked out once for a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _shingles(words: str) -> str:
    return f"transform(sequence(0, greatest(size({words}) - {WORDS}, 0)), i -> concat_ws(' ', slice({words}, i + 1, {WORDS})))"


_VOTES = "aggregate(hashes, 0, (s, h) -> s + if((shiftrightunsigned(h, b) & 1L) = 1L, 1, -1))"
_FINGERPRINT = _bound("ws", "words", _bound("hashes", f"transform({_shingles('ws')}, x -> xxhash64(x))", f"aggregate(sequence(0, {BITS - 1}), 0L, (f, b) -> f | if({_VOTES} > 0, shiftleft(1L, b), 0L))"))
_SIMILARITY = _bound("ws", "split(window, ' ')", _bound("own", _shingles("ws"), _bound(
    "common", "aggregate(array_distinct(own), 0, (s, d) -> s + least(size(filter(own, x -> x = d)), size(filter(item_shingles, x -> x = d))))",
    "common / (size(own) + size(item_shingles) - common)")))


def _words(frame: DataFrame, text_col: str) -> DataFrame:
    """Adds words: split at white space, without empty pieces at either end."""
    trimmed = f"regexp_replace({_LOWERED.format(f'`{text_col}`')}, '^[\\\\x20\\\\x09-\\\\x0D]+|[\\\\x20\\\\x09-\\\\x0D]+$', '')"
    return frame.withColumn("_trimmed", F.expr(trimmed)).withColumn("words", F.expr("if(_trimmed = '', cast(array() as array<string>), split(_trimmed, '[\\\\x20\\\\x09-\\\\x0D]+'))")).drop("_trimmed")


def _blocks(frame: DataFrame) -> DataFrame:
    """One row for each block of the fingerprint: its place and value."""
    edges = [BITS * j // (RADIUS + 1) for j in range(RADIUS + 2)]
    values = ", ".join(f"named_struct('block', {j}, 'value', shiftrightunsigned(fingerprint, {a}) & {(1 << z - a) - 1}L)" for j, (a, z) in enumerate(zip(edges, edges[1:])))
    return frame.select("*", F.expr(f"inline(array({values}))"))


def _hits(docs: DataFrame, items: DataFrame, size: int, small: bool, id_col: str) -> DataFrame:
    """(doc_id, sign, n_item, at) of the shingles, of ``size`` words, that stand in items of ``n_item`` words."""
    sizes = (items.where(F.least(F.lit(WORDS), F.size("words")) == size)
             .select(F.size("words").alias("n_item"), F.expr(f"explode(transform(sequence(0, size(words) - {size}), i -> slice(words, i + 1, {size})))").alias("s"))
             .select(F.xxhash64(*[F.col("s")[j] for j in range(size)]).alias("key"), "n_item")
             .groupBy("key").agg(F.collect_set("n_item").alias("sizes")))
    at = F.expr(f"explode(sequence(0, size(words) - {size}))").alias("at")
    key = F.xxhash64(*[F.expr(f"words[at + {j}]") for j in range(size)])
    placed = docs.where(F.size("words") >= size).select(F.col(id_col).alias("doc_id"), "sign", "words", at)
    keyed = placed.select("doc_id", "sign", "at", key.alias("key"))
    return keyed.join(F.broadcast(sizes) if small else sizes, "key").select("doc_id", "sign", F.explode("sizes").alias("n_item"), "at", F.lit(size).alias("shingle"))


def _starts(hits: DataFrame) -> DataFrame:
    """(doc_id, sign, n_item, starts): every start of which a hit may be the first shared shingle, once.

    Before its first hit a window has no other: its start lies behind the hit before, and
    no more shingles back than may be missing.
    """
    back = f"cast(floor((n_item - shingle + 1) * {1 - 2 * SIMILARITY / (1 + SIMILARITY)!r}D + 1e-9) as int)"
    spread = f"transform(ats, (x, i) -> sequence(greatest(x - {back}, if(i = 0, 0, ats[i - 1] + 1), 0), x))"
    return (hits.groupBy("doc_id", "sign", "n_item", "shingle").agg(F.sort_array(F.collect_set("at")).alias("ats"))
            .select("doc_id", "sign", "n_item", F.expr(f"flatten({spread})").alias("starts")))


def _windows(docs: DataFrame, starts: DataFrame, id_col: str) -> DataFrame:
    """(doc_id, n_item, window): the words of the windows, each distinct one once."""
    starts = starts.select(F.col("doc_id").alias("_doc"), F.col("sign").alias("_sign"), "n_item", "starts")
    met = _words(docs.join(starts, F.col(id_col).eqNullSafe(F.col("_doc")) & (F.col("sign") == F.col("_sign"))), "text")
    # A window that would pass the end is the text's last one.
    at = "explode(array_distinct(transform(starts, x -> greatest(0, least(x, size(words) - n_item)))))"
    return (met.select("_doc", "n_item", "words", F.expr(at).alias("start"))
            .select(F.col("_doc").alias("doc_id"), "n_item", F.expr("concat_ws(' ', slice(words, start + 1, least(n_item, size(words))))").alias("window"))
            .groupBy("doc_id", "n_item", "window").agg(F.lit(1).alias("_one")).drop("_one"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity): items that a window of the document repeats, with the greatest similarity."""
    items = _words(benchmark.select("item_id", "text"), "text").where(F.size("words") > 0).drop("text")
    shape = items.agg(F.sum(F.greatest(F.size("words") - WORDS + 1, F.lit(1))), F.collect_set(F.least(F.size("words"), F.lit(WORDS)))).first()
    small = (shape[0] or 0) <= BROADCAST_ROWS
    text = F.col(f"`{text_col}`").cast("string")
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn("sign", F.xxhash64("text"))
    hits = None
    for size in sorted(shape[1]) or [WORDS]:
        part = _hits(_words(docs, "text"), items, size, small, "id")
        hits = part if hits is None else hits.union(part)
    starts = cut_lineage(_starts(hits))
    # Only the texts with hits are cut into words again; the join is chosen by the size of the starts.
    found = cut_lineage(_windows(docs, starts, "id"))
    windows = found.select("n_item", "window").distinct().withColumn("fingerprint", F.expr(_FINGERPRINT.replace("array(words)", "array(split(window, ' '))")))
    targets = items.select("item_id", F.size("words").alias("n_item"), F.expr(_bound("ws", "words", _shingles("ws"))).alias("item_shingles"), F.expr(_FINGERPRINT).alias("fingerprint"))
    keys = _blocks(windows.select("n_item", "window", "fingerprint"))
    blocks = _blocks(targets.select("item_id", "n_item", "fingerprint")).withColumnRenamed("fingerprint", "item_fingerprint")
    near = (keys.join(blocks, ["n_item", "block", "value"])
            .where(f"bit_count(fingerprint ^ item_fingerprint) <= {RADIUS}")
            .select("n_item", "window", "item_id").distinct())
    judged = (near.join(targets.select("item_id", "item_shingles"), "item_id")
              .withColumn("similarity", F.expr(_SIMILARITY))
              .where(F.col("similarity") >= SIMILARITY).select("n_item", "window", "item_id", "similarity"))
    return found.join(judged, ["n_item", "window"]).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that repeat no item; columns stay. Few leaking ids, counted first, are broadcast."""
    leaking = cut_lineage(leaks(docs, benchmark).select(F.col("doc_id").alias("_leaking")).distinct())
    if leaking.count() <= BROADCAST_ROWS:
        leaking = F.broadcast(leaking)
    names = [f"c{i}" for i in range(len(docs.columns))]  # meet no other name
    ident = names[docs.columns.index("doc_id")]
    return docs.toDF(*names).join(leaking, F.col(ident) == F.col("_leaking"), "left_anti").toDF(*docs.columns)
