"""SimHash near-dedup, spelling variants and hard negatives against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from closeline.llm import negatives, simhash, texts, tiles, variants

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def print_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}
    changed = True
    near = {i: [j for j in ids if (prints[i] ^ prints[j]).bit_count() <= radius] for i in ids}
    while changed:
        changed = False
        for i in ids:
            low = min(root[j] for j in near[i])
            if low < root[i]:
                root[i], changed = low, True
    return root


def edited(seed=0):
    """Texts in chains of small edits, strangers, and edge cases."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(12):
        base = list(rng.choice(vocab, int(rng.integers(60, 200))))
        for _ in range(int(rng.integers(1, 8))):
            rows.append(" ".join(base))
            base[int(rng.integers(len(base)))] = str(rng.choice(vocab))
    rows += [" ".join(rng.choice(vocab, int(rng.integers(1, 9)))) for _ in range(40)]
    rows += [rows[0].upper(), rows[3], "", None, " \t\n\x0b", "x", "X", "É é", "a b c d e", " ".join(rng.choice(vocab, 30_000))]
    return list(enumerate(rows, 5))


@pytest.mark.parametrize("radius", [0, 2, 4, 7])
def test_classes_equal_all_pairs(spark, radius):
    rows = edited(radius)
    prints = {i: print_by_hand(t) for i, t in rows}
    root = components_by_hand(prints, radius)
    got = simhash.classes(spark.createDataFrame(rows, DOCS), radius=radius, piece=3).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == root and len(got) == len(rows)
    assert all(len(r["fingerprint"]) == 16 for r in got)


def test_shingle_hashes_are_those_of_spark(spark):
    text = "one two three four"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % (1 << 64) == print_by_hand(text)


@pytest.mark.parametrize("radius", range(8))
def test_bit_planes_count_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.concatenate([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 40)).astype(np.uint64), axis=0) for k in range(1, 12)])
    n = len(prints)
    node = np.repeat(np.arange(n), -(-n // 64))
    word = np.tile(np.arange(-(-n // 64)), n)
    place, hit = simhash.within(simhash._planes(prints), prints, node, word, radius)
    found = {(int(node[p]), int(word[p]) * 64 + lane) for p, h in zip(place, hit) for lane in range(64) if int(h) >> lane & 1 and int(word[p]) * 64 + lane < n}
    assert found == {(i, j) for i in range(n) for j in range(n) if (int(prints[i]) ^ int(prints[j])).bit_count() <= radius}


def test_blocks_follow_the_number_of_nodes():
    found = [simhash.agreeing(n) for n in (0, 10**3, 10**6, 10**8, 10**10, 10**12)]
    assert found == sorted(found) and found[0] == 1 and found[-1] > 2
    keys = simhash._keys(F.col("node"), 4, 2)
    assert str(keys).count("xxhash64") == 15


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_any_number_of_agreeing_blocks_finds_the_same(spark, agree, monkeypatch):
    monkeypatch.setattr(simhash, "agreeing", lambda n, r: agree)
    rows = edited(9)
    root = components_by_hand({i: print_by_hand(t) for i, t in rows}, 4)
    got = simhash.classes(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == root


def test_classes_of_nulls_repeats_and_odd_columns(spark):
    frame = spark.createDataFrame([(None, "a b c d e", 1, 2), (3, "a b c d e", 1, 2), (3, "a b c d e", 1, 2), (7, None, 1, 2), (8, "", 1, 2), (None, "zz", 1, 2)], "doc_id long, text string, node int, `a.b` int")
    got = Counter(map(tuple, simhash.classes(frame).select("doc_id", "component_id").collect()))
    assert got == Counter([(None, 3), (3, 3), (3, 3), (7, 7), (8, 7), (None, None)])
    assert simhash.classes(frame.where("false")).count() == 0


def words_by_hand(rows):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = fold(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    return {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}


def variants_by_hand(rows):
    n = words_by_hand(rows)
    code = {w: w.encode("latin-1") for w in n}
    near = {w: [v for v in n if v != w and variants.one_apart(code[w], code[v])] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root)
    return out


def spelled(seed):
    """Texts over words that come in families of single edits, with counts that differ."""
    rng = np.random.default_rng(seed)
    letters = list("abcdeéÿ×")
    words = []
    for _ in range(60):
        w = list(rng.choice(letters, int(rng.integers(5, 11))))
        for k in (60, 25, 12, 5, 3):
            words += ["".join(w)] * int(rng.integers(1, k + 1))
            at = int(rng.integers(len(w)))
            w = [w[:at] + w[at + 1:], w[:at] + [str(rng.choice(letters))] + w[at:], w[:at] + [str(rng.choice(letters))] + w[at + 1:]][int(rng.integers(3))]
    words += ["Straße", "STRAßE", "strasse", "aaaaaa", "aaaaa", "aaaaaaa", "aaaaaaaa"] * 4 + ["x" * 40, "x" * 41, "x" * 40 + "y"] * 3 + ["Ā", "naïve-naïves", "日本naïve"] * 3
    words = [words[i] for i in rng.permutation(len(words))]
    rows = [(i, " ".join(words[i * 37:i * 37 + 37])) for i in range(-(-len(words) // 37))]
    return rows + [(None, None), (None, "naïve " * 5), (1, rows[1][1]), (1 << 40, ""), (99, "q" * 70_000 + " " + "naivé," * 3)]


@pytest.mark.parametrize("frequent,piece", [(1 << 30, 2048), (2, 2048), (0, 2), (5, 1)])
def test_variants_equal_all_pairs(spark, frequent, piece):
    rows = spelled(frequent % 7)
    got = variants.group(spark.createDataFrame(rows, DOCS), frequent=frequent, piece=piece).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = variants_by_hand(rows)
    assert {r["word"]: tuple(r) for r in got} == want and len(got) == len(want)
    assert any(v[3] and v[5] != v[3] for v in want.values())


def test_variants_of_given_tables(spark):
    docs = texts.table(spark, SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = variants.group(docs.withColumn("word", F.lit(1)).withColumn("a.b", F.lit(2))).collect()
    assert {r["word"]: r["n"] for r in got} == words_by_hand(rows)
    assert variants.group(docs.where("false")).count() == 0


def test_grams_outside_an_edit_stay():
    """Near words share all but the bound's number of grams, at equal or shifted places."""
    rng = np.random.default_rng(5)
    frequent = {q: rng.integers(0, 1 << 62, 92**q // 64 + 1).astype(np.uint64) for q in (2, 3, 4)}
    for _ in range(300):
        w = bytearray(rng.integers(97, 104, int(rng.integers(5, 12))).astype(np.uint8).tobytes())
        v, at, kind = bytearray(w), int(rng.integers(len(w))), int(rng.integers(3))
        v[at:at + (kind != 0)] = bytes([int(rng.integers(97, 104))]) if kind != 2 else b""
        data, edges = np.frombuffer(bytes(w + v), np.uint8), np.array([0, len(w), len(w) + len(v)])
        g = variants.decomposed(data, edges, frequent)
        a, b = ([(int(c), int(p)) for c, p in zip(g.code[g.word == i], g.place[g.word == i])] for i in (0, 1))
        shift = len(v) - len(w)
        kept = sum((c, p) in b or (c, p + shift) in b for c, p in a)
        assert kept >= len(a) - variants.bounds(g)[0]
        chosen = variants.listed(g, np.zeros(variants.COUNTERS, np.int64))
        key, word, short, _ = variants.entries(g, chosen)
        first = {(int(k), bool(s)) for k, x, s in zip(key, word, short) if x == 0}
        second = {(int(k), bool(s)) for k, x, s in zip(key, word, short) if x == 1}
        assert any((k, False) in second or (not s and (k, True) in second) for k, s in first)


def mined_by_hand(rows, every):
    rows = [(i, y, x) for i, x, y in dict.fromkeys((i, None if x is None else tuple(x), y) for i, x, y in rows) if None not in (i, y, x)]
    rows = [(i, y, [int(np.floor(256 * float(v))) for v in x]) for i, y, x in rows if all(v is not None and np.isfinite(v) for v in x)]
    score = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for i, y, x in rows:
        if i % every:
            continue
        ranked = sorted((-score(x, v), j) for j, z, v in rows if z == y and j != i)[:5]
        others = sorted((-score(x, v), j) for j, z, v in rows if z != y)
        for p, positive in ranked:
            fit = [(n, j) for n, j in others if -50 * p <= -100 * n <= -95 * p][:3]
            out += [(i, positive, k, j, -p, -n) for k, (n, j) in enumerate(fit, 1)]
    return Counter(out)


@pytest.mark.parametrize("scale,block", [(0.05, 16), (1.0, 7), (60_000.0, 4096)])
def test_negatives_equal_all_pairs(spark, scale, block):
    rng = np.random.default_rng(block)
    centers = rng.normal(size=(6, 9))
    rows = []
    for i in range(400):
        x = centers[i % 6] * rng.uniform(0.2, 3) + rng.normal(size=9) * rng.choice([0.0, 0.2, 1.0])
        rows.append((i, [float(np.float32(v * scale)) for v in x], i * 7 % 4 if i % 3 else 0))
    rows += [(400 + i, rows[10][1], i % 3) for i in range(60)]  # ties
    rows += [rows[10], (None, [1.0], 1), (460, None, 1), (461, [1.0] * 9, None), (462, [1.0, None] * 4, 1), (463, [float("nan")] * 9, 1), (464, [float("inf")] * 9, 2)]
    rows += [(470, [], 1), (470 + 10, [0.5, 2.0], 0), (490, [0.0] * 9, 2)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, score int, `a.b` string")
    got = negatives.mine(frame, F.expr("vec_id % 10 = 0"), block=block)
    want = mined_by_hand(rows, 10)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100
    assert negatives.mine(frame.where("false"), F.expr("vec_id % 10 = 0")).count() == 0


def test_coordinates_lose_no_candidate():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8))
    x = (x / np.sqrt((x**2).sum(axis=1, keepdims=True)) * rng.uniform(950, 1000, (500, 1))).astype("<i4")  # as in a bucket
    block = negatives.Block(pa.table({"vec_id": np.arange(500), "label": np.zeros(500, np.int64), "vector": [v.tobytes() for v in x]}), 8)
    pruned = 0
    for q in x[:50].astype(np.int64):
        score = x.astype(np.int64) @ q
        for least in np.sort(score)[[-1, -5, -50, -300]]:
            at = block.candidates(q, float(np.sqrt((q**2).sum())), int(least))
            if at is not None:
                assert set(np.flatnonzero(score >= least)) <= set(at)
                pruned += len(at) < 250
    assert pruned > 50


def test_hot_keys_meet_in_tiles(spark):
    """Each pair of a key meets in one tile, and no tile holds many more rows than two pieces."""
    frame = spark.range(300).select(F.when(F.col("id") < 200, 1).otherwise(F.col("id")).cast("long").alias("key"), F.col("id").alias("member"))
    rows = tiles.tiled(frame, 20).collect()
    by = {}
    for r in rows:
        by.setdefault((r["key"], r["lo"], r["hi"]), []).append((r["part"], r["member"]))
    assert max(map(len, by.values())) < 80
    met = Counter()
    for (_, lo, hi), held in by.items():
        met.update(frozenset((a, b)) for p, a in held for q, b in held if a < b and (lo == hi or p != q))
    assert set(met.values()) == {1} and sum(1 for p in met if max(p) < 200) == 200 * 199 // 2
