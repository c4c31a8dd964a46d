"""Operators that compare texts with each other or with a benchmark, against brute force."""

import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from closeline.llm import candidates, decontamination, graph, lines, partenum, texts


def grown(seed=0):
    """Families of near copies of many sizes, strangers, shared passages and edge cases."""
    rng = np.random.default_rng(seed)
    vocab = [f"v{i}" for i in range(3000)]
    passage = list(rng.choice(vocab, 50))
    rows = []
    for n in (3, 5, 6, 9, 14, 30, 70, 150, 400):
        for _ in range(6):
            base = list(rng.choice(vocab, n))
            for copy in range(int(rng.integers(1, 7))):
                w = list(base)
                for _ in range(int(rng.integers(0, max(1, n // 25) + 1)) if copy else 0):
                    w[int(rng.integers(0, len(w)))] = str(rng.choice(vocab))
                rows.append(" ".join(w))
    for _ in range(60):
        rows.append(" ".join([*rng.choice(vocab, int(rng.integers(1, 40))), *passage, *rng.choice(vocab, int(rng.integers(1, 40)))]))
    rows += [rows[0].upper(), rows[40], rows[40], "", None, " \t\n", "x", "X"]
    order = rng.permutation(len(rows))
    return [(int(i) * 3, rows[j]) for i, j in enumerate(order)]


def union(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[j:j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()


@pytest.mark.parametrize("seed", [0, 1])
def test_ngram_join_equals_all_pairs(spark, seed):
    rows = grown(seed)
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = union(len(rows), links)
    least = defaultdict(lambda: 1 << 60)
    for (i, _), r in zip(rows, root):
        least[r] = min(least[r], i)
    frame = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, node string, sig long")
    got = {r["doc_id"]: r for r in partenum.classes(frame).collect()}
    for (i, _), s, r in zip(rows, sets, root):
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(s), least[r])
    kept = {r["doc_id"] for r in partenum.keep_one(frame).collect()}
    assert kept == {i for (i, _), r in zip(rows, root) if least[r] == i}


def test_ngram_join_of_nothing_and_of_repeats(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, None)], "doc_id long, text string")
    assert partenum.classes(frame.where("false")).count() == 0
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in partenum.classes(frame).collect()), key=str)
    assert got == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (None, 2, 1)]


def test_every_link_shares_enough_signatures():
    """Sets as far apart as links may be, of all small sizes: the guarantee of the method."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 100, 333]:
        for _ in range(8):
            most = n // 4
            common = n - int(rng.integers(0, most + 1))
            extra = int(rng.integers(0, most + 1))
            a = rng.integers(1, 1 << 62, n).astype(np.uint64)
            b = np.concatenate((a[:common], rng.integers(1, 1 << 62, extra).astype(np.uint64)))
            if not len(b) or 5 * common < 4 * (n + extra):
                continue
            values = np.concatenate((np.sort(a), np.sort(b)))
            rows = np.repeat([0, 1], [len(a), len(b)])
            sig, of, need = partenum.signatures(values, rows, np.array([len(a), len(b)]))
            shared = len(set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()))
            assert shared >= max(1, *need.tolist()), (n, common, extra)


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_components_of_chains_and_hubs(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "ONE_TASK", bound)
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    links = spark.createDataFrame(chain + hub + [(5, 5), (3, 2)], "a long, b long")
    got = {r["node"]: r["least"] for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 300)}}
    assert graph.components(links.where("false")).count() == 0


def test_components_of_random_links():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 400):
        a, b = rng.integers(0, 300, n), rng.integers(0, 300, n)
        root = union(300, zip(a.tolist(), b.tolist()))
        nodes, least = graph._least(a, b)
        for x, y in zip(nodes.tolist(), least.tolist()):
            assert y == min(k for k in range(300) if root[k] == root[x])


def line_rows():
    rng = np.random.default_rng(9)
    letters = list("abcdefghijklmnop ")
    lines_ = ["".join(rng.choice(letters, int(rng.integers(12, 300)))) for _ in range(40)]
    rows = []
    for i in range(80):
        out = []
        for _ in range(int(rng.integers(1, 6))):
            x = list(lines_[int(rng.integers(0, 40))])
            for _ in range(int(rng.integers(0, 3))):
                x[int(rng.integers(0, len(x)))] = "z"
            out.append("".join(x))
        rows.append((i, "\n".join(out)))
    return rows + [(100, None), (101, ""), (102, "\n\nshort\nshort\n"), (103, "  " + lines_[0].upper() + "  \nthe end of it all"), (None, lines_[0])]


def test_keys_of_lines_are_made_in_small_arrays(spark, monkeypatch):
    """As the operator cuts a column: 8 MB of text, and arrays of less than 80 MB at any time, 34 of them the powers that a worker keeps."""
    called = []

    class Asked(Exception):
        pass

    def asked(column, keys, *cut):
        called.append((keys, cut))
        raise Asked

    monkeypatch.setattr(candidates, "shared", asked)
    with pytest.raises(Asked):
        lines.repeats(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    (keys, cut), = called
    rng = np.random.default_rng(2)
    column = pa.array(["\n".join(bytes(rng.integers(97, 123, 300, np.uint8)).decode() for _ in range(7)) for _ in range(4000)])
    tracemalloc.start()
    for s in texts.slices(column, *cut):
        keys(s)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6


def test_freed_memory_is_given_back_after_each_column(monkeypatch):
    calls = []
    monkeypatch.setattr(texts, "give_back", lambda: calls.append(1))
    assert sum(s.rows for s in texts.slices(pa.array(["ab", None, "c"]), 1)) == 3
    assert calls == [1]


def test_lines_draw_by_32_bits_of_their_windows():
    s = next(texts.slices(pa.array(["one line of words\nanother line of words", "one line of words again"])))
    _, _, a, z = lines.stripped(s)
    folded = texts.folded(s.data)
    drawn, line = lines.drawn(a, z, texts.sums(folded))
    whole, of = lines.windows(folded, a, z)
    assert drawn.dtype == np.uint32 and line.tolist() == of.tolist()
    first = [whole.tolist().index(x) for x in whole.tolist()]
    assert [drawn.tolist().index(x) for x in drawn.tolist()] == first  # equal where the windows are


def test_keys_without_needs_are_those_with_needs_of_one(spark):
    docs = spark.createDataFrame([(f"line number {i % 7} of the table\nonly {i} here and there",) for i in range(40)], "text string")
    got = [sorted(map(tuple, candidates.shared(docs, keys).collect())) for keys in (lambda s: lines._keys(s), lines._keys)]
    assert got[0] and got[0] == got[1] and not lines._keys.needs


def test_numbers_side_by_side():
    rng = np.random.default_rng(6)
    for marks in (texts.mix(rng.integers(0, 300, 1000).astype(np.uint64)), np.array([8, 9, 8, 9, 8], np.uint64), np.zeros(0, np.uint64)):
        got = marks[texts.together(marks)]
        assert (got[1:] != got[:-1]).sum() == max(len(set(marks.tolist())) - 1, 0)


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    seen = []
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            b = x.encode().lower().strip(b" \t\n\r\x0b\x0c")
            if len(b) >= lines.LEAST and i is not None:
                seen.append((i, k, b))
    kinds = sorted({b for *_, b in seen})
    windows = [{b[j:j + lines.CHARS] for j in range(max(1, len(b) - lines.CHARS + 1))} for b in kinds]
    links = [(a, b) for a in range(len(kinds)) for b in range(a) if 5 * len(windows[a] & windows[b]) >= 4 * len(windows[a] | windows[b])]
    root = dict(zip(kinds, union(len(kinds), links)))
    first = {}
    for i, k, b in sorted(seen):
        first.setdefault(root[b], (i, k))
    drop = {(i, k) for i, k, b in seen if first[root[b]] != (i, k)}
    frame = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, lines int")
    got = lines.dedup(frame.withColumn("component", F.lit("x")).withColumn("_id", F.lit(1)).withColumn("a.b", F.lit(2))).collect()
    assert {(r["lines"], r["_id"], r["a.b"], r["component"]) for r in got} == {(7, 1, 2, "x")}
    assert len(got) == len(rows) and len(drop) > 50
    found = 0
    for r in got:
        text = dict((i, t) for i, t in rows)[r["doc_id"]]
        if text is None:
            assert r["text"] is None and r["n_removed"] == 0
            continue
        # Banding finds nearly all links; a missed one keeps a line, never drops one.
        left = r["text"].split("\n") if r["n_removed"] < len(text.split("\n")) else []
        it, kept = iter(left), []
        want = next(it, None)
        for k, x in enumerate(text.split("\n")):
            if x == want and len(kept) < len(left):
                kept.append(k)
                want = next(it, None)
        assert len(kept) == len(left) == len(text.split("\n")) - r["n_removed"]
        gone = {(r["doc_id"], k) for k in range(len(text.split("\n"))) if k not in kept}
        found += len(gone & drop)
        assert sum((r["doc_id"], k) in drop for k in range(len(text.split("\n")))) >= r["n_removed"]
    assert found >= 0.95 * len(drop)
    assert lines.dedup(frame.where("false").drop("lines")).count() == 0


def test_documents_left_without_lines_go(spark):
    frame = spark.createDataFrame([(1, "one line of text here", 21), (2, "ONE line of text here", 21), (3, "one line of text here\nand another one", 38), (4, "", 0), (5, None, 0)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.without_repeats(frame).collect()}
    assert got == {1: ("one line of text here", 21), 3: ("and another one", 15), 4: ("", 0), 5: (None, 0)}


def test_rows_of_one_id_lose_no_line(spark):
    """Rows that share an id only are documents of their own; equal rows are one and keep all its lines."""
    rows = [(1, "alpha one\nbeta two"), (1, "beta two\ngamma three"), (2, "delta four\ndelta four\nbeta two"), (2, "delta four\ndelta four\nbeta two")]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ones = sorted(r["text"] for r in got if r["doc_id"] == 1)
    assert ones in (["alpha one", "beta two\ngamma three"], ["alpha one\nbeta two", "gamma three"])
    assert [r["text"] for r in got if r["doc_id"] == 2] == ["delta four"] * 2


def test_columns_of_any_name_are_carried(spark):
    frame = spark.createDataFrame([(1, "one line of text", 1, 2, 3, 4, 5), (2, "another line of text", 1, 2, 3, 4, 5)], "doc_id long, text string, _dropped int, _leaking int, `a.b` int, c0 int, node int")
    bench = spark.createDataFrame([(1, "another line of text")], "item_id long, text string")
    for out, left in ((partenum.keep_one(frame), 2), (decontamination.clean(frame, bench), 1), (lines.without_repeats(frame), 2)):
        assert out.columns == frame.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, frame.collect()))[:left]


def test_short_lines_repeat_as_long_ones_do(spark):
    rows = [(1, "Home\nthe first article of all\n\nx"), (2, " HOME\n\nX\nHomes\n数字。"), (3, "Share\n数字。\nShare"), (4, "a"), (5, "b\na ")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\nHomes\n数字。", 2), 3: ("Share", 2), 4: ("a", 0), 5: ("b", 1)}


def test_lines_are_numbered_within_their_own_text():
    rows = ["a\n", "", None, "b\n\n", "\nc\nd", " ", "e"]
    row, number, *_ = lines.stripped(next(texts.slices(pa.array(rows))))
    assert list(zip(row.tolist(), number.tolist())) == [(0, 0), (3, 0), (4, 1), (4, 2), (6, 0)]


def leaks_by_hand(docs, items):
    def bag(w):
        return Counter(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4)))

    out = {}
    for i, text in docs:
        w = (text or "").lower().split()
        for k, item in items:
            v = (item or "").lower().split()
            if not v or not w:
                continue
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = bag(w[s:s + len(v)]), bag(v)
                common = sum((a & b).values())
                if common >= 0.8 * (sum(a.values()) + sum(b.values()) - common):
                    out[i, k] = max(out.get((i, k), 0), common / (sum(a.values()) + sum(b.values()) - common))
    return out


@pytest.fixture(scope="module")
def leaking():
    rng = np.random.default_rng(6)
    vocab = [f"v{i}" for i in range(400)]
    pick = lambda n: list(rng.choice(vocab, n))
    items = [(k, " ".join(pick(n))) for k, n in enumerate((1, 3, 5, 6, 12, 20, 40, 40, 57))] + [(20, None), (21, ""), (22, "v1 " * 30)]
    docs = [(i, " ".join(pick(60))) for i in range(40)]
    for k, item in items[1:9]:
        w = item.split()
        for edit in (None, 0, len(w) // 2):
            x = list(w)
            if edit is not None:
                x[edit] = "other"
            docs.append((len(docs) + 100, " ".join([*pick(7), *x, *pick(9)]).upper()))
    docs += [(900, items[8][1][:-12]), (901, None), (902, ""), (902, items[5][1]), (902, items[5][1]), (None, items[6][1]), (903, "v1 " * 45)]
    return docs, items


def test_decontamination_equals_brute_force(spark, leaking):
    docs, items = leaking
    frame = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, window string")
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, block int")
    want = leaks_by_hand(docs, items)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.leaks(frame, bench).collect()}
    assert set(got) == set(want) and len(want) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert decontamination.leaks(frame, bench.where("false")).count() == 0 == decontamination.leaks(frame.where("false"), bench).count()
    assert {r["doc_id"] for r in decontamination.clean(frame, bench).collect()} == {i for i, _ in docs if i is None or all(i != d for d, _ in want)}


def test_decontamination_alike_beyond_the_broadcast_bound(spark, leaking, monkeypatch):
    docs, items = leaking
    frame = spark.createDataFrame([x for x in docs if x[0] is not None], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda d: sorted(map(tuple, d.collect()))
    small = key(decontamination.leaks(frame, bench))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert key(decontamination.leaks(frame, bench)) == small


@pytest.mark.parametrize("bound", [0, 200_000])
def test_rotated_items_and_null_ids_are_found(spark, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", bound)
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{i}" for i in rng.choice(9999, n, False)]
    a, b, c = words(50), words(50), words(60)
    items = [(1, " ".join(a + b)), (2, " ".join(c))]
    docs = [(1, " ".join(words(20) + b + a + words(30))), (2, " ".join(b + a)), (3, " ".join(words(9) + c[20:] + c[:20] + words(9))),
            (4, " ".join(a + words(50))), (None, " ".join(words(5) + c)), (None, " ".join(words(80))), (5, " ".join(c)), (5, " ".join(words(70)))]
    want = leaks_by_hand(docs, items)
    assert set(want) == {(1, 1), (2, 1), (3, 2), (None, 2), (5, 2)}
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_keys_of_hot_groups_are_thinned():
    sig, node = np.array([5] * 6 + [7, 8, 8], np.uint64), np.array([1, 2, 3, 3, 4, 5, 9, 6, 6])
    parts = list(candidates._thin(sig, node, 4))
    found = sorted((int(s), int(x)) for _, f, ss, xs in parts if f for s, x in zip(ss, xs))
    waiting = sorted((int(s), int(x)) for _, f, ss, xs in parts if not f for s, x in zip(ss, xs))
    assert found == [(5, n) for n in (1, 2, 3, 4, 5)] and waiting == [(5, 1), (7, 9), (8, 6)]


def test_sketches_lose_no_link_and_stop_most_others(spark):
    """Families of sets about the threshold, some with lists longer than a piece: all links leave the tiles."""
    rng = np.random.default_rng(5)
    sets, rows = [], []
    for family in range(6):
        whole = rng.integers(1, 1 << 62, int(rng.integers(30, 900)), dtype=np.uint64)
        for _ in range(25):
            own = np.unique(np.concatenate((whole[rng.random(len(whole)) < rng.uniform(0.75, 1)], rng.integers(1, 1 << 62, int(rng.integers(1, 12)), dtype=np.uint64))))
            rows.append((family, len(sets), len(sets)))
            sets.append(own)
    size, bits = candidates.sketches(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))
    assert size.tolist() == [len(s) for s in sets]
    keyed = spark.createDataFrame([(*r, int(size[r[1]]), bytearray(bits[r[1]])) for r in rows], "key long, member long, comp long, n long, sketch binary")
    candidates.PIECE, piece = 10, candidates.PIECE
    try:
        got = {(r["a"], r["b"]) for r in candidates.possible(keyed).collect()}
    finally:
        candidates.PIECE = piece
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if rows[a][0] == rows[b][0]]
    similarity = {(a, b): len(x := set(sets[a].tolist()) & set(sets[b].tolist())) / (size[a] + size[b] - len(x)) for a, b in pairs}
    linked = {p for p in pairs if similarity[p] >= 0.8}
    assert linked and linked <= got <= set(pairs)
    assert not {p for p in got if similarity[p] < 0.7}
    content = [s.tobytes() for s in sets]
    hit = candidates.alike([content[a] for a, _ in pairs], [content[b] for _, b in pairs], partenum.elements)
    assert {p for p, h in zip(pairs, hit) if h} == linked


def test_verification_of_lines_equals_sets_of_windows():
    rng = np.random.default_rng(6)
    made = ["abcabcabcabcabc" * 3, "short", "x", "the quick brown fox jumps over the lazy dog " * 2]
    made += ["".join(rng.choice(list("ab c"), int(n))) for n in rng.integers(1, 80, 40)]
    made += [m[:-1] + "q" for m in made]
    x, y = [m.encode() for m in made for _ in made], [m.encode() for _ in made for m in made]
    own = {m: {m[j:j + lines.CHARS] for j in range(max(1, len(m) - lines.CHARS + 1))} for m in {*x}}
    assert candidates.alike(x, y, lines.elements).tolist() == [5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]) for a, b in zip(x, y)]


def test_packed_keys_of_a_block_come_back():
    rng = np.random.default_rng(7)
    blocks, block = 12, 5
    sig = rng.integers(0, 1 << 40, 2000, dtype=np.uint64) * np.uint64(blocks) + np.uint64(block)
    node = np.concatenate((np.full(600, -3), np.full(255, 9), rng.integers(-50, 50, 1145)))
    for some in (slice(0, 2000), slice(0, 510), slice(0, 0)):
        got = candidates._unpacked(block, blocks, *candidates._packed(sig[some], node[some], blocks))
        assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(sig[some].tolist(), node[some].tolist()))
