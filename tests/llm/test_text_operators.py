"""Operators that judge texts one by one, against plain Python on small fixtures."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from closeline.llm import bpe, language, licenses, rules, sharding, suffix_tree, texts, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 3000
EDGES = [
    (1, "The cat sat on the mat.\nThe cat sat on the mat.\n\n* a b"), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (5, LONG), (6, "Ünïcode – words here 数字 \U0001f600"),
    (6, "Ünïcode – words here 数字 \U0001f600"), (None, "no id at all"), (7, "#*$%&|<> ### x"), (8, "x"), (9, "a\rb\x1cc\x00d"), (10, "a b c a b c a b c"),
]


def words(text):
    return WORD.findall((text or "").encode().replace(b"", b""))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y") for i, t in EDGES]
    # Further columns have the names that the operators use inside or return.
    return spark.createDataFrame(rows, "doc_id long, text string, score string, node string").cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows_of(frame):
    return sorted(frame.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def expected_order():
    return sorted(EDGES, key=lambda r: (r[0] is None, r[0] or 0))


def test_words_and_shingles_equal_plain_python(spark):
    import pyarrow as pa

    column = pa.array([t for _, t in EDGES])
    for limit in (1, 50, 1 << 20):
        got, sets = [], []
        for s in texts.slices(column, limit):
            starts, ends = texts.spans(s, texts.IS_SPACE)
            counts = s.per_row(starts)
            at = 0
            hashed, per = texts.shingles(texts.hashes(s.data, starts, ends), counts)
            for n in counts.tolist():
                got.append([s.data[a:z].tobytes() for a, z in zip(starts[at:at + n], ends[at:at + n])])
                at += n
            sets += [len(set(x.tolist())) for x in np.split(hashed, np.cumsum(per)[:-1])]
        assert got == [words(t) for _, t in EDGES]
        want = [{tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for w in got]
        assert sets == [len(x) for x in want]


def test_bpe_equals_tiktoken_and_decodes(docs, none):
    path = public_tokenizers.path(bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r, (_, text) in zip(rows_of(bpe.digests(docs)), expected_order()):
        ids = known.encode_ordinary(text or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(none).count() == 0


def test_bpe_takes_one_worker_a_task_and_batches_of_some_mb(spark, docs):
    plan = bpe.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    long = spark.range(300, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat('lorem ipsum ', 5000)").alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    sizes = [r["n"] for r in texts.mapped(long, run, "n long").collect()]
    assert sum(sizes) > 17_000_000 and max(sizes) < 5_000_000


def test_bpe_remembers_what_came_before_its_cache_was_full(monkeypatch):
    codec, several = bpe.Codec(open(public_tokenizers.path(bpe.VOCABULARY), "rb").read(), public_tokenizers.PATTERN), [t or "" for _, t in EDGES]
    want = codec.encode(several)
    monkeypatch.setattr(bpe, "CACHED", 3)
    again = [codec.encode([t])[0] for t in several + several]
    assert again == want + want and len(codec.known) < 100 and [codec.decode(x).decode() for x in want] == several


def test_rule_measures_equal_plain_python(docs, none):
    for r, (_, text) in zip(rows_of(rules.judge(docs)), expected_order()):
        w = words(text)
        grams = Counter(tuple(w[j:j + 3]) for j in range(len(w) - 2))
        again = {j + k for j in range(len(w) - 2) if grams[tuple(w[j:j + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").encode().split(b"\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(len(x.decode()) for x in w))
        assert r["n_symbols"] == sum((text or "").count(c) for c in "#*$%&|<>")
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert rules.judge(none).count() == 0


def test_ablations_follow_from_the_bits(docs, none):
    book = rules.ledger(docs).cache()
    bits = [r["failed"] for r in book.collect()]
    whole = rules.mask("2")
    for r in rules.ablations(book, "2").collect():
        bit = rules.BITS[r["rule"]]
        assert r["failing"] == sum(b & bit > 0 for b in bits)
        assert r["failing_alone"] == sum(b & whole == bit for b in bits)
        assert r["kept_without"] == sum(b & whole & ~bit == 0 for b in bits)
    assert {r["failing"] for r in rules.ablations(rules.ledger(none), "base").collect()} == {0}


def test_shards_of_text_ids_and_odd_columns(spark):
    rows = [(f"id{i}", "word " * (i % 7), i, i, i) for i in range(50)] + [(None, None, 0, 0, 0)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id string, text string, _low int, Size int, `a.b` int"), 3)
    assert got.columns == ["doc_id", "text", "_low", "a.b", *sharding.OUTPUT]
    check_shards(got.collect(), [(r[0], r[1]) for r in rows], 3)


def check_shards(rows, originals, shards):
    assert len(rows) == len(originals)
    for k in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    for r in rows:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)


def test_shards_are_gapless_and_near_equal(spark, docs, none):
    check_shards(sharding.shard(docs, 3).collect(), EDGES, 3)
    assert sharding.shard(none).count() == 0
    rows = [(i, f"text {i} " + "y" * (i * 37 % 200)) for i in range(2000)] + [(5000 + i, "one hot text " * 9) for i in range(1500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(got, rows, 8)
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 8
    assert max(abs(v - mean) for v in size.values()) < 0.01 * mean + 250
    split = Counter(t for t, _ in {(r["text"], r["shard"]) for r in got})
    assert [t for t, n in split.items() if n > 1] == ["one hot text " * 9]


def test_histogram_sort_with_repeated_rows_only(spark):
    rows = [(7, "same")] * 50
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(got, rows, 8)


def test_licenses_are_found_where_they_stand(spark, docs, none):
    texts_ = [
        (1, "a b c\nLicensed under the Apache License, Version 2.0.\nd"), (2, "Released under the MIT License."), (3, "released UNDER the mit license. " * 3 + "x " * 40), (4, "Released under no MIT License."), (5, None), (6, ""),
        (7, " ".join(["w"] * 5000) + " " + licenses.TEMPLATES["MIT permission"].replace("merge, publish", "blend, publish"))]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(texts_, "doc_id long, text string")).collect()}
    assert got == {(1, "Apache-2.0"), (2, "MIT"), (3, "MIT"), (7, "MIT permission")}
    assert licenses.scan(docs).count() == 0 == licenses.scan(none).count()


def licenses_by_hand(text, name):
    """Whether any window on the scan's grid holds 0.8 of the template's shingles."""
    split = lambda x: re.findall(rb"[a-z0-9\x80-\xff]+", x.encode().lower())
    template, text = split(licenses.TEMPLATES[name]), split(text)
    size = licenses.FEW if len(template) < licenses.SHORT else licenses.WORDS
    cut = lambda w: [tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, min(len(w), 1)))]
    wanted, found = set(cut(template)), cut(text)
    stride = len(wanted) // 4 + 1
    return any(len(wanted & set(found[i:i + len(wanted) + stride - 1])) >= 0.8 * len(wanted) for i in range(0, len(found), stride))


def test_notices_are_found_whatever_the_marks(spark):
    rng = np.random.default_rng(8)
    notices = licenses.TEMPLATES
    rows = [
        (1, "x Released under the MIT License, y"), (2, "Licensed under CC BY-NC 4.0 terms"), (3, 'Licensed under the Apache License, Version 2.0 (the "License")'),
        (4, notices["GPL notice"]), (5, "a b " + notices["BSD conditions"] + " " + notices["BSD conditions"] + " " + notices["BSD conditions"]),
        (6, "Licensed under CC BY-NC-ND 4.0"), (7, "Released under the MIT License. " * 2), (8, "The BSD notice and the MIT License differ"),
    ]
    for i, text in enumerate(notices.values()):
        for j, rate in enumerate((0.0, 0.02, 0.05)):
            w = [x if rng.random() > rate else "edited" for x in text.split()]
            rows.append((100 + 3 * i + j, "filler words " * int(rng.integers(0, 30)) + " ".join(w) + " tail" * int(rng.integers(0, 30))))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(i, name) for i, text in rows for name in notices if licenses_by_hand(text, name)}
    of = lambda i: {(r["license"], r["first_word"]) for r in got if r["doc_id"] == i}
    assert of(1) == {("MIT", 1)} and of(2) == {("CC-BY-NC-4.0", 0)} and of(3) == {("Apache-2.0", 0)} and ("GPL notice", 0) in of(4)
    assert sorted(at for name, at in of(5) if name == "BSD conditions") == [2 + k * len(re.findall("[A-Za-z0-9]+", notices["BSD conditions"])) for k in range(3)]
    assert of(6) == of(8) == set() and of(7) == {("MIT", 0), ("MIT", 5)}


def test_suffix_tree_base_is_exact_and_scores_are_probabilities(docs, none):
    rows = rows_of(suffix_tree.score(docs, ~suffix_tree.held_out()))
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in expected_order()]
    tokens = [[w.lower() for w in words(t)] + [None] for _, t in expected_order()]
    counts = Counter(t for out, ts in zip(held, tokens) if not out for t in ts)
    n, v = sum(counts.values()), len(counts)
    for r, ts in zip(rows, tokens):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(counts[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), abs=1e-6)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert suffix_tree.score(none, ~suffix_tree.held_out()).count() == 0


def test_suffix_tree_contexts_help_on_held_out_text(spark):
    rng = np.random.default_rng(4)
    syllables = ["tho", "ren", "ka", "mi", "sul"]
    rows = [(i, " ".join("".join(rng.choice(syllables, 6)) for _ in range(60))) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_tree.score(frame, ~suffix_tree.held_out()).where(suffix_tree.held_out()).agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert got[2] > 10 and got[0] > got[1]


def chained(n, seed=4):
    """Texts in which a word depends on the two before it."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        w = [int(x) for x in rng.integers(0, 40, 2)]
        for _ in range(60):
            w.append((3 * w[-1] + 7 * w[-2] + int(rng.integers(0, 2))) % 40)
        out.append((i, " ".join(f"w{x}" for x in w)))
    return out


def test_suffix_states_of_words_carry_the_score(spark, monkeypatch):
    rows, rng = chained(300), np.random.default_rng(1)
    mixed = [(i + 1000, " ".join(rng.permutation(t.split()))) for i, t in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    frame = spark.createDataFrame(rows + mixed + [(2000, rows[0][1] + " unseen words"), (2001, rows[0][1] + " unseen words")], "doc_id long, text string")
    train = ~suffix_tree.held_out() & (F.col("doc_id") < 1000)
    got = {r["doc_id"]: r for r in suffix_tree.score(frame, train).collect()}
    for i, _ in mixed:
        assert got[i - 1000]["base_score"] == pytest.approx(got[i]["base_score"])
        assert got[i - 1000]["score"] > got[i]["score"] + 10
    # The same where counts meet in the join instead.
    monkeypatch.setattr(suffix_tree, "FREQUENT", 1.0)
    joined = {r["doc_id"]: r for r in suffix_tree.score(frame, train).collect()}
    for i, r in got.items():
        assert tuple(joined[i]) == pytest.approx(tuple(r))


def test_a_block_in_rounds_and_batches_scores_as_in_one(spark, monkeypatch):
    # A word that is everywhere: its block holds half of all tokens, and is worked through in parts.
    rows = [(i, " ".join(x for w in t.split() for x in ("the", w)) + (" the end" if i % 3 else "")) for i, t in chained(120)] + [(500, ""), (501, None), (502, "the")]
    rows += [(600 + i, rows[i][1]) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    scored = lambda: {r["doc_id"]: tuple(r) for r in suffix_tree.score(frame, ~suffix_tree.held_out()).collect()}
    whole = scored()
    assert whole[600][1:] == pytest.approx(whole[0][1:]) and len(whole) == len(rows)
    monkeypatch.setattr(suffix_tree, "ROUND", 300)
    monkeypatch.setattr(suffix_tree, "TOGETHER", 500)
    monkeypatch.setattr(suffix_tree, "FREQUENT", 0.01)
    for i, r in scored().items():
        assert r == pytest.approx(whole[i])


def test_retained_states_grow_with_the_corpus(spark):
    def kept(rows):
        column = spark.createDataFrame(rows, "doc_id long, text string").select("text")
        words = suffix_tree.counted(column).where("kind = 0").select("key", "n")
        return {r["key"] for r in suffix_tree.kept_states(column, words, int(words.agg(F.sum("n")).first()[0]))[0].collect()}

    small = chained(20)
    strangers = [(i, " ".join(f"s{i}x{j} s{i}y{j}" for j in range(30))) for i in range(2000)]
    few, many = kept(small), kept(small + strangers)
    assert few and few <= many and len(kept(chained(100))) > len(few)


def test_automaton_finds_the_longest_context():
    rows = [(0, 0, b, n) for b, n in ((97, 50), (98, 30), (32, 20))] + [(1, 97, 98, 40), (1, 97, 97, 10), (1, 98, 97, 30), (2, 97 << 8 | 98, 32, 25), (2, 97 << 8 | 98, 97, 5)]
    tree = suffix_tree.Automaton(rows)
    run = np.frombuffer(b"ab aabab", np.uint8)
    logs = tree.logs(run, np.array([len(run)]))
    p0 = np.full(256, 0.5)
    p0[[97, 98, 32]] += [50, 30, 20]
    p0[[9, 11, 12, 13]] = 0
    p0 /= p0.sum()

    def after(parent, found):
        c = np.zeros(256)
        c[list(found)] = list(found.values())
        return (c + len(found) * parent) / (c.sum() + len(found))

    pa, pb = after(p0, {98: 40, 97: 10}), after(p0, {97: 30})
    pab = after(pb, {32: 25, 97: 5})
    want = [p0[97], pa[98], pab[32], p0[97], pa[97], pa[98], pab[97], pa[98]]
    np.testing.assert_allclose(10 ** logs, want, rtol=1e-5)


def test_marginals_equal_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    field = language.Field(["a", "b", "c"])
    field.transitions = rng.standard_normal((3, 3))
    e = rng.standard_normal((4, 3))
    got = field.marginals(e, np.array([0]), np.array([4]))
    weight = {p: math.exp(sum(e[i, x] for i, x in enumerate(p)) + sum(field.transitions[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product(range(3), repeat=4)}
    for i in range(4):
        for y in range(3):
            assert got[i, y] == pytest.approx(sum(v for p, v in weight.items() if p[i] == y) / sum(weight.values()))


def test_language_of_held_out_and_switched_texts(spark, docs, none):
    vocab = {"aa": ["kalo", "kami", "karu", "kasi"], "bb": ["stren", "strol", "strip", "strax"]}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(vocab[lang], 30)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    extra = [(1000, None, None), (1001, "", "aa"), (1002, "12 34 ... !", "bb"), (1003, "kalo " * 5 + "stren " * 20, None), (1003, "kalo " * 5 + "stren " * 20, None)]
    got = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    assert 0.7 < got[1003]["score"] < 0.95 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.predict(unlabelled).collect()} == {"und"}
    assert language.predict(none.withColumn("lang", F.lit("aa"))).count() == 0


def test_language_sample_has_each_text_once_and_pieces_of_long_ones(spark):
    copies = [(i, "the same words again", "aa") for i in range(400)]
    others = [(1000 + i, f"kalo kami {i}", "aa") for i in range(400)]
    one = next(i for i in range(3000, 3100) if zlib.crc32(str(i).encode()) % 4 != 2)
    long = [(one, "stren strol " * 2000, "bb"), (one + 1, " " * 9000, "bb"), (one + 2, None, "bb")]
    frame = spark.createDataFrame(copies + others + long, "doc_id long, text string, lang string")
    got = language.sample(frame)
    aa, bb = [t for t, lang in got if lang == "aa"], [t for t, lang in got if lang == "bb"]
    assert len(aa) == len(set(aa)) == language.PER_LANGUAGE
    assert len(bb) == 1 and set(bb[0].split()) == {"stren", "strol"} and len(bb[0].encode()) <= language.FIT_BYTES
    found = language.predict(frame.where("lang = 'bb' or text like 'kalo%'")).where(F.col("doc_id") == one).first()
    assert found["lang_pred"] == "bb"


def test_mixed_texts_of_known_languages_stay(spark):
    vocab = {"aa": ["kalo", "kami", "karu"], "bb": ["stren", "strol", "strip"], "cc": ["ovu", "ivu", "uvo"]}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(vocab[lang], 30)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    mixed = [(1000, "kalo " * 40 + "stren " * 30 + "ovu " * 30, None), (1001, "1 2", None)]
    frame = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    share = language.predict(frame).where("doc_id = 1000").first()
    assert share["lang_pred"] == "aa" and share["score"] < 0.5
    assert {r["doc_id"] for r in language.keep(frame).collect()} == {i for i, *_ in rows} | {1000}


def test_gradients_of_the_network():
    net = toxicity.Network(np.arange(5, dtype=np.uint64), np.zeros(5))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, start, length, y = rng.standard_normal((20, 13)), np.array([0, 7, 12]), np.array([7, 5, 8]), np.array([1, 0, 1.0])

    def loss():
        z = net.forward(x, start, length)
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    z, saved = net.forward(x, start, length, True)
    g, _ = net.backward(x, toxicity._sigmoid(z) - y, saved)
    for k in ("att", "att_v", "f_in", "f_state", "b_state", "b_bias", "out"):
        i = (0,) * net.p[k].ndim
        net.p[k][i] += 1e-3
        up = loss()
        net.p[k][i] -= 2e-3
        down = loss()
        net.p[k][i] += 1e-3
        assert g[k][i] == pytest.approx((up - down) / 2e-3, rel=1e-2, abs=1e-5)


def test_toxicity_of_held_out_texts(spark, docs, none):
    rng = np.random.default_rng(3)
    common = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(600):
        w = list(rng.choice(common, int(rng.integers(20, 200))))
        if i % 4 == 0:
            for _ in range(3):
                w.insert(int(rng.integers(0, len(w))), str(rng.choice(["vile", "scum"])))
        rows.append((i, " ".join(w)))
    frame, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = [r for r in toxicity.score(frame, labels).collect() if r["held_out"]]
    assert len(got) > 100 and np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in got]) > 0.95
    scored = toxicity.score(docs, labels).collect()
    assert len(scored) == len(EDGES) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(none, labels).count() == 0
    assert {r["score"] for r in toxicity.score(docs, labels.where("toxic = 0")).collect()} == {0.0}
