"""The registered queries of this package on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from closeline.llm import bpe, decontamination, language, lines, partenum
from closeline.llm.texts import table

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(q for q in entry.queries() if q.startswith("op") and q[2].isdigit())


def test_all_operators_and_the_pipeline_are_registered():
    queries = entry.queries()
    numbers = sorted(int(q[2:].split("_")[0]) for q in queries if q.startswith("op") and q[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in queries


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith(("op3_", "op9_", "op12_", "op13_"))])
def test_a_row_for_each_document(spark, name):
    assert entry.queries()[name](spark, SMALL).select("doc_id").distinct().count() == table(spark, SMALL, "documents").count()


@pytest.mark.parametrize("name", ["op6_rule_ledger", "op13_hard_negatives"])
def test_rows_equal_their_sql(spark, name):
    con = duckdb.connect()
    for view in ("documents", "embeddings"):
        con.sql(f"create view {view} as select * from '{SMALL}/{view}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SMALL).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_pipeline_stages_take_effect(spark):
    """Each stage on its own input: what it takes out is what its operator names."""
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "byte_bpe"]
    extra = spark.createDataFrame([(10_001, "1 2 3", None, "s", 5), (10_002, None, None, "s", 0)], docs.schema)
    left = corpus_pipeline.identify(spark, docs.union(extra), SMALL)
    assert ids(docs) - ids(left) == set() and not ids(left) & {10_001, 10_002} and left.columns == columns
    lined = corpus_pipeline.dedup_lines(spark, docs, SMALL)
    removed = {r["doc_id"]: r["n_removed"] for r in lines.dedup(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in lined.collect():
        assert (r["text"] == texts[r["doc_id"]]) == (removed[r["doc_id"]] == 0)
    assert all(removed[i] for i in ids(docs) - ids(lined)) and lined.columns == columns
    groups = {r["doc_id"]: r["component_id"] for r in partenum.classes(docs).collect()}
    assert ids(corpus_pipeline.join_ngrams(spark, docs, SMALL)) == {i for i, c in groups.items() if i == c}
    leaking = ids(decontamination.leaks(docs, table(spark, SMALL, "benchmark")))
    assert leaking and ids(corpus_pipeline.decontaminate(spark, docs, SMALL)) == ids(docs) - leaking
    assert sorted(map(tuple, corpus_pipeline.tokenise(spark, docs, SMALL).collect())) == sorted(map(tuple, bpe.digests(docs).collect()))
    assert language.keep(docs.where("false")).count() == 0
