import corpus_pipeline
import duckdb
import pytest
import tiktoken
from loanlens.llm import bpe, langid, simhash
from loanlens.llm.common import read_table, stored
from loanlens.llm.queries import ORACLE_SQL, PATTERN, QUERIES, RANKS

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = read_table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), f"test-{name}")
        seen[name] = (before, docs)
        if name != "byte_bpe":
            assert docs.columns == columns
    before, after = seen["language_id"]
    rejected = {r.doc_id for r in langid.predict_language(before, langid.learn(before)).where("rejected").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - rejected
    before, after = seen["exact_dedup"]
    assert after.count() == before.select("text").distinct().count()
    before, after = seen["simhash_near_dedup"]
    assert after.count() == simhash.simhash_components(before).select("component_id").distinct().count()
    before, after = seen["decontamination"]
    assert after.count() == before.count()
    before, after = seen["byte_bpe"]
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
    assert sorted(rows) == sorted(corpus_pipeline.run(spark, SF).collect())


def test_odd_rows_pass_every_stage(spark, make_docs, odd_rows, clashing):
    docs = clashing(make_docs([*odd_rows, (40, "the of and", "en"), (41, "le la des", "fr")]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), f"odd-{name}")
        assert out.columns == docs.columns
        docs = out
    assert sorted(map(str, (r.doc_id for r in docs.collect()))) == ["4", "40", "41", "7", "8", "9"]
    assert corpus_pipeline.encode(spark, docs, SF).count() == 6


def test_empty_documents(spark, make_docs):
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF) if stage is corpus_pipeline.encode else stored(stage(spark, docs, SF), "empty")
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET threads = 2")
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, want.fetchall())) == sorted(map(key, got.select(want.columns).collect()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_returns_a_row_for_each_input_row(spark, name):
    rows = QUERIES[name](spark, SF)
    table = {"op3": "pages", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    n = read_table(spark, SF, table).count()
    if name.startswith("op4"):
        assert rows.agg({"n_docs": "sum"}).first()[0] == n
    else:
        assert rows.count() == n
