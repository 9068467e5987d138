"""The registered queries against their SQL, and the pipeline from end to end."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gridloom.llm import decontaminate, omh_dedup
from gridloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in entry.queries()}
    assert "pipeline" in entry.queries()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).cache()
    assert set(docs.columns) <= set(out.columns)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1
    distinct = out.select(*docs.columns).dropDuplicates(["doc_id"])
    assert decontaminate.leaks(distinct, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert {r.class_size for r in omh_dedup.near_duplicates(distinct).collect()} == {1}


def test_each_stage_decides_as_its_operator(spark, tmp_path):
    from collections import Counter

    from gridloom.llm import mixing, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    count = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]

    def run(name, before):
        stages[name](spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns[: len(cols)] == cols
        return after

    scored = {r.doc_id: r.predicted for r in toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    clean = run("toxicity", docs)
    assert count(clean) == Counter({i: n for i, n in count(docs).items() if not scored[i]})
    classes = {r.doc_id: r.class_id for r in omh_dedup.near_duplicates(clean).collect()}
    once = run("near_duplicates", clean)
    assert count(once) == Counter(set(classes.values()))
    leaked = {r.doc_id for r in decontaminate.leaks(once, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    fresh = run("decontamination", once)
    assert leaked and count(fresh) == Counter({i: n for i, n in count(once).items() if i not in leaked})
    mixed = run("mixing", fresh)
    assert count(mixed) == Counter({r.doc_id: r.copies for r in mixing.mix_plan(fresh).collect() if r.copies})
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in docs.collect()}
    assert count(run("sharding", mixed)) == count(mixed)
