"""The pipeline's stages against brute force on the smallest tables, and the queries with check SQL."""

import re

import pytest

import corpus_pipeline
from lanewright.llm import toxicity
from lanewright.llm.queries import CHECKS, QUERIES
from tests.check_oracle import compare, oracle_connection
from tests.llm.test_operators import brute_components, brute_leaks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_its_check(spark, name):
    con = oracle_connection(SF)
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create or replace view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    status, _, _, note = compare(spark, con, SF, name, QUERIES[name], CHECKS[name])
    assert status == "ok", note


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(toxicity.learnable()))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if toxicity.score_text(model, t or "")["score"] < toxicity.THRESHOLD}

    best = {}
    for i, t in rows.items():
        key = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        best[key] = max(i, best.get(key, i))
    rows = {i: rows[i] for i in best.values()}

    ids = sorted(rows)
    roots, _ = brute_components([rows[i] for i in ids], corpus_pipeline.NEAR_PERCENT)
    rows = {i: rows[i] for n, i in enumerate(ids) if roots[n] == n}

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = brute_leaks(list(rows.values()), items)
    rows = {i: t for (i, t), found in zip(rows.items(), leaks) if not found}

    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: bytes(r["raw"]).decode() for r in got} == rows


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.encode(spark, docs, SF).count() == 0
