"""Queries of the text operators against their SQL, or their kernels, on the smallest test tables."""

import os
from collections import Counter

import pytest

from graphloom.llm import markup, truncation
from graphloom.llm.queries import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", ["p4_found", "p4_log_entropy", "p5_found", "p6_found"])
def test_query_equals_sql(spark, name):
    from tools.compare import connect, plain

    df = registry.queries[name](spark, FOLDER)
    rows = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = connect(FOLDER).execute(registry.sql[name])
    names = [c[0] for c in cur.description]
    assert rows == Counter(tuple(plain(v) for _, v in sorted(zip(names, r))) for r in cur.fetchall())


def test_pieces_of_all_revisions(spark):
    texts = {(r["id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/revisions.parquet").select("id", "text").collect()}
    want = {(i, p, c) for i, t in texts for p, c in markup.pieces(t)}
    got = [tuple(r) for r in registry.queries["p2_found"](spark, FOLDER).collect()]
    assert set(got) == want and len(got) == len(want)


def test_truncated_of_all_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "title").collect()
    want = {r["doc_id"] for r in docs if truncation.stop(r["text"], r["title"]) in truncation.CUT}
    assert {r["doc_id"] for r in registry.queries["p9_found"](spark, FOLDER).collect()} >= want
