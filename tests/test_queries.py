"""Some queries against their SQL on the smallest test tables; tools/compare.py does them all."""

import os
from collections import Counter

import pytest

from graphloom.plans import general, graph

FOLDER = "/root/testdata/sf0.001"
NAMES = ["p1_found", "p1_key_quantiles", "p3_found", "label_share_top1", "redirect_resolve", "adjacency_in", "dictionary_first_seen", "link_probability_groups"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    from tools.compare import connect, plain

    registry = general.registry if name in general.registry.queries else graph.registry
    df = registry.queries[name](spark, FOLDER)
    rows = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = connect(FOLDER).execute(registry.sql[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows == Counter(tuple(plain(v) for _, v in sorted(zip(names, r))) for r in cur.fetchall())
