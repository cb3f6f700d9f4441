"""Kernels and operators on hand-worked inputs and against brute force."""

import collections
import hashlib
import math
import random
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import keys, text, vectors, wikitext
from graphloom.operators import counting, dirichlet, evaluation, lda, links as L, orphans, ranking, scorers, selection, similarity, topics, walk
from graphloom.plans import graph


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


# keys and texts


@pytest.mark.parametrize("raw, want", [("EN: main_page ", "en:Main page"), (" de:kategorie:  a_ _b", "de:Kategorie: a b"), ("en:éa", "en:Éa"), ("x", "x:"), ("", ":"), (None, None), ("en:", "en:")])
def test_canonical_target(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "dst string")
    assert df.select(keys.canonical_target(F.col("dst"))).first()[0] == want


def test_page_keys(spark):
    ns = spark.createDataFrame([("en", 0, ""), ("en", 14, "Category"), ("en", 14, "Category")], "lang string, ns_id int, name string")
    pages = spark.createDataFrame([(1, " EN", 0, "A_b"), (2, "en", 14, "C"), (3, None, 0, "D"), (4, "zz", 0, "E"), (5, "en", None, "F"), (6, "en", 0, None)], "id bigint, language string, namespace_id int, title string")
    assert rows(keys.page_keys(pages, ns, "id")) == [("en:A b", 1), ("en:Category:C", 2)]


def test_labels(spark):
    df = spark.createDataFrame([("  Main – Article.",), ("--",), (None,)], "label string")
    assert [r[0] for r in df.select(keys.label_text(F.col("label"))).collect()] == ["main article", None, None]
    assert one(spark, text.normal_label(F.col("l")), l="The U.S.A.'s x-ray") == "the u.s.a s x ray"


LINKS = [
    ("[[Foo bar]]s", ("Foo bar", None, "Foo bars", False, "s")),
    ("[[Mercury (planet)|]]", ("Mercury (planet)", None, "Mercury", False, "")),
    ("[[a_b#c d|e]]", ("A b", "c_d", "e", False, "")),
    ("[[:Category:X]]", ("Category:X", None, ":Category:X", True, "")),
    ("[[AT&amp;T]]", ("AT&T", None, "AT&T", False, "")),
]


@pytest.mark.parametrize("raw, want", LINKS)
def test_link_parts(spark, raw, want):
    df = spark.createDataFrame([(1, f"x {raw} y")], "id int, text string")
    r = wikitext.extract_links(df, "id", "text").first()
    assert (r["title"], r["anchor"], r["display"], r["colon"], r["trail"]) == want


def test_wikitext_kernels(spark):
    assert wikitext.strip_wiki("x {{a {{b}} c}} y") == "x  y"
    assert wikitext.strip_wiki("[http://x y] <nowiki>a</nowiki>b<nowiki>c</nowiki> <b>d</b><!-- e\nf -->") == "y b d"
    df = spark.createDataFrame([(1, "a\n== B ==\nc\n=== D ===\ne"), (2, "x")], "id int, text string")
    assert rows(wikitext.split_sections(df, "id", "text")) == sorted([(1, 0, 0, None, "a"), (1, 1, 2, "B", "c"), (1, 2, 3, "D", "e"), (2, 0, 0, None, "x")], key=repr)
    assert one(spark, wikitext.redirect_target(F.col("t")), t="#redirect [[B]] [[C]]") == "B"
    t = wikitext.Templates({"x": "<{{{1}}}{{{n|d}}}>", "loop": "a{{loop}}", "y": "{{x|{{{1}}}|n=2}}<noinclude>no</noinclude>"})
    assert t.expand("P", "{{x|1}} {{y|3}} {{loop}} {{PAGENAME}} {{#if: a|b|c}} {{#ifeq:1|1|s|d}} {{#expr:1+2*3}} {{none}}") == "<1d> <32> a P b s 7 "


@pytest.mark.parametrize("e, v", [("1+2*3", 7), ("(1+2)*3", 9), ("7 mod 4", 3), ("10 div 4", 2.5), ("not 1 or 1", 1), ("2.345 round 2", 2.35), ("1 <> 2", 1), ("-2+5>=3 and 1", 1), ("2-3-4", -5)])
def test_expressions(e, v):
    assert wikitext.evaluate(e) == pytest.approx(v)


@pytest.mark.parametrize("e", ["1/0", "1 +", "(1", "a"])
def test_bad_expressions(e):
    with pytest.raises(ValueError):
        wikitext.evaluate(e)


# p1: hot keys


def brute_ranks(pairs, probs):
    by = collections.defaultdict(list)
    for k, v in pairs:
        if v is not None:
            by[k].append(v)
    return {(k, len(v), p, sorted(v)[max(1, math.ceil(p * len(v) - 1e-9)) - 1]) for k, v in by.items() for p in probs}


@pytest.mark.parametrize("small, buckets, cells", [(1, 2, 100_000), (5, 4, 100_000), (10_000, 256, 100_000), (5, 4, 6)])
def test_key_quantiles_equal_brute_force(spark, monkeypatch, small, buckets, cells):
    monkeypatch.setattr(selection, "MAX_CELLS", cells)  # with 6 most groups are between light and hot
    rng = random.Random(small)
    pairs = [("hot", rng.randint(-(10**12), 10**12)) for _ in range(600)] + [("same", 7)] * 90 + [("ties", rng.randint(0, 3)) for _ in range(150)]
    pairs += [(f"k{i % 40}", rng.randint(0, 99)) for i in range(200)] + [(None, 4), (None, 2), ("null", None)]
    df = spark.createDataFrame([(k, v, 0, 0) for k, v in pairs], "key string, v bigint, n int, _code int")
    got = selection.key_quantiles(df, ["key"], "v", [0.0, 0.1, 0.5, 1.0], small=small, buckets=buckets)
    assert {(r["key"], r["n"], float(r["prob"]), r["v"]) for r in got.collect()} == brute_ranks(pairs, [0.0, 0.1, 0.5, 1.0])
    assert selection.key_quantiles(df.where("false"), ["key"], "v", [0.5]).collect() == []


def test_heavy_keys_equal_brute_force(spark):
    rng = random.Random(2)
    data = [("a", f"x{int(rng.paretovariate(0.6)) % 500}") for _ in range(3000)] + [("b", "y")] * 3 + [("b", None)] * 97 + [("c", "z"), (None, "q")]
    df = spark.createDataFrame(data, "g string, k string")
    total = collections.Counter(g for g, _ in data)
    want = {(g, k, n) for (g, k), n in collections.Counter(data).items() if k is not None and n >= 0.02 * total[g]}
    assert {tuple(r) for r in selection.heavy_keys(df, "g", "k", 0.02).collect()} == want
    assert selection.heavy_keys(df.where("false"), "g", "k", 0.02).collect() == []


# p3: orphans


@pytest.mark.parametrize("hot", [500_000, 20])
def test_orphans_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ranking, "HOT_ROWS", hot)  # with 20 the key of half the references is split
    rng = random.Random(4)
    from datetime import datetime, timedelta

    day = lambda n: None if n is None else datetime(2012, 1, 1) + timedelta(days=n)
    maybe = lambda n: None if rng.random() < 0.1 else n
    parents = [("t", f"k{rng.randint(0, 12)}", maybe(s := rng.randint(0, 300)), None if rng.random() < 0.4 else s + rng.randint(0, 90)) for _ in range(40)]
    refs = [("t", i, None if i % 25 == 0 else "k0" if rng.random() < 0.5 else f"k{rng.randint(0, 15)}", maybe(rng.randint(0, 400))) for i in range(600)]
    refs += refs[:50]

    def case(r):
        _, i, k, at = r
        mine = [p for p in parents if p[1] == k]
        if any(at is not None and p[2] is not None and p[2] <= at and (p[3] is None or p[3] > at) for p in mine):
            return None
        state = "missing" if not mine else "late" if any(at is not None and p[2] is not None and p[2] > at for p in mine) else "deleted"
        return ("t", i, day(at).strftime("%Y-%m") if at is not None else None, state)

    want = {c for r in refs if r[2] is not None and (c := case(r))}
    rdf = spark.createDataFrame([(t, i, k, day(a), 0) for t, i, k, a in refs], "tab string, rec_id bigint, key string, at timestamp_ntz, _kind int")
    pdf = spark.createDataFrame([(t, k, day(a), day(b), 0) for t, k, a, b in parents], "tab string, key string, valid_from timestamp_ntz, valid_to timestamp_ntz, _to int")
    got = orphans.find_orphans(rdf, pdf)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    assert orphans.find_orphans(rdf.where("false"), pdf).collect() == []
    assert {r["state"] for r in orphans.find_orphans(rdf, pdf.where("false")).collect()} == {"missing"}


def test_orphans_of_one_key_at_one_time(spark, monkeypatch):
    """All references have the same key and one of three times, null among them; they are split by their ids."""
    from datetime import datetime

    monkeypatch.setattr(ranking, "HOT_ROWS", 30)
    at = [datetime(2012, 5, 1), datetime(2012, 7, 1), None]
    refs = spark.createDataFrame([("t", i, "k", at[i % 3]) for i in range(300)], "tab string, rec_id bigint, key string, at timestamp_ntz")
    parents = spark.createDataFrame([("t", "k", at[0], at[1])], "tab string, key string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    got = {(r["rec_id"], r["state"]) for r in orphans.find_orphans(refs, parents).collect()}
    assert got == {(i, "deleted") for i in range(300) if i % 3}


# graph


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, ["x"]) for a, b in pairs], "src string, dst string, labels array<string>")


def test_redirects_and_regrouping(spark):
    links = spark.createDataFrame([("P", "A", ["u"]), ("P", "B", ["v"]), ("P", None, None)], "src string, dst string, labels array<string>")
    red = spark.createDataFrame([("B", "A"), ("B", "A"), ("A2", "B")], "src string, dst string")
    fixed = L.resolve_redirects(links, red)
    assert fixed.where("fixed").count() == 1
    assert rows(L.regroup(fixed)) == sorted([("P", "A", ["u", "v"]), ("P", None, [])], key=repr)
    chain = spark.createDataFrame([("B", "C"), ("C", "D")], "src string, dst string")
    link = edges(spark, [("x", "B")])
    assert L.resolve_redirects(link, chain).first()["dst"] == "C" and L.resolve_redirects(link, chain, 2).first()["dst"] == "D"


def test_adjacency(spark):
    e = edges(spark, [("a", "b"), ("a", "b"), ("c", "b"), ("d", "b")])
    assert rows(L.adjacency(e)) == [("a", 0, ["b"]), ("c", 0, ["b"]), ("d", 0, ["b"])]
    assert rows(L.adjacency(e, "dst", "src", chunk=2)) == [("b", 0, ["a", "c"]), ("b", 1, ["d"])]


@pytest.mark.parametrize("group, hot", [([], 500_000), (["g"], 500_000), (["g"], 10), (["g"], 1)])
def test_ranks_equal_brute_force(spark, monkeypatch, group, hot):
    monkeypatch.setattr(ranking, "HOT_ROWS", hot)
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, v int, x int").repartition(7)
    got = ranking.running_within(df, group, ["v"], total=("sum", F.col("x")), most=("max", F.col("x")), rank=("sum", F.lit(1))).collect()
    seen = collections.defaultdict(lambda: [0, 0, -1])
    want = set()
    for g, v, x in sorted(data, key=lambda r: r[1]):
        s = seen[g if group else ""]
        s[0] += 1
        s[1] += x
        s[2] = max(s[2], x)
        want.add((g, v, x, s[1], s[2], s[0]))
    assert {tuple(r) for r in got} == want
    ranked = ranking.rank_within(df, group, ["v"]).collect()
    assert {(r["g"], r["v"], r["rank"]) for r in ranked} == {(w[0], w[1], w[5]) for w in want}
    assert ranking.rank_within(df.where("false"), group, ["v"]).collect() == []


def test_walks(spark):
    graph = {"a": [("b", 1.0)]}
    assert walk.walk("a", lambda n: graph.get(n, []), 0.5, 0.001) == {"a": 0.5, "b": 0.25}
    demo = {"a": [("b", 1.0), ("c", 1.0)], "b": [("a", 1.0)], "c": [("b", 1.0)]}
    score = walk.walk("a", lambda n: demo.get(n, []), 0.1, 0.01)
    assert set(score) == {"a", "b", "c"} and 0.8 < sum(score.values()) <= 1
    once = walk.walk("a", lambda n: demo.get(n, []), 0.1, 0.01, reenter=False)
    assert once["a"] == pytest.approx(0.1)
    e = edges(spark, [(a, b) for a, n in demo.items() for b, _ in n])
    starts = e.select(F.col("src").alias("start")).distinct()
    exact = {(r["start"], r["node"]): r["score"] for r in walk.exact_walks(e, starts, 0.5, 1e-7).collect()}
    level = {(r["start"], r["node"]): r["score"] for r in walk.level_walks(e, starts, 0.5, 1e-7).collect()}
    assert exact.keys() == level.keys() and all(abs(exact[k] - level[k]) < 1e-5 for k in exact)
    cases = spark.createDataFrame([("a", "b")], "start string, without string")
    assert {r["node"] for r in walk.exact_walks(e, cases, 0.5, 1e-4).collect()} == {"a", "c"}
    assert {r["node"] for r in walk.level_walks(e, cases, 0.5, 1e-4).collect()} == {"a", "c"}


@pytest.mark.parametrize("tol", [0.05, 1e-3, 1e-6])
def test_walks_are_the_same_at_any_size(spark, monkeypatch, tol):
    pairs = sorted({(f"n{i % 37}", f"n{(i * i + 3 * i) % 41}") for i in range(400)})
    late = [("s", x) for x in "abcd"] + [("a", "m"), ("b", "x"), ("x", "m"), ("m", "end")]  # m gets its weight in two steps
    e = edges(spark, pairs + late)
    starts = spark.createDataFrame([("n1", None), ("n2", "n3"), ("s", None), ("s", "x"), ("nowhere", None)], "start string, without string")
    for alpha, reenter in ((0.5, False), (0.1, True)):
        small = {(r["start"], r["without"], r["node"]): r["score"] for r in walk.exact_walks(e, starts, alpha, tol, reenter).collect()}
        with monkeypatch.context() as m:
            m.setattr(walk, "MOST_EDGES", 0)
            large = walk.exact_walks(e, starts, alpha, tol, reenter).collect()
        assert len(large) == len(small) and {(r["start"], r["without"], r["node"]): r["score"] for r in large} == small


def test_walks_reach_candidates_behind_hubs(spark, monkeypatch):
    e = edges(spark, [("s", f"p{i}") for i in range(100)] + [("p0", f"q{i}") for i in range(100)] + [("q0", "near")])
    ctx = scorers.Context(links=e, graph=e)
    cases = spark.createDataFrame([(1, 1, "dab", "x", "s")], "case_id int, class_id int, dab string, text string, src string")
    classes = spark.createDataFrame([(1, 0, "near"), (1, 1, "far")], "class_id int, class_idx int, member string")
    got = {n: {r["class_idx"]: r["score"] for r in scorers.SCORERS[n](ctx, cases, classes).collect()} for n in ("walk", "walk_radius")}
    assert got["walk"] == {0: pytest.approx(0.5 * 0.5**3 / 100**2), 1: 0}
    assert got["walk_radius"][0] > got["walk_radius"][1] == pytest.approx(-math.log(2))
    asked = []
    monkeypatch.setattr(graph, "Cases", lambda spark, d, **options: asked.append(options) or mock.MagicMock())
    graph.registry.queries["walk_scores"](spark, "")
    assert asked == [{}]


def test_every_document_enters_the_topic_model(spark):
    from pyspark.ml.linalg import SparseVector, VectorUDT
    from pyspark.sql.types import StructField, StructType

    rows = [(SparseVector(200, [(i, 1000.0)]),) for i in range(200)]
    data = spark.createDataFrame(rows, StructType([StructField("features", VectorUDT())]))
    words = lda.fit(data, 200, 2, 1, 0).topicsMatrix().toArray().sum(axis=1)
    assert words.min() > 20  # the word of a document left out stays near 2, where it began
    bags = spark.createDataFrame([(f"d{i}", f"w{i % 3}", 2) for i in range(9)], "doc string, term string, n int")
    got = lda.topic_vectors(bags, 2, 2).collect()
    assert {r["title"] for r in got} == {f"d{i}" for i in range(9)} and all(sum(r["vec"]) == pytest.approx(1) for r in got)
    assert lda.topic_vectors(bags.where("false"), 2, 2).collect() == []


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    at = lambda c, x, y: one(spark, c, a=x, b=y)
    assert at(vectors.l1(a, b), [0.5, 0.5], [0.9, 0.1]) == pytest.approx(0.8)
    assert at(vectors.irad(a, b), [0.5, 0.5], [0.5, 0.5]) == pytest.approx(-2 * math.log(2))
    assert at(vectors.kl(a, b), [0.0, 1.0], [0.5, 0.5]) == pytest.approx(math.log(2))
    assert at(vectors.kl(a, b), [0.5, 0.5], [0.0, 1.0]) == math.inf
    assert at(vectors.jaccard(a, b), [1, 2, 3], [2, 3, 4]) == 0.5


def test_tfidf(spark):
    bags = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "doc int, term string, n bigint")
    counts = spark.createDataFrame([("x", 3), ("y", 8)], "term string, df bigint")
    w = {r["term"]: r["w"] for r in similarity.tfidf(bags, counts, 8, scaled=False).collect()}
    assert w["x"] == pytest.approx(math.log(2)) and w["y"] == 0
    real = {r["term"]: r["w"] for r in similarity.tfidf(bags, counts, 8, idf="real").collect()}
    assert real["x"] == pytest.approx(1.0)


# Dirichlet, Good-Turing


def test_dirichlet_recovers_parameters():
    rng = np.random.default_rng(1)
    alpha = [1, 2, 3, 10, 0.2]
    lengths, cells = collections.Counter(), [collections.Counter() for _ in alpha]
    for _ in range(6000):
        n = int(rng.integers(20, 40))
        lengths[n] += 1
        for c, k in zip(cells, rng.multinomial(n, dirichlet.dirichlet(rng, alpha))):
            c[int(k)] += 1
    assert dirichlet.fit([1.0] * 5, lengths, cells) == pytest.approx(alpha, rel=0.06)


def test_symmetric_dirichlet_recovers_the_parameter():
    rng = np.random.default_rng(2)
    lengths, cells = collections.Counter(), collections.Counter()
    for _ in range(400):
        lengths[400] += 1
        cells.update(int(k) for k in rng.multinomial(400, dirichlet.dirichlet(rng, 0.33, 300)))
    assert dirichlet.fit_symmetric(1.0, 300, lengths, cells) == pytest.approx(0.33, rel=0.05)
    assert dirichlet.weighted_harmonic({3: 2}, 0.5) == pytest.approx(2 * (1 / 0.5 + 1 / 1.5 + 1 / 2.5))
    draws = collections.Counter(dirichlet.multinomial(rng, [1, 0, 3]) for _ in range(4000))
    assert draws[1] == 0 and abs(draws[2] / 4000 - 0.75) < 0.03


@pytest.mark.parametrize("mode", ["reference", "standard"])
def test_good_turing_sums_to_one(spark, mode):
    freqs = {1: 120, 2: 40, 3: 24, 4: 13, 5: 15, 6: 5, 7: 11, 10: 3, 12: 3, 26: 2}
    df = spark.createDataFrame(list(freqs.items()), "r bigint, n_r bigint")
    m = counting.good_turing(df, mode)
    assert m["p0"] == pytest.approx(120 / sum(r * n for r, n in freqs.items()))
    assert m["p0"] + sum(freqs[r] * p for r, p in m["p"].items()) == pytest.approx(1)
    assert counting.good_turing(df.where("false"))["p0"] == 0


# topic model


def small_state(spark):
    links = [("d1", 1, False, "A", "a"), ("d1", 2, True, "D", "a"), ("d1", 3, False, "B", "b"), ("d2", 1, True, "D", "b"), ("d2", 2, False, "A", "a"), ("d2", 3, True, "N", "n")]
    df = spark.createDataFrame(links * 1, "doc string, pos bigint, is_amb boolean, target string, text string")
    cands = spark.createDataFrame([("D", "A"), ("D", "B")], "key string, cand string")
    return df, cands


def test_sampler_keeps_rows_and_is_reproducible(spark):
    df, cands = small_state(spark)
    p = topics.Params(3)
    a = topics.train(df, cands, p, 3, seed=5, keep_rate=1)
    b = topics.train(df, cands, p, 3, seed=5, keep_rate=1)
    assert rows(a[0]) == rows(b[0])
    assert rows(a[0].select(*df.columns)) == rows(df)
    state = {(r["doc"], r["pos"]): r for r in a[0].collect()}
    assert all(0 <= r["topic"] < 3 for r in state.values())
    assert state["d2", 3]["sampled"] is None and state["d1", 2]["sampled"] in "AB"
    for t in (topics.posterior(a[0], cands, p), topics.average_samples(a[1]).withColumn("pos", F.col("dab"))):
        sums = t.groupBy("doc", "pos").agg(F.sum("p").alias("s")).collect()
        assert sums and all(abs(r["s"] - 1) < 1e-9 for r in sums)
    odd = spark.createDataFrame([("d1", 9, False, None, "a", 1, None), (None, 1, False, "A", "a", 0, None), ("d1", 8, True, "D", None, None, "A"), ("d3", 1, False, "A", None, 2, None)], topics.STATE)
    after = topics.sweep(a[0].unionByName(odd), cands, p, 1)
    assert after.count() == 10 and rows(after.where("topic IS NULL OR doc IS NULL OR target IS NULL")) == rows(odd.where("topic IS NULL OR doc IS NULL OR target IS NULL"))
    q = topics.refit(a[0], p)
    assert len(q.alpha) == 3 and q.beta > 0 and q.gamma > 0
    got = topics.infer(df.where("doc = 'd1'"), a[0], cands, p, sweeps=20).collect()
    assert {r["cand"] for r in got} == {"A", "B"} and sum(r["p"] for r in got) == pytest.approx(1)


# scorers and evaluation


def test_scorers(spark):
    links = spark.createDataFrame([("s", "D", "x"), ("s", "A", "x"), ("t", "A", "x"), ("t", "B", "y"), ("u", "A", "x"), ("D", "A", "a"), ("D", "B", "b")], "src string, dst string, text string")
    docs = spark.createDataFrame([("s", "red green"), ("A", "red blue"), ("B", "black white"), ("D", "x")], "title string, text string")
    vecs = spark.createDataFrame([("s", [0.9, 0.1]), ("A", [0.8, 0.2]), ("B", [0.1, 0.9])], "title string, vec array<double>")
    samples = spark.createDataFrame([("s", "D", "A", 0.75), ("s", "D", "B", 0.25)], "doc string, dab string, cand string, p double")
    none = "cast(array() as array<string>)"
    cases = spark.createDataFrame([(1, "D", "D", "s", "x", ["A"])], "case_id bigint, class_id string, dab string, src string, text string, new_links array<string>").withColumn("old_links", F.expr(none))
    classes = spark.createDataFrame([("D", 0, "A"), ("D", 1, "B")], "class_id string, class_idx int, member string")
    ctx = scorers.Context(links, docs, vecs, samples, options={"length": 2, "tol": 1e-4})
    for name, f in scorers.SCORERS.items():
        got = {r["class_idx"]: r["score"] for r in f(ctx, cases, classes).collect()}
        assert set(got) == {0, 1}, name
        if name not in ("svm", "tfidf_walk", "jaccard_walk", "out_links", "tfidf_in_links", "tfidf_plain", "relatedness", "walk_radius"):
            assert got[0] > got[1], name
    base = scorers.baseline(ctx, cases, classes)
    assert {r["class_idx"]: r["score"] for r in base.collect()} == {0: pytest.approx(4 / 6), 1: pytest.approx(2 / 6)}
    hits = evaluation.top_k_hits(evaluation.rank_classes(base), classes, cases)
    assert tuple(evaluation.accuracy(hits).first()) == (1, 1, 1.0)
    assert evaluation.accuracy(hits.where("false")).first()["accuracy"] == 0
    line = evaluation.svm_rank_lines(cases, classes, [base]).orderBy("line").first()["line"]
    assert line == "1 qid:1 1:0.666667 # s -> D -> A"


def test_cumulative_precision(spark):
    hits = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0), (3, 0.7, 1)], "case_id bigint, score double, correct int")
    assert [(r["n"], round(r["precision"], 6)) for r in evaluation.cumulative_precision(hits).orderBy("n").collect()] == [(1, 1.0), (2, 0.5), (3, 0.666667)]
    assert [r["case_id"] for r in evaluation.skip_cases(hits, 2).collect()] == [3]


def test_small_functions(spark):
    assert one(spark, text.escape_basic(F.col("c")), c="<a & 'b'>") == "&lt;a &amp; &apos;b&apos;&gt;"
    assert one(spark, text.unescape_basic(F.col("c")), c="&lt;a &amp;amp; &#39;b") == "<a &amp; 'b"
    assert one(spark, text.quote_escaped(F.col("c")), c='a"\\') == 'a\\"\\\\'
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate("abcd")] + [("g", 0, "x"), ("g", 1, "y")], "file string, pos bigint, value string")
    assert rows(counting.line_trigrams(lines)) == [("f", "a", "b", "c"), ("f", "b", "c", "d")]
    e = edges(spark, [("s", "D"), ("s", "A"), ("t", "A"), ("u", "D")])
    dabs = spark.createDataFrame([("D", None)], "title string, template string")
    assert rows(L.neighbour_features(e, dabs)) == [("D", "s", "A", "s"), ("D", "s", "A", "t")]
    a = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "k string, v double")
    assert scorers.sparse_kl(a, a, "k", "v") == pytest.approx(0) and scorers.sparse_kl(a, a.where("k = 'x'"), "k", "v") == math.inf


def test_skewed_join_equals_plain_join(spark, monkeypatch):
    from graphloom.operators import skew

    monkeypatch.setattr(skew, "LEAST_HOT", 3)
    monkeypatch.setattr(skew, "HOT_KEYS", 4)
    left = spark.createDataFrame([(f"k{i % 7}" if i % 2 else "hot", i) for i in range(60)] + [(None, 99)], "k string, v int")
    right = left.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    assert rows(skew.skewed_join(left, right, "k", "n", 60).select("k", "v", "n")) == rows(left.join(right, "k").select("k", "v", "n"))


def test_classifier(spark):
    docs = spark.createDataFrame([(1, "a b c a b c a b c a b d"), (2, "x y z x y z x y z x y w"), (3, ""), (4, None)], "id int, text string")
    got = {r["doc"]: r["label"] for r in counting.classify(docs.where("id <= 4"), docs.where("id = 1"), docs.where("id = 2"), "id", "text", mode="standard").collect()}
    assert got == {1: "First", 2: "Second", 3: "same", 4: "same"}


def shuffled_rows(spark, act):
    """The rows that an action writes into shuffles."""
    sc = spark.sparkContext
    gateway, store = sc._gateway, sc._jsc.sc().statusStore()
    total = lambda: sum(s.shuffleWriteRecords() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)))
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = total()
    act()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


def test_baseline_of_hubs(spark):
    """A hub that is a member of many classes isn't expanded for each; members of a class share in-links."""
    e = spark.range(2000).select(F.concat(F.lit("s"), F.col("id")).alias("src"), F.lit("hub").alias("dst")).unionByName(spark.createDataFrame([("s1", "a"), ("x", "a")], "src string, dst string"))
    classes = spark.range(500).select(F.concat(F.lit("c"), F.col("id")).alias("class_id"), F.lit(0).alias("class_idx"), F.lit("hub").alias("member"))
    classes = classes.unionByName(spark.createDataFrame([("c0", 1, "a"), ("c0", 2, "none"), ("d", 0, "hub"), ("d", 0, "a"), ("d", 1, "a")], "class_id string, class_idx int, member string"))
    cases = spark.createDataFrame([(1, "c0"), (2, "d"), (3, "c1")], "case_id bigint, class_id string")
    got = []
    n = shuffled_rows(spark, lambda: got.extend(rows(scorers.baseline(scorers.Context(links=e, graph=e), cases, classes))))
    assert got == [(1, 0, pytest.approx(2000 / 2002)), (1, 1, pytest.approx(2 / 2002)), (1, 2, 0.0), (2, 0, pytest.approx(2001 / 2003)), (2, 1, pytest.approx(2 / 2003)), (3, 0, 1.0)]
    assert n < 50_000


def test_rows_once(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c"), (3, None)], "id int, v string")
    want = [(1, "a"), (2, "b"), (3, None), (None, "c")]
    assert rows(graph.once(df, "id")) == want
    assert rows(graph.once(df.where("v <> 'a'").unionByName(df.limit(0)), "id")) == [(2, "b"), (None, "c")]
    monkeypatch.setattr(graph, "MOST_REPEATED", 0)
    assert rows(graph.once(df, "id")) == want


@pytest.fixture(scope="module")
def hub_folder(spark, tmp_path_factory):
    """150 ambiguous pages list a hub to which 2000 pages link."""
    d = str(tmp_path_factory.mktemp("hubs"))
    n = lambda prefix: F.concat(F.lit(prefix), F.col("id"))
    link = lambda r, base, src, dst: r.select((F.col("id") + base).alias("link_id"), src.alias("src"), dst.alias("dst"), F.array(F.lit("Main"), dst).alias("labels"), F.lit("2012-01-01").cast("timestamp_ntz").alias("seen_at"))
    dabs = spark.range(150)
    parts = [link(spark.range(2000), 0, n("en:S"), F.lit("en:Hub")), link(dabs, 10_000, n("en:D"), F.lit("en:Hub")), link(dabs, 20_000, n("en:D"), n("en:C")), link(spark.range(150), 30_000, n("en:S"), n("en:D")), link(spark.range(1), 40_000, F.lit("en:S0"), F.lit("en:C0"))]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    all_.unionByName(parts[3]).write.parquet(f"{d}/links_raw.parquet")
    for name, columns in (("pages", "id bigint, language string, namespace_id int, title string"), ("namespaces", "lang string, ns_id int, name string"), ("revisions", "id bigint, page_id bigint, text string, saved_at timestamp_ntz")):
        spark.createDataFrame([], columns).write.parquet(f"{d}/{name}.parquet")
    dabs.select(n("en:D").alias("title"), F.lit(None).cast("string").alias("template")).write.parquet(f"{d}/dabs.parquet")
    return d


def hub_rows(spark, d, name):
    """What a query gives on ``hub_folder``, without 2000 rows for each class with the hub."""
    got = []
    assert shuffled_rows(spark, lambda: got.extend(graph.registry.queries[name](spark, d).collect())) < 100_000
    return got


def test_svm_scores_of_hubs(spark, hub_folder):
    assert len(hub_rows(spark, hub_folder, "svm_scores")) == 300


def test_weighted_combination_of_hubs(spark, hub_folder):
    got = sorted(tuple(r) for r in hub_rows(spark, hub_folder, "weighted_combination"))
    assert len(got) == 300 and sum(s for _, _, s in got) == pytest.approx(37.5, abs=1e-3)  # the labels lead to no class, so 0.25 of the first share


def test_roc_rows_of_hubs(spark, hub_folder):
    assert sum(r["correct"] for r in hub_rows(spark, hub_folder, "roc_rows")) == 150


def test_cumulative_precision_of_hubs(spark, hub_folder):
    assert sorted(map(tuple, hub_rows(spark, hub_folder, "cumulative_precision"))) == [(i + 1, 1.0) for i in range(150)]


def test_svm_rank_rows_of_hubs(spark, hub_folder):
    assert sum(r["line"].startswith("1 ") for r in hub_rows(spark, hub_folder, "svm_rank_rows")) == 151


def test_topk_accuracy_of_hubs(spark, hub_folder):
    assert list(map(tuple, hub_rows(spark, hub_folder, "topk_accuracy"))) == [(150, 150, 1.0)]


def test_neighbour_features_of_hubs(spark, hub_folder):
    """The edges are made once, from rows without their ids; each page that links to an ambiguous one has one pick."""
    got = []
    n = shuffled_rows(spark, lambda: got.extend(graph.neighbour_features(spark, hub_folder).collect()))
    assert {(r["dab"], r["src"], r["picked"], r["feature"]) for r in got if r["dab"] != "en:D0"} == {(f"en:D{i}", f"en:S{i}", "en:Hub", f) for i in range(1, 150) for f in [*(f"en:S{k}" for k in range(2000)), *(f"en:D{k}" for k in range(150))]}
    assert n < 4_000


def test_in_link_samples_of_hubs(spark):
    """A hub's in-links aren't joined to each class; a class takes the first of all its members' in-links."""
    e = spark.range(2000).select(F.concat(F.lit("s"), F.col("id")).alias("src"), F.lit("hub").alias("dst")).unionByName(spark.createDataFrame([(f"x{i}", "a") for i in range(9)], "src string, dst string"))
    classes = spark.range(500).select(F.concat(F.lit("c"), F.col("id")).alias("class_id"), F.lit(0).alias("class_idx"), F.lit("hub").alias("member"))
    classes = classes.unionByName(spark.createDataFrame([("d", 0, "hub"), ("d", 0, "a"), ("d", 1, "a")], "class_id string, class_idx int, member string"))
    cases = spark.createDataFrame([(1, "c0", "p"), (2, "d", "p")], "case_id bigint, class_id string, src string").withColumn("dab", F.lit("p"))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    first = sorted([*(f"s{i}" for i in range(2000)), *(f"x{i}" for i in range(9))], key=lambda s: (md5(s), s))[:5]
    docs = spark.createDataFrame([("p", "one two"), (first[4], "two three"), *((f"z{i}", f"w{chr(97 + i)}") for i in range(9))], "title string, text string")
    got = []
    n = shuffled_rows(spark, lambda: got.extend(rows(scorers.tfidf_in_links(scorers.Context(links=e, graph=e, docs=docs, options={"sample": 5}), cases, classes))))
    want = {r["title"]: r["sim"] for r in [{"title": x["b"], "sim": x["sim"]} for x in similarity.cosines(spark.createDataFrame([("p", first[4])], "a string, b string"), scorers.Context(docs=docs).weights()).collect()]}[first[4]]
    assert want > 0 and {(c, i): s for c, i, s in got}[(2, 0)] == pytest.approx(want) and {(c, i): s for c, i, s in got}[(2, 1)] == 0
    assert n < 50_000
