"""Text operators on small tables: nulls, empties, repeated rows, clashing columns."""

import collections
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, frequent, leaks, markup, terms, truncation, wrappers

REVISIONS = "id bigint, page_id bigint, text string, n int, term string, _t string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def revisions(spark, texts):
    return spark.createDataFrame([(i, 0, t, 1, "x", "y") for i, t in texts], REVISIONS)


@pytest.mark.parametrize("repeated", [terms.MOST_REPEATED, 0])
def test_terms(spark, monkeypatch, repeated):
    monkeypatch.setattr(terms, "MOST_REPEATED", repeated)
    texts = [(1, "the cat the Cat ÄPFEL"), (1, "the cat the Cat ÄPFEL"), (2, "the dog"), (3, "the the bird cat"), (4, None), (5, ""), (None, "the x"), (None, "the x"), (None, "the y y")]
    df = revisions(spark, texts)
    docs = {k: t.lower().split() for k, t in [(1, texts[0][1]), (2, "the dog"), (3, texts[3][1]), (5, ""), ("a", "the x"), ("b", "the y y")]}
    n = terms.count_records(df, "id", "text")
    assert n == len(docs)
    counts = terms.record_terms(df, "id", "text").cache()
    d, c = collections.Counter(), collections.Counter()
    for w in docs.values():
        c.update(w)
        d.update(set(w))
    assert rows(terms.term_frequencies(counts)) == sorted(((t, c[t], d[t]) for t in c), key=repr)
    marks = {r["term"]: r["mark"] for r in terms.mark_frequencies(terms.term_frequencies(counts), n).collect()}
    assert marks["the"] == "common" and marks["dog"] == "rare" and marks["cat"] == "rare"
    w = {(r["id"], r["term"]): r["weight"] for r in terms.weigh_terms(counts, n).where("id IS NOT NULL").collect()}
    h = -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)) / math.log(n)
    assert w[1, "cat"] == pytest.approx(math.log(3) * (1 - h))
    best = terms.most_characteristic(terms.weigh_terms(counts, n, "count", "presence", 2)).where("id = 1").collect()
    assert best[0]["term"] == "cat"
    empty = terms.record_terms(df.where("false"), "id", "text")
    assert rows(terms.weigh_terms(empty, 0)) == []


def test_terms_tie_is_first_in_byte_order(spark):
    df = revisions(spark, [(1, "Z b"), (2, "b z"), (3, "q")])
    best = terms.most_characteristic(terms.weigh_terms(terms.record_terms(df, "id", "text"), 3, "count", "presence", 2))
    assert {r["id"]: r["term"] for r in best.collect()} == {1: "b", 2: "b"}


@pytest.mark.parametrize("buckets", [4, 64])
def test_top_values_are_exact_for_any_size_of_sketch(spark, buckets):
    keys = [f"k{i}" for i in range(300) for _ in range(1 + 600 // (i + 1))]
    df = spark.createDataFrame([("a", k, 0) for k in keys] + [("b", None, 0), ("b", "only", 0)], "field string, key string, code int").repartition(5)
    got = frequent.top_values(df, "field", "key", 10, buckets, 32)
    want = collections.Counter(keys)
    best = sorted(want, key=lambda k: (-want[k], k))[:10]
    assert {(r["group"], r["key"], r["n"]) for r in got.collect()} == {("a", k, want[k]) for k in best} | {("b", "only", 1)}
    assert all(r["low"] <= r["n"] <= r["high"] for r in got.collect())
    assert frequent.top_values(df.where("false"), "field", "key").collect() == []


def test_markup_pieces_once_per_record(spark):
    df = revisions(spark, [(1, "'''A'''\n== B ==\n* c\n* c"), (1, "'''A'''\n== B ==\n* c\n* c"), (2, None), (3, ""), (None, "'''x'''\n* d")])
    assert rows(markup.structured_pieces(df)) == sorted([(1, "heading", "B"), (1, "item", "c"), (None, "item", "d")], key=repr)
    assert rows(markup.clean_texts(df.where("id > 1"))) == [(2, None), (3, "")]


DOCS = "doc_id bigint, text string, lang string, source string, title string, item_id int, h string, stop string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, None, s, None, 0, "h", "s") for i, t, s in texts], DOCS)


@pytest.mark.skipif(not os.path.exists(bpe.vocabulary_path()), reason="vocabulary files are not here")
def test_encoded_texts(spark):
    df = documents(spark, [(1, "Hello world", None), (1, "Hello world", None), (2, None, None), (3, "", None)])
    assert rows(bpe.encode_texts(df, "doc_id", "text")) == sorted([(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])], key=repr)


def test_leaks(spark):
    items = spark.createDataFrame([(1, "s", "one two three"), (2, "s", " ".join(f"w{i}" for i in range(20))), (3, "s", None), (4, "s", ""), (1, "s", "one two three")], "item_id bigint, suite string, text string")
    df = documents(spark, [(1, "x One, TWO three y", None), (2, "a " + " ".join(f"W{i}" for i in range(3, 15)), None), (3, " ".join(f"w{i}" for i in range(3, 14)), None), (4, None, None), (5, "", None)])
    for words in (1, 1000):
        assert rows(leaks.find_leaks(df, items, block_words=words)) == [(1, 1), (2, 2)]
    assert rows(leaks.remove_leaks(df, items).where("doc_id = 1")) == [(1, "x y")]
    assert {r[0] for r in leaks.remove_leaks(df, items, "document").collect()} == {3, 4, 5}
    assert rows(leaks.find_leaks(df, items.where("false"))) == []
    w = [f"w{i}" for i in range(18)]
    both = spark.createDataFrame([(1, "s", " ".join(w[:12])), (2, "s", " ".join(w[6:]))], "item_id bigint, suite string, text string")
    overlapping = documents(spark, [(1, f"begin {' '.join(w)} end", None)])
    for size in (1, 1000):  # the items in two blocks, or in one
        assert rows(leaks.remove_leaks(overlapping, both, block_words=size)) == [(1, "begin end")]
    assert rows(leaks.find_leaks(df.where("false"), items)) == []


def test_longer_copies_equal_brute_force(spark):
    base = "".join(chr(97 + i * 7 % 26) for i in range(400))
    texts = [base[:n] for n in (63, 64, 65, 100, 128, 129, 255, 256, 400)] + [base[:100] + "X", base[:100], "é" + base[:90], "é" + base[:70], "z" * 70, "z" * 70, "a", base[:7], "short", "short!", "shorts", ""]
    got = {r["h"]: r["rest"] for r in truncation.longer_copies(documents(spark, [(i, t, None) for i, t in enumerate(texts)]), "text").collect()}
    hashed = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    assert set(got) == {hashed[t] for t in texts if t and any(u != t and u.startswith(t) for u in texts)}
    assert got[hashed[base[:256]]] == base[256:264]
    flags = {r["h"]: (r["word"], r["digit"], r["more"]) for r in truncation.longer_copies(documents(spark, [(i, t, None) for i, t in enumerate(texts)]), "text").collect()}
    assert flags[hashed["short"]] == (True, False, True)  # of both longer texts


def test_truncated(spark):
    text = "The council of the town kept a ledger of all its bridges and roads. It had 12.4 miles."
    df = documents(spark, [(1, text, "a"), (2, text[:-8], "a"), (3, text[:40], "a"), (4, None, None), (5, "", "b"), (6, "x.\n* " + "long entry of a list " * 5, "b"), (7, "x.\n* " + "long entry of a list " * 4 + "long ent", "b")])
    got = {r["id"]: (r["stop"], r["truncated"]) for r in truncation.text_stops(df).collect()}
    assert got == {1: ("sentence", False), 2: ("copy", True), 3: ("inside", True), 4: ("blank", False), 5: ("blank", False), 6: ("entry", False), 7: ("copy", True)}
    assert rows(truncation.truncation_by_source(truncation.text_stops(df))) == sorted([("a", 3, 2, 0.666667), (None, 0, 0, 0.0), ("b", 2, 1, 0.5)], key=repr)
    assert truncation.text_stops(df.where("false")).collect() == []
    short = documents(spark, [(1, "Small cut tex", "a"), (2, "Small cut text and more of it.", "a"), (3, "Sma", "a"), (4, "Small cut", "a")])
    assert {r["id"]: r["stop"] for r in truncation.text_stops(short).collect()} == {1: "copy", 2: "sentence", 3: "title", 4: "title"}


def test_own_content(spark):
    page = "<div><b>Menu</b></div><p>own {}</p>"
    df = spark.createDataFrame([(i, "h", page.format(i), 0) for i in range(20)] + [(98, "other", "<p>x", 0), (99, "h", None, 0), (97, None, "<p>y", 0)], "id bigint, host string, text string, tree int")
    got = dict(rows(wrappers.own_content(df.repartition(4), "id", "host", "text")))
    assert got == {**{i: f"own {i}" for i in range(20)}, 98: "x", 99: None, 97: "y"}
    assert wrappers.own_content(df.where("false"), "id", "host", "text").collect() == []


def test_own_content_counts_texts_exactly(spark):
    """The first page of each task lacks the footer, which 60 % have."""
    texts = [(i, "h", f"<p>own {i}</p><div>{'foot' if i % 5 > 1 else f'odd {i}'}</div>") for i in range(20)]
    want = {i: f"own {i}" if i % 5 > 1 else f"own {i}\nodd {i}" for i in range(20)}
    for parts in (1, 4):
        df = spark.createDataFrame(spark.sparkContext.parallelize(texts, parts), "id bigint, host string, text string")
        assert dict(rows(wrappers.own_content(df, "id", "host", "text"))) == want


@pytest.mark.parametrize("most", [wrappers.MOST_BYTES, 0])
def test_own_content_of_long_pages(spark, monkeypatch, most):
    """The first page fills a template by itself; what all later ones share comes after it."""
    monkeypatch.setattr(wrappers, "MOST_BYTES", most)
    pages = ["".join(f"<p>first {k}</p>" for k in range(30))] + [f"<table><tr><td>own {i}<td>shared</table>" + "".join(f"<h{k}>x{i}</h{k}><i{i}></i{i}>" for k in range(1, 4)) for i in range(1, 30)]
    df = spark.createDataFrame(spark.sparkContext.parallelize([(i, "h", x) for i, x in enumerate(pages)], 2), "id bigint, host string, text string")
    got = dict(rows(wrappers.own_content(df, "id", "host", "text")))
    assert got[0] == "\n".join(f"first {k}" for k in range(30))
    assert all(got[i] == "\n".join([f"own {i}", *[f"x{i}"] * 3]) for i in range(1, 30))


def test_own_content_is_the_same_in_any_order(spark):
    """A menu of 500 entries on nine of ten pages, and a host whose pages vary in structure."""
    rng = random.Random(8)
    menu = "<ul>" + "".join(f"<li>menu {k}</li>" for k in range(500)) + "</ul>"
    pages = [(0, "h", "<p>short</p>")] + [(i, "h", f"{menu}<p>own {i}</p>") for i in range(1, 10)]
    for i in range(10, 40):
        pages.append((i, "v", "".join(rng.choice(["<p>a</p>", "<div><b>b</b></div>", f"<i>x{i}</i>", "<p>c<b>d</b></p>"]) for _ in range(6))))
    results = []
    for order in range(3):
        rng.shuffle(pages)
        df = spark.createDataFrame(spark.sparkContext.parallelize(pages, 1 + 3 * order), "id bigint, host string, text string")
        results.append(dict(rows(wrappers.own_content(df, "id", "host", "text"))))
    assert results[0] == results[1] == results[2]
    assert results[0][0] == "short" and all(results[0][i] == f"own {i}" for i in range(1, 10))


@pytest.mark.parametrize("part, fan", [(256, 64), (4, 2)])
def test_own_content_has_its_template_from_all_pages(spark, monkeypatch, part, fan):
    """Most pages share a table that those with the smallest hashes lack; an entry that moves between its rows isn't template."""
    monkeypatch.setattr(wrappers, "PART", part, raising=False)
    monkeypatch.setattr(wrappers, "FAN", fan, raising=False)
    plain = [r["x"] for r in spark.range(1000).select(F.format_string("<p>own %d</p>", "id").alias("x")).orderBy(F.xxhash64("x")).limit(6).collect()]
    cells = [[f"no {i} {k}" if i % 3 != k else "yes" for k in range(3)] for i in range(12)]
    tables = ["<p>top</p><table><tr><td>head" + "".join(f"<tr><td>{c}" for c in row) + "</table>" for row in cells]
    df = spark.createDataFrame([(i, "h", x) for i, x in enumerate(tables + plain)], "id bigint, host string, text string")
    assert {r["id"] for r in df.orderBy(F.xxhash64("text")).limit(6).collect()} == set(range(12, 18))
    got = dict(rows(wrappers.own_content(df, "id", "host", "text")))
    assert got == {**{i: "\n".join(row) for i, row in enumerate(cells)}, **{12 + i: x[3:-4] for i, x in enumerate(plain)}}


def test_nesting_of_any_depth_keeps_its_texts(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after"
    df = spark.createDataFrame([(1, "h", deep), (2, "g", "x" * 100_000), (3, "g", "")], "id bigint, host string, text string")
    assert dict(rows(wrappers.own_content(df, "id", "host", "text"))) == {1: "deep\nafter", 2: "x" * 100_000, 3: ""}
