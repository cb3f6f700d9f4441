"""The pipeline over a small dump, readers, sinks, streams and the entry module."""

import bz2


import pytest
from pyspark.sql import functions as F

from graphloom.operators import topics
from graphloom.plans import pipeline as p
from graphloom.sources import dump
from graphloom.streaming.links import read_stream, run_available, windowed_targets

PAGES = {
    "Mercury": "{{disambig}}\n* [[Mercury (planet)]], first\n* [[Mercury (metal)|the metal]]\n* [[Quicksilver]]",
    "Mercury (planet)": "A [[planet]] near the [[sun]].<!-- [[no]] -->",
    "Mercury (metal)": "A [[metal]] that is [[liquid]].",
    "Quicksilver": "#REDIRECT [[Mercury (metal)]]",
    "Sun": "The [[sun]] has the [[Mercury|innermost]] planet, see [[Category:Stars]] and [[:Category:Suns]] and [[de:Sonne]].",
    "Thermometer": "Made of [[Mercury]] or [[quicksilver]]. {{cite|{{x}}}}",
    "Talk:Sun": "[[/Archive]] by [[User:X]]",
}


def write_dump(folder, pages, lang="en"):
    body = "".join(f"<page><title>{t}</title><revision><text>{x.replace('&', '&amp;').replace('<', '&lt;')}</text></revision></page>\n" for t, x in pages.items())
    site = '<siteinfo><namespaces><namespace key="0" /><namespace key="1">Talk</namespace><namespace key="14">Category</namespace></namespaces></siteinfo>'
    (folder / f"{lang}wiki-20120101-pages-articles.xml.bz2").write_bytes(bz2.compress(f"<mediawiki>{site}\n{body}</mediawiki>".encode()))


@pytest.fixture(scope="module")
def catalogs(spark, tmp_path_factory):
    out = []
    for name in ("old", "new"):
        root = tmp_path_factory.mktemp(name)
        pages = dict(PAGES)
        if name == "new":
            pages["Thermometer"] = "Made of [[Mercury (planet)|Mercury]] or [[quicksilver]]."
        write_dump(root, pages)
        c = p.Catalog(spark, str(root / "catalog"))
        p.build_database(c, str(root))
        p.extract(c, ["disambig"])
        for stage in (p.extract_plain_text, p.fix_links, p.simplify_links, p.generate_dab_lists):
            stage(c)
        out.append(c)
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_extraction(catalogs):
    c = catalogs[0]
    assert rows(c.read("redirects")) == [("en:Quicksilver", "en:Mercury (metal)")]
    assert rows(c.read("dabs").select("title")) == [("en:Mercury",)]
    links = {(r["src"], r["dst"]): r["labels"] for r in c.read("links").collect()}
    assert links["en:Sun", "en:Mercury"] == ["innermost"] and links["en:Sun", "en:Category:Suns"] == [":Category:Suns"]
    assert ("en:Sun", "en:Category:Stars") not in links and not any("no" in d.lower().split(":")[-1].split() for _, d in links)
    fixed = {(r["src"], r["dst"]): r["labels"] for r in c.read("fixed_links").collect()}
    assert fixed["en:Thermometer", "en:Mercury (metal)"] == ["quicksilver"]
    assert fixed["en:Mercury", "en:Mercury (metal)"] == ["Quicksilver", "the metal"]
    assert rows(c.read("dab_lists")) == [("en:Mercury", "en:Mercury (metal)"), ("en:Mercury", "en:Mercury (planet)")]
    texts = dict(rows(c.read("plain_text")))
    assert texts["en:Thermometer"] == "Made of Mercury or quicksilver. " and "en:Quicksilver" not in texts and "en:Talk:Sun" not in texts


def test_model_and_evaluation(catalogs):
    c, newer = catalogs
    for stage in (p.compress_links, p.index_link_text, p.count, p.random_walk):
        stage(c)
    ids = [r["id"] for r in c.read("articles").orderBy("id").collect()]
    assert ids == list(range(1, len(ids) + 1)) and c.read("articles").orderBy("id").first()["name"] == "en:Mercury"
    p.sample(c, topics.Params(2), 3, keep_rate=1)
    assert c.read("samples").select("iteration").distinct().count() == 3
    p.run_lda(c, 2, 3)
    p.generate_evaluation(c, newer)
    case = c.read("cases").collect()
    assert [(r["dab"], r["src"], r["new_links"]) for r in case] == [] or case[0]["src"] == "en:Thermometer"
    assert p.evaluate(c, "baseline").first()["total"] == len(case)


def test_commands(catalogs, tmp_path, capsys):
    from graphloom.__main__ import main

    c, newer = catalogs
    run = lambda *a: (main([a[0], c.root, *a[1:]]), capsys.readouterr().out.splitlines())[1]
    run("decompress_links")
    assert rows(c.read("decompressed_links")) == rows(c.read("link_rows").select("doc", "pos", "is_amb", "target", "text"))
    links = {r["title"]: r for r in c.read("plain_text_links").where("hidden").collect()}
    assert links["en:Sun"]["display"] == "" and "Category" not in dict(rows(c.read("plain_text")))["en:Sun"].replace(":Category", "")
    assert run("show", "--relation", "pages", "--key", "title", "--values", "en:Merc", "--prefix")[0].startswith("en:Merc")
    assert run("show", "--relation", "out_links", "--key", "node", "--values", "en:Mercury (metal)")[0].split("\t")[0] == "en:Mercury (metal)"
    assert run("list_languages") == ["en"]
    assert [x.split("\t")[0] for x in run("class_counts", "--dab", "en:Mercury")] == ["en:Mercury (metal)", "en:Mercury (planet)"]
    assert run("class_counts", "--text", "sun") == ["en:Sun\t2"]
    run("print_plain_text", "--out", str(tmp_path / "bags"))
    assert all(r["value"].startswith("| ") for r in c.spark.read.text(str(tmp_path / "bags")).collect())
    run("generate_svm_training")
    (tmp_path / "v.txt").write_text("".join(f"{i} 0.5 0.5\n" for i in range(c.read("plain_text").count())))
    run("save_lda", "--vectors", str(tmp_path / "v.txt"), "--skip-first")
    assert rows(c.read("topic_vectors").select("vec").distinct()) == [([0.5, 0.5],)]
    run("generate_evaluation", "--newer", newer.root)
    n = c.read("cases").count()
    assert n == 1 and c.read("cases").first()["text"] == "mercury"
    assert run("evaluate", "--scorer", "baseline", "--roc", str(tmp_path / "roc"))[0].split("\t")[1] == str(n)
    assert [len(r["value"].split("\t")) for r in c.spark.read.text(str(tmp_path / "roc")).collect()] == [2] * n
    for _ in range(2):
        run("write_scores", "--scorers", "baseline", "link_text", "--out", str(tmp_path / "scores"))
    assert c.spark.read.json(str(tmp_path / "scores")).count() == 2 * n * 2
    run("write_svm_rank", "--scorers", "baseline", "--out", str(tmp_path / "svm"))
    assert c.spark.read.text(str(tmp_path / "svm")).first()["value"][1:7] == " qid:1"
    newer_index = p.index_link_text
    p.compress_links(newer)
    newer_index(newer)
    run("generate_link_text_evaluation", "--newer", newer.root)
    assert {r["class_id"] for r in c.read("cases").collect()} <= {r["class_id"] for r in c.read("classes").collect()}


def test_sampler_goes_on_where_it_stopped(catalogs, tmp_path):
    import os

    c = p.Catalog(catalogs[0].spark, str(tmp_path / "c"))
    for name in ("link_rows", "dab_lists", "label_index"):
        c.write(name, catalogs[0].read(name), *catalogs[0].read(name).columns[:1])
    p.sample(c, topics.Params(2), 4, keep_rate=2)
    whole = rows(c.read("state"))
    p.sample(c, topics.Params(2), 4, keep_rate=2, resume=2)
    assert rows(c.read("state")) == whole
    assert sorted(r["iteration"] for r in c.read("states").select("iteration").distinct().collect()) == [2, 4]
    p.average(c, 4, 4)
    assert all(r["p"] == 1 for r in c.read("sample_average").collect())
    p.posterior(c)
    assert all(0 < r["p"] <= 1 for r in c.read("sampler_results").collect())
    with pytest.raises(ValueError):
        p.sample(c, topics.Params(2), 1)
    d = p.Catalog(c.spark, str(tmp_path / "d"))
    for name in ("link_rows", "dab_lists", "label_index"):
        d.write(name, c.read(name), *c.read(name).columns[:1])
    p.sample(d, topics.Params(2), 1, by="text", limit=2)
    assert d.read("state").select("doc").distinct().count() == 2
    assert os.path.isdir(d.root + "/states/iteration=1")


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a 0.5 0.5\nb 1 0\n")
    labels = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "pos int, title string")
    assert rows(dump.read_vectors(spark, labels, str(tmp_path / "v.txt"), True)) == [("x", [0.5, 0.5]), ("y", [1.0, 0.0])]
    (tmp_path / "l.txt").write_text("en\n\nde\n")
    assert rows(dump.read_languages(spark, str(tmp_path / "l.txt"))) == [("de",), ("en",)]
    df = spark.range(10).withColumn("k", F.col("id").cast("string"))
    dump.write_sorted(df, str(tmp_path / "t"), "k")
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert rows(dump.lookup(stored, "k", "3", "7").select("id")) == [(3,), (7,)]
    with pytest.raises(Exception, match="exists"):
        dump.write_sorted(df, str(tmp_path / "t"), "k")
    names = dump.effective_namespaces(spark.createDataFrame([("en", 1, "Gespräch")], "lang string, ns_id int, name string"))
    got = {(r["ns_id"], r["name"]): r["main"] for r in names.collect()}
    assert got[1, "Gespräch"] and not got[1, "Talk"] and got[14, "Category"] and not got[6, "Image"]


def test_stream_equals_batch(spark, tmp_path):
    data = [(i % 90, "s", f"en: k{i % 90 % 4}", i % 90) for i in range(120)]
    df = spark.createDataFrame(data, "link_id bigint, src string, dst string, day int").withColumn("seen_at", F.expr("timestamp_ntz'2012-01-01 00:00:00' + make_dt_interval(day)")).drop("day")
    df.repartition(3).write.parquet(str(tmp_path / "links_raw.parquet"))
    got = run_available(windowed_targets(read_stream(spark, str(tmp_path), "links_raw"), late="3650 days"), ["begin", "dst"])
    assert got.agg(F.sum("n")).first()[0] == 90
    assert {r["dst"] for r in got.collect()} == {f"en:K{i}" for i in range(4)}


def test_sparse_counts(spark):
    assert [topics.packing(k) for k in (7, 8, 9)] == [(3, 8, 7), (3, 8, 7), (4, 16, 15)]
    seen = [3, 5, 7, 3, 4, 5, 5, 7, 5, 4, 2, 3, 4, 5, 6, 5, 5, 5]
    df = spark.createDataFrame([("d", i, False, "w", "x", t, None) for i, t in enumerate(seen)], topics.STATE)
    assert [tuple(s) for s in topics.sparse_vectors(df).first()["counts"]] == [(8, 5), (3, 4), (3, 3), (2, 7), (1, 6), (1, 2)]
    n, t = topics.unpacked(topics.packed(F.lit(6), F.lit(9), 10), 10)
    assert tuple(spark.range(1).select(n, t).first()) == (6, 9)


def test_entry_names_are_consistent():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "label_share_top1" in e.queries()
