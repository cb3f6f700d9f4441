"""python -m graphloom STAGE ROOT [options]: one stage of the pipeline over the catalog at ROOT."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from graphloom.operators.scorers import SCORERS
from graphloom.operators.topics import Params
from graphloom.plans import pipeline as p


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="graphloom")
    stages = parser.add_subparsers(dest="stage", required=True)

    def stage(name: str, **options) -> None:
        s = stages.add_parser(name)
        s.add_argument("root")
        for o, how in options.items():
            s.add_argument(f"--{o.replace('_', '-')}", **how)

    integer, real, text = {"type": int}, {"type": float}, {}
    needed = {"required": True}
    stage("build_database", dumps=needed)
    stage("extract", templates={"nargs": "+", "default": ["disambig"]})
    for name in ("extract_plain_text", "fix_links", "simplify_links", "compress_links", "decompress_links", "generate_dab_lists", "index_link_text", "posterior", "generate_svm_training", "list_languages"):
        stage(name)
    stage("count", tokenizer={"default": "simple"})
    stage(
        "sample", topics={**integer, "default": 100}, alpha=real, beta={**real, "default": 0.02}, gamma={**real, "default": 0.02}, iterations={**integer, "default": 1000}, seed={**integer, "default": 0},
        by={"choices": ["target", "text"], "default": "target"}, keep_rate={**integer, "default": 10}, limit=integer, resume=integer,
    )
    stage("average", start={**integer, "default": 0}, end=integer)
    stage("random_walk", alpha={**real, "default": 0.95}, tol={**real, "default": 0.001})
    stage("run_lda", topics={**integer, "default": 100}, iterations={**integer, "default": 20})
    stage("save_lda", vectors=needed, skip_first={"action": "store_true"})
    stage("print_plain_text", out=needed)
    for name in ("generate_evaluation", "generate_link_text_evaluation"):
        stage(name, newer=needed)
    scorer_options = {"tol": real, "alpha": real, "combine": text, "tokenizer": text, "divergence": text, "sample": integer, "bayes": {"action": "store_true"}, "neighbors": {"action": "store_true"}}
    stage("evaluate", scorer={**needed, "choices": sorted(SCORERS)}, top={**integer, "default": 1}, skip={**integer, "default": 0}, roc=text, **scorer_options)
    for name in ("write_scores", "write_svm_rank"):
        stage(name, scorers={**needed, "nargs": "+", "choices": sorted(SCORERS)}, out=needed, **scorer_options)
    stage("class_counts", dab=text, text=text)
    stage("show", relation=needed, key=needed, values={**needed, "nargs": "+"}, prefix={"action": "store_true"})
    a = parser.parse_args(argv)
    given = {k: v for k in scorer_options if (v := getattr(a, k, None))}
    spark = SparkSession.builder.appName(f"graphloom {a.stage}").getOrCreate()
    c = p.Catalog(spark, a.root)
    run = {
        "build_database": lambda: p.build_database(c, a.dumps),
        "extract": lambda: p.extract(c, a.templates),
        "count": lambda: p.count(c, a.tokenizer),
        "sample": lambda: p.sample(c, Params(a.topics, [a.alpha] * a.topics if a.alpha else [], a.beta, a.gamma), a.iterations, a.seed, a.by, a.keep_rate, a.limit, a.resume) and None,
        "average": lambda: p.average(c, a.start, a.end),
        "random_walk": lambda: p.random_walk(c, a.alpha, a.tol),
        "run_lda": lambda: p.run_lda(c, a.topics, a.iterations),
        "save_lda": lambda: p.save_lda(c, a.vectors, a.skip_first),
        "print_plain_text": lambda: p.print_plain_text(c, a.out),
        "generate_evaluation": lambda: p.generate_evaluation(c, p.Catalog(spark, a.newer)),
        "generate_link_text_evaluation": lambda: p.generate_link_text_evaluation(c, p.Catalog(spark, a.newer)),
        "evaluate": lambda: p.evaluate(c, a.scorer, a.top, a.skip, a.roc, **given),
        "write_scores": lambda: p.write_scores(c, a.scorers, a.out, **given),
        "write_svm_rank": lambda: p.write_svm_rank(c, a.scorers, a.out, **given),
        "class_counts": lambda: p.class_counts(c, a.dab, a.text),
        "show": lambda: p.show(c, a.relation, a.key, a.values, a.prefix),
    }
    shown = run.get(a.stage, lambda: getattr(p, a.stage)(c))()
    if shown is not None:
        for row in shown.toLocalIterator():  # asked for by a person
            print(*["" if v is None else v for v in row], sep="\t")


if __name__ == "__main__":
    main()
