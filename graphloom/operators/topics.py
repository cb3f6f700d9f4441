"""A topic model over links that picks the meaning of ambiguous ones.

State rows are the links of documents: ``doc``, ``pos``, ``is_amb``, ``target``, ``text``,
``topic``, ``sampled``; an ambiguous link's word is its sampled candidate, another's its
target. A sweep draws each row's topic and each ambiguous row's candidate from counts
of the sweep before (approximate distributed sampling). Counts are joined to the
rows that need them; only the totals of the topics are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.dirichlet import fit, fit_symmetric
from graphloom.session import cut, discard

#: Rows of one document that are sampled in turn; longer documents are dealt to several tasks.
BLOCK = 5000


@dataclass
class Params:
    topics: int = 100
    alpha: list[float] = field(default_factory=list)
    beta: float = 0.02
    gamma: float = 0.02

    def __post_init__(self) -> None:
        self.alpha = list(self.alpha) or [0.02] * self.topics


def word() -> Column:
    return F.when(F.col("is_amb"), F.col("sampled")).otherwise(F.col("target"))


def assigned(state: DataFrame) -> DataFrame:
    """The rows that count, with their word ``w``: those without a document or a topic are left
    out, and ambiguous links without a candidate."""
    return state.withColumn("w", word()).where("w IS NOT NULL AND doc IS NOT NULL AND topic IS NOT NULL")


def article_topics(state: DataFrame) -> DataFrame:
    return assigned(state).groupBy("w", "topic").agg(F.count("*").alias("n"))


def article_texts(state: DataFrame) -> DataFrame:
    return assigned(state).groupBy("w", "text").agg(F.count("*").alias("n"))


def document_topics(state: DataFrame) -> DataFrame:
    return assigned(state).groupBy("doc", "topic").agg(F.count("*").alias("n"))


def topic_totals(state: DataFrame) -> DataFrame:
    return assigned(state).groupBy("topic").agg(F.count("*").alias("n"))


def vocabulary(state: DataFrame) -> tuple[int, int]:
    """The numbers of distinct words and of distinct texts."""
    r = assigned(state).agg(F.count_distinct("w"), F.count_distinct("text")).first()
    return r[0], r[1]


def sparse_vectors(state: DataFrame) -> DataFrame:
    """``w``, ``counts``: the topics of each word as (n, topic), by count and then topic descending."""
    return article_topics(state).groupBy("w").agg(F.sort_array(F.collect_list(F.struct("n", "topic")), asc=False).alias("counts"))


def packing(topics: int) -> tuple[int, int, int]:
    """Shift, multiplier and mask that pack a count and a topic below ``topics`` into one number."""
    shift = max(topics, 1).bit_length() if topics & (topics - 1) else max(topics.bit_length() - 1, 0)
    return shift, 1 << shift, (1 << shift) - 1


def packed(n: Column, topic: Column, topics: int) -> Column:
    """Count and topic in one bigint that sorts by count and then topic."""
    return F.shiftleft(n.cast("bigint"), packing(topics)[0]).bitwiseOR(topic.cast("bigint"))


def unpacked(c: Column, topics: int) -> tuple[Column, Column]:
    shift, _, mask = packing(topics)
    return F.shiftrightunsigned(c, shift), c.bitwiseAND(F.lit(mask).cast("bigint")).cast("int")


def top_candidates(probabilities: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` likeliest candidates of each link, ties in byte order."""
    w = Window.partitionBy("doc", "pos").orderBy(F.col("p").desc(), "cand")
    return probabilities.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topic_articles(state: DataFrame, more_than: int = 10) -> DataFrame:
    """``topic``, ``article``, ``n``: articles with more than so many rows in a topic."""
    return article_topics(state).where(F.col("n") > more_than).select("topic", F.col("w").alias("article"), "n")


def top_articles(counts: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` most frequent articles of each topic, ties in byte order."""
    w = Window.partitionBy("topic").orderBy(F.col("n").desc(), "article")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def length_histograms(state: DataFrame) -> DataFrame:
    """``kind``, ``value``, ``freq``: how often documents, topics, articles and the cells of a
    document or an article and a topic have each number of rows."""
    parts = {"doc": ["doc"], "topic": ["topic"], "article": ["w"], "doc_topic": ["doc", "topic"], "article_topic": ["w", "topic"]}
    out = None
    for kind, by in parts.items():
        h = assigned(state).groupBy(*by).agg(F.count("*").alias("value")).groupBy("value").agg(F.count("*").alias("freq")).select(F.lit(kind).alias("kind"), "value", "freq")
        out = h if out is None else out.unionByName(h)
    return out


def candidate_rows(state: DataFrame, candidates: DataFrame, by: str = "target") -> DataFrame:
    """Ambiguous rows with each of their candidates ``cand``; ``candidates`` has ``key``, ``cand``,
    the key being the row's ``by``: its target, or its text."""
    c = candidates.select(F.col("key").alias("_key"), "cand").distinct()
    rows = state.where("is_amb")
    return rows.join(c, rows[by] == c["_key"]).drop("_key")


def posterior(state: DataFrame, candidates: DataFrame, params: Params, by: str = "target", vocabulary_sizes: tuple[int, int] | None = None) -> DataFrame:
    """``doc``, ``pos``, ``cand``, ``p``: how likely each candidate of each ambiguous link is.

    The product of a topic part, the sum over topics of
    (n_dt + alpha_t) (n_at + beta) / (n_t + beta V), and a text part,
    (n_ax + gamma) / (n_a - 1 + gamma T), with the row's own assignment taken out of
    the counts, scaled to 1 over the row's candidates. Rows whose own candidate is
    null, for want of candidates, have none.
    """
    v, t = vocabulary_sizes or vocabulary(state)
    beta, gamma = F.lit(params.beta), F.lit(params.gamma)
    rows = candidate_rows(state.where("sampled IS NOT NULL"), candidates, by).select("doc", "pos", "cand", "text", F.col("topic").alias("z"), F.col("sampled").alias("a0"))
    at, dt, nt = article_topics(state), document_topics(state), topic_totals(state)
    ax = article_texts(state)
    a = at.groupBy("w").agg(F.sum("n").alias("_na"))
    alpha = F.array(*[F.lit(float(x)) for x in params.alpha])
    cells = rows.withColumn("topic", F.explode(F.sequence(F.lit(0), F.lit(params.topics - 1))))
    cells = cells.join(dt.withColumnRenamed("n", "_dt"), ["doc", "topic"], "left")
    cells = cells.join(at.select(F.col("w").alias("cand"), "topic", F.col("n").alias("_at")), ["cand", "topic"], "left")
    cells = cells.join(F.broadcast(nt.withColumnRenamed("n", "_nt")), "topic", "left")  # one row per topic
    own = (F.col("topic") == F.col("z")).cast("int")
    mine = own * (F.col("cand") == F.col("a0")).cast("int")
    zero = F.lit(0)
    part = (F.coalesce("_dt", zero) - own + F.get(alpha, F.col("topic"))) * (F.coalesce("_at", zero) - mine + beta) / (F.coalesce("_nt", zero) - own + beta * v)
    sums = cells.groupBy("doc", "pos", "cand", "text", "a0").agg(F.sum(part).alias("_topic"))
    sums = sums.join(ax.select(F.col("w").alias("cand"), "text", F.col("n").alias("_ax")), ["cand", "text"], "left").join(a.withColumnRenamed("w", "cand"), "cand", "left")
    fits = (F.coalesce("_ax", zero) - (F.col("cand") == F.col("a0")).cast("int") + gamma) / (F.coalesce("_na", zero) - 1 + gamma * t)
    scored = sums.select("doc", "pos", "cand", (F.col("_topic") * fits).alias("_s"))
    whole = Window.partitionBy("doc", "pos")
    return scored.select("doc", "pos", "cand", (F.col("_s") / F.sum("_s").over(whole)).alias("p"))


def average_samples(samples: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """``doc``, ``dab``, ``cand``, ``p``: how often each candidate was sampled over the iterations.

    ``samples`` are ambiguous rows with ``iteration``. Where a document links to the
    same page several times, the last position counts.
    """
    s = samples.where("is_amb AND sampled IS NOT NULL").where(F.col("iteration") >= start)
    s = s.where(F.col("iteration") <= end) if end is not None else s
    n = s.groupBy("doc", F.col("target").alias("dab"), "pos", F.col("sampled").alias("cand")).agg(F.count("*").alias("n"))
    last = n.groupBy(F.col("doc").alias("_doc"), F.col("dab").alias("_dab")).agg(F.max("pos").alias("_last"))
    n = n.join(last, (n["doc"] == last["_doc"]) & (n["dab"] == last["_dab"]) & (n["pos"] == last["_last"]))
    return n.select("doc", "dab", "cand", (F.col("n") / F.sum("n").over(Window.partitionBy("doc", "dab"))).alias("p"))


# Sampling

STATE = "doc string, pos bigint, is_amb boolean, target string, text string, topic int, sampled string"


def _draw(seed: int, *of) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr((seed, *of)).encode(), digest_size=8).digest(), "big"))


def initial(links: DataFrame, candidates: DataFrame, topics: int, seed: int = 0, by: str = "target") -> DataFrame:
    """State with topics and candidates drawn at random, the same for the same seed."""
    pick = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "doc", "pos"), F.lit(1 << 30)) / F.lit(1 << 30)
    c = candidates.groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.collect_set("cand")).alias("_all"))
    d = links.join(c, F.col("is_amb") & (links[by] == c["_key"]), "left")
    sampled = F.when(F.col("is_amb"), F.try_element_at("_all", (F.floor(pick("target") * F.size("_all")) + 1).cast("int")))
    return d.select("doc", F.col("pos").cast("bigint").alias("pos"), "is_amb", "target", "text", F.floor(pick("topic") * topics).cast("int").alias("topic"), sampled.alias("sampled"))


def _vector(pairs, size: int) -> np.ndarray:
    v = np.zeros(size)
    if pairs is not None:
        for p in pairs:
            v[p["topic"]] = p["n"]
    return v


def _with_counts(state: DataFrame, counts: DataFrame, candidates: DataFrame, by: str) -> DataFrame:
    """State rows with the counts that drawing them needs; ``counts`` is the state counted."""
    pair = F.collect_list(F.struct("topic", "n"))
    at = article_topics(counts).groupBy("w").agg(pair.alias("at"), F.sum("n").alias("na"))
    dt = document_topics(counts).groupBy(F.col("doc").alias("_doc")).agg(pair.alias("dt"))
    ax = article_texts(counts).select(F.col("w").alias("_w"), F.col("text").alias("_x"), F.col("n").alias("ax"))
    c = candidate_rows(state, candidates, by).select("doc", "pos", "cand", "text")
    c = c.join(at.withColumnRenamed("w", "_cand"), F.col("cand") == F.col("_cand"), "left").join(ax, (F.col("cand") == F.col("_w")) & (F.col("text") == F.col("_x")), "left")
    c = c.groupBy(F.col("doc").alias("_d"), F.col("pos").alias("_p")).agg(F.array_sort(F.collect_list(F.struct("cand", "at", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("ax", F.lit(0)).alias("ax"))), lambda x, y: F.when(x["cand"] < y["cand"], -1).otherwise(1)).alias("cands"))
    rows = state.withColumn("w", word())
    rows = rows.join(at.select(F.col("w").alias("_a"), "at"), rows["w"] == F.col("_a"), "left").join(dt, rows["doc"] == F.col("_doc"), "left")
    return rows.join(c, (rows["doc"] == F.col("_d")) & (rows["pos"] == F.col("_p")), "left").select("doc", "pos", "is_amb", "target", "text", "topic", "sampled", "w", "at", "dt", "cands")


def _topic_step(alpha, beta, v, nt, dt, at, z, rng, own: bool) -> int:
    t = nt.copy()
    a = at.copy()
    if own:
        t[z] -= 1
        a[z] -= 1
    p = (alpha + dt) * (beta + np.maximum(a, 0)) / (beta * v + np.maximum(t, 0))
    c = np.cumsum(p)
    return int(min(np.searchsorted(c, rng.random() * c[-1], side="right"), len(c) - 1))


def _target_step(cands, z, current, beta, gamma, t, rng, own: bool) -> str:
    p = []
    for c in cands:
        mine = 1 if own and c["cand"] == current else 0
        az = next((x["n"] for x in (c["at"] if c["at"] is not None else ()) if x["topic"] == z), 0) - mine
        p.append((max(c["ax"] - mine, 0) + gamma) / (max(c["na"] - mine, 0) + gamma * t) * (max(az, 0) + beta))
    c = np.cumsum(p)
    return cands[int(min(np.searchsorted(c, rng.random() * c[-1], side="right"), len(c) - 1))]["cand"]


def sweep(state: DataFrame, candidates: DataFrame, params: Params, iteration: int, seed: int = 0, by: str = "target", sizes: tuple[int, int] | None = None) -> DataFrame:
    """The state after drawing every row once.

    Rows of a document are drawn one after the other, in blocks of about ``BLOCK``,
    with the document's counts kept up; all other counts are those before the sweep.
    """
    v, t = sizes or vocabulary(state)
    k = params.topics
    nt = np.zeros(k)
    for r in topic_totals(state).collect():  # one row per topic
        nt[r["topic"]] = r["n"]
    alpha, beta, gamma = np.array(params.alpha), params.beta, params.gamma
    rows = _with_counts(state, state, candidates, by)
    long = state.groupBy(F.col("doc").alias("_l")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    rows = rows.join(long, rows["doc"] == long["_l"], "left").withColumn("_block", F.pmod(F.xxhash64("pos"), F.coalesce("_blocks", F.lit(1)))).drop("_l", "_blocks")
    rows = rows.repartition("doc", "_block").sortWithinPartitions("doc", "_block", "pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, dt = None, None
        for b in batches:
            topics, sampled = [], []
            for r in b.itertuples(index=False):
                if current is None or (r.doc, r[-1]) != current:
                    current, dt = (r.doc, r[-1]), _vector(r.dt, k)
                z, a = None if pd.isna(r.topic) else int(r.topic), r.sampled
                if z is not None and not pd.isna(r.w) and not pd.isna(r.doc):
                    rng = _draw(seed, iteration, r.doc, r.pos)
                    dt[z] -= 1
                    z = _topic_step(alpha, beta, v, nt, np.maximum(dt, 0), _vector(r.at, k), z, rng, True)
                    dt[z] += 1
                    if r.is_amb:
                        a = _target_step(r.cands, z, a, beta, gamma, t, rng, True)
                topics.append(z)
                sampled.append(a)
            out = b[["doc", "pos", "is_amb", "target", "text"]].copy()
            out["topic"], out["sampled"] = pd.array(topics, dtype="Int32"), sampled
            yield out

    return rows.mapInPandas(run, STATE)


def refit(state: DataFrame, params: Params) -> Params:
    """Parameters fitted to the state by Dirichlet fixed points over its histograms."""
    h: dict[str, dict[int, int]] = {}
    for r in length_histograms(state).collect():  # distinct counts only
        h.setdefault(r["kind"], {})[r["value"]] = r["freq"]
    per_topic: list[dict[int, int]] = [{} for _ in range(params.topics)]
    for r in document_topics(state).groupBy("topic", "n").agg(F.count("*").alias("f")).collect():
        per_topic[r["topic"]][r["n"]] = r["f"]
    texts = {r["n"]: r["f"] for r in article_texts(state).groupBy("n").agg(F.count("*").alias("f")).collect()}
    v, t = vocabulary(state)
    alpha = [max(a, 1e-6) for a in fit(params.alpha, h.get("doc", {}), per_topic)]
    return Params(params.topics, alpha, fit_symmetric(params.beta, max(v, 1), h.get("topic", {}), h.get("article_topic", {})) or params.beta, fit_symmetric(params.gamma, max(t, 1), h.get("article", {}), texts) or params.gamma)


def train(links: DataFrame, candidates: DataFrame, params: Params, iterations: int, seed: int = 0, keep_rate: int = 10, refit_from: int = 50, by: str = "target", state: DataFrame | None = None, after: int = 0, keep: Callable[[int, DataFrame, Params], None] | None = None) -> tuple[DataFrame, DataFrame, Params]:
    """The last state, the kept samples with ``iteration``, and the parameters.

    Every state is written to the shared folder and removed when the next one is there; of every
    ``keep_rate``-th one the ambiguous rows are kept and ``keep`` is called, and from ``refit_from`` on the
    parameters are fitted at each tenth. With ``state``, that of iteration ``after``, the training goes on from
    there as if it had never stopped.
    """
    state = cut(initial(links, candidates, params.topics, seed, by) if state is None else state)
    sizes, kept = vocabulary(state), None
    for i in range(after + 1, iterations + 1):
        before, state = state, cut(sweep(state, candidates, params, i, seed, by, sizes))
        discard(before)
        if i >= refit_from and i % 10 == 0:
            params = refit(state, params)
        if i % keep_rate == 0 or i == iterations:
            s = cut(state.where("is_amb").withColumn("iteration", F.lit(i)))
            kept = s if kept is None else kept.unionByName(s)
            if keep is not None:
                keep(i, state, params)
    if kept is None:
        kept = state.where("is_amb").withColumn("iteration", F.lit(0))
    return state, kept, params


def infer(requests: DataFrame, model: DataFrame, candidates: DataFrame, params: Params, sweeps: int = 1000, seed: int = 0, by: str = "target") -> DataFrame:
    """``doc``, ``pos``, ``cand``, ``p``: the candidates of new documents' ambiguous links under
    the frozen counts of a model.

    ``requests`` are links as for ``initial``, a document being one request. Each is
    drawn ``sweeps`` times on its own; the model never changes.
    """
    v, t = vocabulary(model)
    k = params.topics
    nt = np.zeros(k)
    for r in topic_totals(model).collect():
        nt[r["topic"]] = r["n"]
    alpha, beta, gamma = np.array(params.alpha), params.beta, params.gamma
    state = initial(requests, candidates, k, seed, by)
    rows = _with_counts(state, model, candidates, by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        rng = _draw(seed, pdf["doc"].iloc[0])
        z, a = pdf["topic"].to_list(), pdf["sampled"].to_list()
        amb, cands = pdf["is_amb"].to_list(), pdf["cands"].to_list()
        at = [_vector(x, k) for x in pdf["at"]]
        by_cand = [{c["cand"]: _vector(c["at"], k) for c in x} if x is not None else {} for x in cands]
        live = [i for i in range(len(z)) if not amb[i] or cands[i] is not None]
        dt = np.zeros(k)
        for i in live:
            dt[z[i]] += 1
        for _ in range(sweeps):
            for i in live:
                dt[z[i]] -= 1
                z[i] = _topic_step(alpha, beta, v, nt, dt, by_cand[i].get(a[i], at[i]) if amb[i] else at[i], z[i], rng, False)
                dt[z[i]] += 1
                if amb[i]:
                    a[i] = _target_step(cands[i], z[i], a[i], beta, gamma, t, rng, False)
        out = []
        for i in live:
            if amb[i]:
                dt[z[i]] -= 1
                s = [float(((dt + alpha) * (by_cand[i][c["cand"]] + beta) / (nt + beta * v)).sum()) * (c["ax"] + gamma) / (c["na"] + gamma * t) for c in cands[i]]
                dt[z[i]] += 1
                out += [(pdf["doc"].iloc[0], pdf["pos"].iloc[i], c["cand"], x / sum(s)) for c, x in zip(cands[i], s)]
        return pd.DataFrame(out, columns=["doc", "pos", "cand", "p"])

    return rows.groupBy("doc").applyInPandas(run, "doc string, pos bigint, cand string, p double")
