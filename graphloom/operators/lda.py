"""Topic vectors of documents by latent Dirichlet allocation."""

from __future__ import annotations

from pyspark.ml.clustering import LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

#: Terms of a model at most.
MOST_WORDS = 1_000_000


def fit(data: DataFrame, size: int, topics: int, iterations: int, seed: int) -> LocalLDAModel:
    """The online variational model of ``features``, vectors of ``size`` words; every iteration is a pass over all rows.

    ``pyspark.ml``'s estimator always draws its batches with replacement, so that even at a
    subsampling rate of 1 an iteration misses a good third of the rows. The optimizer
    below it can take each row once.
    """
    spark = data.sparkSession
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.spark.mllib.clustering, jvm.org.apache.spark.ml.clustering
    whole = old.OnlineLDAOptimizer().setMiniBatchFraction(1.0).setSampleWithReplacement(False).setOptimizeDocConcentration(True)
    rows = getattr(getattr(new, "LDA$"), "MODULE$").getOldDataset(data._jdf, "features")
    model = old.LDA().setK(topics).setMaxIterations(iterations).setSeed(seed).setOptimizer(whole).run(rows)
    return LocalLDAModel(new.LocalLDAModel("lda", size, model, spark._jsparkSession))


def topic_vectors(bags: DataFrame, topics: int = 100, iterations: int = 20, seed: int = 0, most_words: int = MOST_WORDS) -> DataFrame:
    """``title``, ``vec``: the topic distribution of each document of ``doc``, ``term``, ``n``; each
    iteration fits on all documents. A model has a column per term, at the driver too, so its vocabulary
    has a bound: the ``most_words`` terms in most documents, ties in byte order."""
    words = bags.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(most_words)
    vocabulary = sorted(r["term"] for r in words.collect())  # at most most_words
    docs = bags.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("term", "n"))).alias("_w"))
    each = docs.select("doc", F.flatten(F.transform("_w", lambda s: F.array_repeat(s["term"], s["n"].cast("int")))).alias("words"))
    if not vocabulary:
        return docs.select(F.col("doc").alias("title"), F.array().cast("array<double>").alias("vec"))
    counted = CountVectorizerModel.from_vocabulary(vocabulary, "words", "features").transform(each)
    data = cut(counted.select("doc", "features"))  # read again by each iteration
    model = fit(data, len(vocabulary), topics, iterations, seed)
    return model.transform(data).select(F.col("doc").alias("title"), vector_to_array("topicDistribution").alias("vec"))
