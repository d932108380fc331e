"""Classifiers: relational ones, and Spark ML behind one call."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.storage import shared_folder, written


def nb_fit(counts: DataFrame, labels: DataFrame, alpha: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """MDL-03: multinomial Bayes over (doc_id, term, tf): (label, term, logp) of seen pairs, (label, prior, unseen)."""
    by = counts.join(labels, "doc_id").groupBy("label", "term").agg(F.sum("tf").alias("n"))
    size = by.select("term").distinct().agg(F.count("*").alias("v"))
    prior = labels.groupBy("label").agg(F.count("*").alias("docs")).withColumn("prior", F.log(F.col("docs") / F.sum("docs").over(Window.partitionBy())))
    total = by.groupBy("label").agg(F.sum("n").alias("total")).crossJoin(F.broadcast(size))  # a row a class, one row
    classes = prior.join(total, "label").select("label", "prior", (F.log(F.lit(alpha)) - F.log(F.col("total") + alpha * F.col("v"))).alias("unseen"), (F.col("total") + alpha * F.col("v")).alias("_d"))
    logp = by.join(F.broadcast(classes), "label").select("label", "term", (F.log(F.col("n") + alpha) - F.log("_d")).alias("logp"))
    return logp, classes.drop("_d")


def bernoulli_fit(counts: DataFrame, labels: DataFrame, alpha: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """MDL-03: Bernoulli Bayes over (doc_id, term), for ``nb_score`` with every tf 1.

    A term's weight is the log-odds of a class's document to hold it; ``prior``
    also holds what a document without any term has.
    """
    by = counts.select("doc_id", "term").distinct().join(labels, "doc_id").groupBy("label", "term").agg(F.count("*").alias("n"))
    size = by.select("term").distinct().agg(F.count("*").alias("v"))
    docs = labels.groupBy("label").agg(F.count("*").alias("docs")).withColumn("prior", F.log(F.col("docs") / F.sum("docs").over(Window.partitionBy())))
    held = by.join(docs, "label").withColumn("p", (F.col("n") + alpha) / (F.col("docs") + 2 * alpha))
    lacking = held.groupBy("label").agg(F.sum(F.log(1 - F.col("p"))).alias("none"), F.count("*").alias("seen"))
    rare = F.lit(alpha) / (F.col("docs") + 2 * alpha)
    classes = docs.join(lacking, "label").crossJoin(F.broadcast(size))  # one row
    prior = F.col("prior") + F.col("none") + (F.col("v") - F.col("seen")) * F.log(1 - rare)
    return held.select("label", "term", (F.log("p") - F.log(1 - F.col("p"))).alias("logp")), classes.select("label", prior.alias("prior"), (F.log(rare) - F.log(1 - rare)).alias("unseen"))


def nb_score(counts: DataFrame, docs: DataFrame, model: tuple[DataFrame, DataFrame], vocabulary: DataFrame) -> DataFrame:
    """(doc_id, label, score): a known term that a class has not seen adds the class's ``unseen``."""
    logp, classes = model
    known = counts.join(vocabulary, "term")
    seen = known.join(logp, "term").groupBy("doc_id", "label").agg(F.sum(F.col("tf") * F.col("logp")).alias("s"), F.sum("tf").alias("k"))
    size = known.groupBy("doc_id").agg(F.sum("tf").alias("all"))
    every = docs.select("doc_id").crossJoin(F.broadcast(classes))  # a row a class
    out = every.join(seen, ["doc_id", "label"], "left").join(size, "doc_id", "left")
    rest = F.coalesce("all", F.lit(0)) - F.coalesce("k", F.lit(0))
    return out.select("doc_id", "label", (F.col("prior") + F.coalesce("s", F.lit(0.0)) + rest * F.col("unseen")).alias("score"))


def best_class(scores: DataFrame) -> DataFrame:
    """(doc_id, predicted): ties go to the smaller label."""
    return scores.groupBy("doc_id").agg(F.max_by("label", F.struct(F.round("score", 9), -F.col("label"))).alias("predicted"))


def centroids(vectors: DataFrame) -> DataFrame:
    """MDL-05: (label, dim, value) of (label, embedding)."""
    return vectors.select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("value"))


def nearest_centroid(vectors: DataFrame, of: DataFrame) -> DataFrame:
    """(vec_id, predicted): the class whose centroid is nearest; classes are few, so they are broadcast."""
    arrays = of.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda x: x.value).alias("c"))
    d = F.aggregate(F.zip_with("embedding", "c", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    far = vectors.select("vec_id", "embedding").crossJoin(F.broadcast(arrays)).select("vec_id", "label", F.round(d, 9).alias("d"))
    return far.groupBy("vec_id").agg(F.min_by("label", F.struct("d", "label")).alias("predicted"))


def _words(pattern: str) -> list:
    """Stages that split ``text`` into ``_words``; a null text has none."""
    from pyspark.ml.feature import RegexTokenizer, SQLTransformer

    return [SQLTransformer(statement="SELECT *, coalesce(text, '') AS _text FROM __THIS__"), RegexTokenizer(inputCol="_text", outputCol="_words", pattern=pattern, gaps=False)]


def counted(features: int = 1 << 14) -> list:
    """Stages that make the hashed counts ``_tf`` of ``text``; they learn nothing."""
    from pyspark.ml.feature import HashingTF

    return [*_words("[a-z0-9_]{2,}"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features)]


def counts_of(rows: DataFrame, features: int = 1 << 14, columns: tuple[str, ...] = ("label",)) -> DataFrame:
    """Saved (columns, _tf) of (columns, text): what a fit reads again and again, without words and texts."""
    return written(reduce(lambda r, stage: stage.transform(r), counted(features), rows).select(*columns, "_tf"))


def fit_counts(held: DataFrame, kind: str = "svc", features: int = 1 << 14, **params) -> list:
    """The fitted stages TF-IDF and classifier over (_tf, label)."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
    from pyspark.ml.feature import IDF

    idf = IDF(inputCol="_tf", outputCol="features").fit(held)
    model = {
        "svc": lambda: LinearSVC(maxIter=20, tol=1e-3, **params),
        "sgd": lambda: LinearSVC(maxIter=50, regParam=1e-4, **params),
        "logistic": lambda: LogisticRegression(maxIter=20, **params),
        "l1": lambda: LogisticRegression(maxIter=20, elasticNetParam=1.0, regParam=0.05, **params),
        "bayes": lambda: NaiveBayes(smoothing=0.01, **params),
        "forest": lambda: RandomForestClassifier(numTrees=20, seed=1, **params),
        "mlp": lambda: MultilayerPerceptronClassifier(layers=[features, 100, 100, 2], seed=1, maxIter=20, **params),
    }[kind]()
    return [idf, model.fit(idf.transform(held))]


def fit_pipeline(train: DataFrame, kind: str = "svc", features: int = 1 << 14, **params):
    """MDL-01..06: words, hashed TF-IDF and a Spark ML classifier over (text, label); the texts are read once."""
    from pyspark.ml import PipelineModel

    return PipelineModel([*counted(features), *fit_counts(counts_of(train, features), kind, features, **params)])


def model_path(spark, name: str) -> str:
    """A fresh place for a model: in the folder that driver and executors share, where the session names one."""
    return f"{shared_folder(spark)}/claimloom-models/{name}-{uuid.uuid4().hex}"


def save(model, path: str) -> None:
    """SNK-05: a fitted pipeline, with its vocabulary and weights."""
    model.write().overwrite().save(path)


def load(path: str):
    """MDL-15."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def decisions(model, rows: DataFrame) -> DataFrame:
    """MDL-15: ``rows`` with ``predicted`` and ``decision``, the signed distance or log-odds of class 1."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows)
    return scored.select(*rows.columns, F.col("prediction").cast("int").alias("predicted"), F.element_at(vector_to_array("rawPrediction"), -1).alias("decision"))


def term_weights(train: DataFrame, kind: str = "svc", most: int = 20_000, min_df: int = 3) -> DataFrame:
    """SEL-04, SEL-05, SEL-08, SEL-10: (term, weight) of a linear model over TF-IDF of (text, label); ``most`` terms at most."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer

    words = _words("[a-z0-9_]{2,}")
    vector = CountVectorizer(inputCol="_words", outputCol="_tf", vocabSize=most, minDF=min_df)
    linear = LinearSVC(maxIter=20, tol=1e-3) if kind == "svc" else LogisticRegression(maxIter=20, elasticNetParam=1.0, regParam=0.01)
    model = Pipeline(stages=[*words, vector, IDF(inputCol="_tf", outputCol="features"), linear]).fit(train)
    weights = zip(model.stages[2].vocabulary, model.stages[4].coefficients.toArray().tolist(), strict=True)
    return train.sparkSession.createDataFrame(list(weights), "term string, weight double")  # the vocabulary: at most ``most`` rows


def squared(weights: DataFrame) -> DataFrame:
    """SEL-05: (term, score): squared weights as parts of the largest."""
    largest = weights.agg(F.max(F.col("weight") * F.col("weight")).alias("_m"))
    return weights.crossJoin(F.broadcast(largest)).select("term", F.try_divide(F.col("weight") * F.col("weight"), F.col("_m")).alias("score"))  # one row


def top_terms(weights: DataFrame, n: int = 10) -> DataFrame:
    """SEL-08: (label, place, term, weight): the ``n`` terms that speak most for either class."""
    sides = [weights.orderBy(F.col("weight") * -sign, "term").limit(n).withColumn("label", F.lit(label)) for label, sign in ((1, 1), (0, -1))]
    placed = [s.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.abs("weight")), "term"))) for s in sides]
    return placed[0].unionByName(placed[1]).select("label", "place", "term", "weight")


def cross_validate(rows: DataFrame, kind: str, k: int = 3) -> list[tuple[float, float]]:
    """MDL-14: (on the other folds, on the fold) of each fold (column ``fold`` from 1): accuracy, which is F1 micro of one label a row.

    ``rows`` hold the text, or its counts ``_tf`` already; a fold learns its TF-IDF and classifier from the others' counts.
    """
    held = rows if "_tf" in rows.columns else counts_of(rows, columns=("fold", "label"))
    out = []
    for fold in range(1, k + 1):
        stages = fit_counts(held.filter(F.col("fold") != fold), kind)
        scored = reduce(lambda r, stage: stage.transform(r), stages, held)
        right, own = (F.col("prediction") == F.col("label")).cast("double"), F.col("fold") == fold
        out.append(tuple(scored.agg(F.avg(F.when(~own, right)), F.avg(F.when(own, right))).first()))
    return out


def topics(rows: DataFrame, k: int = 10, passes: int = 5, seed: int = 1, words: int = 2000):
    """MDL-11: an LDA pipeline over (text)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    split = _words("[a-z0-9_]{3,}")
    vector = CountVectorizer(inputCol="_words", outputCol="features", vocabSize=words, minDF=5)
    return Pipeline(stages=[*split, vector, LDA(k=k, maxIter=passes, seed=seed)]).fit(rows)


def pooled_topics(model, rows: DataFrame, group: str) -> DataFrame:
    """MDL-12: (group, topics): the topics of all words of a group; word counts are summed, no text is gathered."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    each = reduce(lambda r, stage: stage.transform(r), model.stages[:-1], rows)
    pooled = each.groupBy(group).agg(Summarizer.sum(F.col("features")).alias("features"))  # as wide as the vocabulary
    return model.stages[-1].transform(pooled).select(group, vector_to_array("topicDistribution").alias("topics"))
