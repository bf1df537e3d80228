"""Text classification: multinomial naive Bayes in relational form, and pipelines of the ML library."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, FMClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, CountVectorizer, CountVectorizerModel, NGram, RegexTokenizer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def features(df: DataFrame, key: str, text: str, n: int = 1) -> DataFrame:
    """(key, feature, n): the counted words (and n-grams up to `n`) of each text in lower case."""
    w = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    grams = F.col("w")
    x = df.select(key, F.filter(w, lambda t: t != "").alias("w"))
    for k in range(2, n + 1):
        more = F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i, k=k: F.array_join(F.slice("w", i, k), "_"))).otherwise(F.array().cast("array<string>"))
        grams = F.concat(grams, more)
    return x.select(key, F.explode(grams).alias("feature")).groupBy(key, "feature").agg(F.count("*").alias("n"))


def train_bayes(counts: DataFrame, labels: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Model tables: (label, feature, logp) with Laplace smoothing, and (label, prior, rest) with the value of an unseen feature."""
    j = counts.join(labels.select(key, F.col(label).alias("label")).where("label is not null"), key)
    per = j.groupBy("label", "feature").agg(F.sum("n").alias("n"))
    size = per.agg(F.count_distinct("feature").alias("v"))
    total = per.groupBy("label").agg(F.sum("n").alias("t"))
    docs = labels.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("d"))
    all_docs = docs.agg(F.sum("d").alias("a"))
    classes = total.join(docs, "label").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(all_docs))
    priors = classes.select("label", F.ln(F.col("d") / F.col("a")).alias("prior"), (-F.ln(F.col("t") + F.col("v"))).alias("rest"))
    model = per.join(F.broadcast(classes.select("label", "t", "v")), "label").select("label", "feature", (F.ln(F.col("n") + 1.0) - F.ln(F.col("t") + F.col("v"))).alias("logp"))
    return model, priors


def predict_bayes(counts: DataFrame, model: tuple[DataFrame, DataFrame], key: str) -> DataFrame:
    """(key, label, score): the most probable class, the first by name among equals. Features that no class knows count for none."""
    logp, priors = model
    known = logp.select("feature").distinct()
    x = counts.join(known, "feature", "left_semi")
    base = x.groupBy(key).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(priors)).select(key, "label", (F.col("prior") + F.col("n") * F.col("rest")).alias("base"))
    gain = x.join(logp, "feature").join(F.broadcast(priors.select("label", "rest")), "label").groupBy(key, "label").agg(F.sum(F.col("n") * (F.col("logp") - F.col("rest"))).alias("gain"))
    s = base.join(gain, [key, "label"], "left").select(key, "label", (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("score"))
    return s.groupBy(key).agg(F.min_by("label", F.struct(-F.round("score", 9), "label")).alias("label"), F.max("score").alias("score"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n) of a prediction."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


CLASSIFIERS = {
    "logistic": lambda: LogisticRegression(maxIter=30), "forest": lambda: RandomForestClassifier(numTrees=40, seed=42), "tree": lambda: DecisionTreeClassifier(seed=42), "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=30)),
    "bayes": lambda: NaiveBayes(), "sgd": lambda: OneVsRest(classifier=FMClassifier(solver="gd", factorSize=1, maxIter=30, stepSize=0.05, seed=42)),
}


def pipeline(kind: str = "logistic", text: str = "text", label: str = "label", vocabulary: int = 20_000, least: float = 2.0, most: float = 1.0, pairs: bool = False) -> Pipeline:
    """TF-IDF of words, with `pairs` of neighbouring words too, and a classifier. The vocabulary's size is a parameter and bounds the model; a term counts from
    `least` texts on and up to a share of `most` of them."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    grams = [NGram(n=2, inputCol="_words", outputCol="_two"), SQLTransformer(statement="SELECT *, concat(_words, _two) AS _grams FROM __THIS__")] if pairs else [NGram(n=1, inputCol="_words", outputCol="_grams")]
    counts = CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=vocabulary, minDF=least, **({"maxDF": most} if most < 1 else {}))
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip"), words, *grams, counts, IDF(inputCol="_tf", outputCol="_x"),
            CLASSIFIERS[kind]().setFeaturesCol("_x").setLabelCol("_label"),
        ]
    )


def parts(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Every row with `part`, 0 to n - 1, by a digest of its key: even within every label, the same at every run."""
    return df.withColumn("part", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(n)).cast("int"))


def accuracy(predicted: DataFrame) -> float:
    return predicted.agg(F.avg((F.col("prediction") == F.col("_label")).cast("double"))).first()[0] or 0.0


def cross_validated(df: DataFrame, key: str, folds: int = 5, **options) -> DataFrame:
    """(fold, accuracy) of a pipeline trained on the other parts; one fit for each fold."""
    x = parts(df, key, folds)
    rows = []
    for k in range(folds):
        model = pipeline(**options).fit(x.where(F.col("part") != k))
        rows.append((k, accuracy(model.transform(x.where(F.col("part") == k)))))
    return df.sparkSession.createDataFrame(rows, "fold int, accuracy double")


def bootstrapped(df: DataFrame, key: str, rounds: int = 10, chance: float | None = None, seed: int = 1, **options) -> DataFrame:
    """(rounds, mean, sd, t, significant): accuracies over random halves against chance (one over the number of labels, if none is given); t of one sample,
    significant beyond 2.26 (nine degrees of freedom, 5 %)."""
    label = options.get("label", "label")
    even = chance if chance is not None else 1 / max(1, df.select(label).distinct().count())
    got = []
    for k in range(rounds):
        x = parts(df, key, 2, seed + k)
        got.append(accuracy(pipeline(**options).fit(x.where("part = 0")).transform(x.where("part = 1"))))
    mean = sum(got) / rounds
    sd = (sum((a - mean) ** 2 for a in got) / max(1, rounds - 1)) ** 0.5
    t = (mean - even) / (sd / rounds**0.5) if sd else float("inf") if mean > even else 0.0
    return df.sparkSession.createDataFrame([(rounds, mean, sd, t, t > 2.26)], "rounds int, mean double, sd double, t double, significant boolean")


def importances(model: PipelineModel, top: int = 5) -> list[tuple[str, float]]:
    """The terms that a forest or tree relies on most, with their shares."""
    words = next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary
    shares = model.stages[-1].featureImportances.toArray()
    return sorted(((w, float(x)) for w, x in zip(words, shares) if x > 0), key=lambda p: (-p[1], p[0]))[:top]


def vectorised(df: DataFrame, words: str, vocabulary: list[str], out: str = "vector") -> DataFrame:
    """Counts of the terms of a given vocabulary in an array of words."""
    return CountVectorizerModel.from_vocabulary(vocabulary, inputCol=words, outputCol=out).transform(df)


def nearest_label(near: DataFrame, labels: DataFrame, query: str = "query_id", other: str = "vec_id", label: str = "label") -> DataFrame:
    """(query, label): the most frequent label among a row's nearest vectors, the first by order among equals."""
    n = near.join(labels.select(F.col(other), F.col(label).alias("label")), other).groupBy(query, "label").agg(F.count("*").alias("n"))
    return n.groupBy(query).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))


def best_model(registry: DataFrame, task: str, language: str) -> DataFrame:
    """The registered model of a task and language with the highest accuracy, the first by name among equals."""
    return registry.where((F.col("task") == task) & (F.col("language") == language)).orderBy(F.desc("accuracy"), "name").limit(1)


def text_clusters(df: DataFrame, text: str, most: int = 5, terms: int = 1000) -> DataFrame:
    """The rows with `cluster`: TF-IDF of the words of short strings, two principal components, k-means with up to `most` centres."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^\p{L}\p{N}]+"), CountVectorizer(inputCol="_w", outputCol="_c", vocabSize=terms), IDF(inputCol="_c", outputCol="_i"), PCA(k=2, inputCol="_i", outputCol="_p"),
        KMeans(k=most, seed=42, featuresCol="_p", predictionCol="cluster"),
    ]
    return Pipeline(stages=stages).fit(df).transform(df).drop("_w", "_c", "_i", "_p")


def profile_clusters(df: DataFrame, columns: list[str], most: int = 3) -> DataFrame:
    """The rows with `cluster`, by k-means of columns of numbers brought to mean 0 and deviation 1."""
    stages = [VectorAssembler(inputCols=columns, outputCol="_v"), StandardScaler(withMean=True, inputCol="_v", outputCol="_s"), KMeans(k=most, seed=42, featuresCol="_s", predictionCol="cluster")]
    return Pipeline(stages=stages).fit(df).transform(df).drop("_v", "_s")
