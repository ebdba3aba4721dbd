"""Model jobs on Spark ML: splits, trees, feature selection, text classifiers, stacking, scoring, sweeps."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import ElementwiseProduct, HashingTF, IDF, Normalizer, RegexTokenizer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.cluster import broadcast_if_small, shared_path
from claimlens.functions.text import decode_class
from claimlens.operators.counts import class_weights
from claimlens.operators.evaluation import evaluate
from claimlens.operators.hidden import fit_hidden


def split(df: DataFrame, key: str, ratio: float = 0.8, seed: int = 25) -> DataFrame:
    """Adds ``part`` (train/dev) by a hash of the key: the same rows however the table is partitioned."""
    digest = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10000
    return df.withColumn("part", F.when(place < int(ratio * 10000), "train").otherwise("dev"))


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


def tree_model(train: DataFrame, kind: str, trees: int = 100, seed: int = 33, features: str = "features", label: str = "label") -> Model:
    """Random forest or gradient boosting; boosting with more than two classes runs one model per class."""
    if kind == "forest":
        return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, seed=seed).fit(train)
    boosting = GBTClassifier(featuresCol=features, labelCol=label, maxIter=trees, seed=seed)
    if train.agg(F.max(label).alias("m")).first()["m"] > 1:
        return OneVsRest(classifier=boosting, featuresCol=features, labelCol=label).fit(train)
    return boosting.fit(train)


def tree_job(train: DataFrame, test: DataFrame, kind: str, trees: int = 100, seed: int = 33) -> DataFrame:
    return tree_model(train, kind, trees, seed).transform(test)


def select_features(model: Model, df: DataFrame, cap: int | None = None, features: str = "features", out: str = "selected") -> DataFrame:
    """Keeps features of at least mean importance, the ``cap`` most important at most."""
    weights = model.featureImportances.toArray()
    chosen = [i for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)) if weights[i] >= weights.mean()]
    return VectorSlicer(inputCol=features, outputCol=out, indices=sorted(chosen[:cap])).transform(df)


#: Columns that terms are hashed to: for the linear head, whose weights are one vector of that length whatever the corpus, and
#: for the hidden layer, which has so many weights per unit.
LINEAR_WIDTH, HASH_WIDTH = 1 << 18, 4096


def _terms(text: str) -> RegexTokenizer:
    return RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\w+", gaps=False, minTokenLength=2)


def shared_columns(df: DataFrame, width: int, text: str = "text") -> tuple[int, int]:
    """Numbers of distinct terms of the texts and of the columns they take; the difference shares a column."""
    split = _terms(text).transform(df).select("_words")
    used = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=width).transform(split).select(Summarizer.numNonZeros(F.col("_tf"))).first()[0]
    return split.select(F.explode("_words")).distinct().count(), int((used.toArray() > 0).sum())


def tfidf_stages(train: DataFrame, text: str = "text", width: int = LINEAR_WIDTH, out: str = "features") -> PipelineModel:
    """Sparse TF-IDF with idf ``ln((1+n)/(1+df))+1`` and unit length, over every term of the training texts.

    Terms are hashed to ``width`` columns, so that no vocabulary passes through the driver; none is dropped, but some share
    a column (``shared_columns`` counts them).
    """
    words = _terms(text)
    count = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=width)
    counted = PipelineModel(stages=[words, count])
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counted.transform(train)).idf.toArray() + 1
    scale = ElementwiseProduct(inputCol="_tf", outputCol="_scaled", scalingVec=Vectors.dense(idf))
    return PipelineModel(stages=[*counted.stages, scale, Normalizer(inputCol="_scaled", outputCol=out)])


def text_classifier(train: DataFrame, classes: int, hidden: int = 100, seed: int = 70, width: int = HASH_WIDTH, iterations: int = 50,
                    weighted: bool = False) -> PipelineModel:
    """Text to class probabilities: hashed TF-IDF and one hidden layer, or weighted regression over a wide hash when classes are balanced."""
    features = tfidf_stages(train, width=LINEAR_WIDTH if weighted else width)
    ready = features.transform(train)
    if weighted:
        weights = class_weights(train, "label").select("label", "weight")
        head = LogisticRegression(weightCol="weight", maxIter=iterations).fit(ready.join(broadcast_if_small(weights), "label"))
    else:
        head = fit_hidden(ready, width, hidden, classes, seed, iterations)
    return PipelineModel(stages=[*features.stages, head])


Fit = Callable[[DataFrame], Model]


def _probabilities(model: Model, df: DataFrame, out: str) -> DataFrame:
    scored = model.transform(df)
    drop = [c for c in scored.columns if c not in df.columns and c != "probability"]
    return scored.withColumnRenamed("probability", out).drop(*drop)


def stack(train: DataFrame, test: DataFrame, bases: dict[str, Fit], modes: Iterable[tuple[str, ...]], key: str = "id", folds: int = 3, seed: int = 7) -> DataFrame:
    """(mode, key, label, prediction): a head over base-model probabilities, alone, in pairs or all together.

    Training probabilities are out of fold: each base scores only rows it was not fitted on.
    """
    placed = train.withColumn("_fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int"))
    meta_train, meta_test = None, test
    for fold in range(folds):
        seen, held = placed.where(F.col("_fold") != fold), placed.where(F.col("_fold") == fold)
        for name, fit in bases.items():
            held = _probabilities(fit(seen), held, f"p_{name}")
        meta_train = held if meta_train is None else meta_train.unionByName(held)
    for name, fit in bases.items():
        meta_test = _probabilities(fit(train), meta_test, f"p_{name}")
    out = None
    for mode in modes:
        gather = VectorAssembler(inputCols=[f"p_{n}" for n in mode], outputCol="_meta")
        head = LogisticRegression(featuresCol="_meta", maxIter=20).fit(gather.transform(meta_train).select("_meta", "label"))
        one = head.transform(gather.transform(meta_test)).select(F.lit("+".join(mode)).alias("mode"), key, "label", "prediction")
        out = one if out is None else out.unionByName(one)
    return out


def annotate(df: DataFrame, model: Model, binary: bool, target: str, classes: list[str], squeeze: bool = False) -> DataFrame:
    """Writes predictions: probability of class 1 (binary) or the class label. ``squeeze`` applies a softmax again."""
    scored = model.transform(df)
    probability = vector_to_array("probability")
    if binary:
        p1 = F.get(probability, F.lit(1))
        value: Column = 1 / (1 + F.exp(1 - 2 * p1)) if squeeze else p1
    else:
        value = decode_class(F.col("prediction").cast("int"), classes)
    return scored.withColumn("_value", value).select(*[c for c in df.columns if c != target], F.col("_value").alias(target))


def sweep(grid: list[dict], seeds: list[int], fit: Callable[..., Model], test: DataFrame, labels: list[str], y: str = "label", workers: int = 4) -> DataFrame:
    """One metric row per setting and seed, named ``model``; ``fit(seed=..., **setting)`` gives a model.

    Models are fitted side by side, ``workers`` at a time. Each one's predictions of ``test`` are stored at once, so no model
    is kept, and all of them are evaluated in one pass over the stored table.
    """
    path = shared_path(test.sparkSession, "sweep")

    def one(place: tuple[dict, int]) -> None:
        setting, seed = place
        name = "_".join(f"{k}_{v}" for k, v in {**setting, "seed": seed}.items())
        fit(seed=seed, **setting).transform(test).select(y, "prediction").write.parquet(f"{path}/model={name}")

    with ThreadPoolExecutor(workers) as pool:
        list(pool.map(one, product(grid, seeds)))
    return evaluate(test.sparkSession.read.parquet(path), y, "prediction", labels, ("model",))
