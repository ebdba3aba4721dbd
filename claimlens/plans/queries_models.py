"""Queries: model jobs over the article and sentence datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixed
from claimlens.operators import articles, encoding, models
from claimlens.operators.selectors import sentence_selector
from claimlens.plans import views
from claimlens.plans.queries_articles import rounded
from claimlens.plans.registry import register
from claimlens.plans.views import with_views


@register("V10", with_views("sentence") + """
SELECT id, CASE WHEN CAST('0x' || left(md5(id || '-25'), 8) AS BIGINT) % 10000 < 8000 THEN 'train' ELSE 'dev' END AS part FROM sentence""")
def v10(spark, d):
    return models.split(views.sentence(spark, d).select("id"), "id")


def features(spark, d):
    """(train, test) feature rows with an assembled vector and the binary label, stored for repeated passes."""
    data = encoding.fd_feature_dataset(views.item(spark, d), views.sentence(spark, d), "dev", binary=True)
    ready = models.assemble(data, articles.FEATURES).select("split", "id", "label", "features").persist()
    # each of the many passes starts a task per partition, so a partition has 10,000 rows at least
    ready = ready.coalesce(max(1, ready.count() // 10_000))
    return ready.where("split = 'train'"), ready.where("split = 'test'")


@register("V11")
def v11(spark, d):
    train, test = features(spark, d)
    out = None
    for kind in ("forest", "boosting"):
        one = models.tree_job(train, test, kind).select(F.lit(kind).alias("kind"), "id", "label", "prediction")
        out = one if out is None else out.unionByName(one)
    return out


@register("V12")
def v12(spark, d):
    train, test = features(spark, d)
    first = models.tree_model(train, "forest")
    again = models.tree_model(models.select_features(first, train, 9), "forest", features="selected")
    return again.transform(models.select_features(first, test, 9)).select("id", "label", "prediction")


def sentences(spark, d):
    data = encoding.fc_dataset(views.sentence(spark, d), binary=True).where("text <> ''").persist()
    return data.where("split = 'train'").drop("split"), data.where("split = 'test'").drop("split")


@register("V13")
def v13(spark, d):
    train, test = sentences(spark, d)
    out = None
    for weighted in (False, True):
        model = models.text_classifier(train, 2, weighted=weighted)
        one = model.transform(test).select(F.lit(weighted).alias("weighted"), "id", "label", "prediction")
        out = one if out is None else out.unionByName(one)
    return out


@register("V14")
def v14(spark, d):
    train, test = features(spark, d)
    bases = {
        "forest": lambda df: models.tree_model(df, "forest"),
        "linear": lambda df: models.LogisticRegression().fit(df),
    }
    return models.stack(train.drop("split"), test.drop("split"), bases, [("forest",), ("linear",), ("forest", "linear")])


@register("V15")
def v15(spark, d):
    train, _ = sentences(spark, d)
    model = models.text_classifier(train, 2, weighted=True)
    new = views.sentence(spark, d).where(sentence_selector("cw-new")).select("id", F.col("sentence").alias("text"))
    score = models.annotate(new, model, True, "score", fixed.TRUTH_CLASSES)
    return rounded(score.select("id", "score"), ["score"], 6)


# The forest sizes and seeds of the sweep.
SIZES = [4, 8, 10, 12, 15, 20, 100, 200, 500, 1000]
SEEDS = [0, 12, 33, 42, 54, 63, 70, 79, 85, 96]


@register("V16")
def v16(spark, d):
    train, test = features(spark, d)
    return models.sweep([{"trees": n} for n in SIZES], SEEDS, lambda seed, trees: models.tree_model(train, "forest", trees, seed), test, ["0.0"], workers=8)
