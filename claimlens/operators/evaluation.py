"""Classification metrics, agreement and significance. Rows are reduced to counts first; the rest works on counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.cluster import ranked
from claimlens.functions import pvalues

ALPHA = 0.05


def _ratio(a, b) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def class_report(df: DataFrame, y: str, yhat: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, label, precision, recall, f1, support, hits, predicted) over the classes in truth or prediction; 0 for 0/0."""
    pairs = df.groupBy(*by, F.col(y).cast("string").alias("_y"), F.col(yhat).cast("string").alias("_p")).agg(F.count("*").alias("_n"))
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(F.struct(F.col("_y").alias("label"), F.col("_n").alias("s"), zero.alias("p"), hit.alias("h")),
                    F.struct(F.col("_p").alias("label"), zero.alias("s"), F.col("_n").alias("p"), zero.alias("h")))
    per = pairs.select(*by, F.inline(sides)).groupBy(*by, "label").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    per = per.withColumn("precision", _ratio(F.col("hits"), F.col("predicted"))).withColumn("recall", _ratio(F.col("hits"), F.col("support")))
    return per.withColumn("f1", _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")))


def evaluate(df: DataFrame, y: str, yhat: str, labels: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (per ``by``): accuracy, macro precision/recall/F1, and the same over ``labels`` (absent labels count as 0)."""
    per = class_report(df, y, yhat, by)
    scores = {"precision": "precision", "recall": "recall", "f1": "f1"}
    aggs = [(F.sum("hits") / F.sum("support")).alias("accuracy"), *[F.avg(c).alias(n) for n, c in scores.items()]]
    if labels is not None:
        chosen = lambda c: F.coalesce(F.sum(F.when(F.col("label").isin(*labels), F.col(c))), F.lit(0.0)) / len(labels)
        aggs += [chosen(c).alias(f"{n}+") for n, c in scores.items()]
    return per.groupBy(*by).agg(*aggs) if by else per.agg(*aggs)


def macro_f1(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return evaluate(df, y, yhat).select("f1")


def cohen_kappa(df: DataFrame, a: str, b: str, labels: list[str]) -> DataFrame:
    """Agreement of two label columns over rows whose labels are both in the fixed set."""
    pairs = df.where(F.col(a).isin(*labels) & F.col(b).isin(*labels)).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("double")
    total, same = F.sum("n").cast("double"), count(F.col("a") == F.col("b"))
    chance = sum((count(F.col("a") == c) * count(F.col("b") == c) for c in labels), F.lit(0.0))
    one = pairs.agg(total.alias("n"), same.alias("same"), chance.alias("chance"))
    expected = F.col("chance") / (F.col("n") * F.col("n"))
    return one.select(((F.col("same") / F.col("n") - expected) / (1 - expected)).alias("kappa"))


def fleiss_kappa(df: DataFrame, counts: str, categories: int) -> DataFrame:
    """Agreement from an array of votes per category per row (same number of votes in every row)."""
    votes = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    squares = F.aggregate(counts, F.lit(0), lambda a, x: a + x * x)
    per = df.select(votes.alias("m"), squares.alias("sq"), *[F.get(counts, F.lit(i)).alias(f"c{i}") for i in range(categories)])
    one = per.agg(F.count("*").alias("n"), F.max("m").cast("double").alias("m"), F.sum("sq").alias("sq"),
                  *[F.sum(f"c{i}").alias(f"c{i}") for i in range(categories)])
    n, m = F.col("n"), F.col("m")
    observed = (F.col("sq") - n * m) / (n * m * (m - 1))
    chance = sum(((F.col(f"c{i}") / (n * m)) * (F.col(f"c{i}") / (n * m)) for i in range(categories)), F.lit(0.0))
    return one.select(((observed - chance) / (1 - chance)).alias("kappa"))


def jarque_bera(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, statistic, p, normal) per group from skewness and excess kurtosis."""
    jb = F.count("*") / 6 * (F.pow(F.skewness(value), 2) + F.pow(F.kurtosis(value), 2) / 4)
    out = df.groupBy(by).agg(jb.alias("statistic")).withColumn("p", F.exp(-F.col("statistic") / 2))
    return out.withColumn("normal", F.col("p") > ALPHA)


def model_pairs(results: DataFrame) -> DataFrame:
    """(model1, model2, seed, a, b): every ordered pair of models per seed, a model with itself included.

    The full matrix is the result; the pairing is an equi-join on the seed of a score log.
    """
    left = results.select(F.col("model").alias("model1"), "seed", F.col("f1").alias("a"))
    right = results.select(F.col("model").alias("model2"), "seed", F.col("f1").alias("b"))
    return left.join(right, "seed").select("model1", "model2", "seed", "a", "b")


def paired_t(pairs: DataFrame) -> DataFrame:
    d = F.col("a") - F.col("b")
    stats = pairs.where("model1 <> model2").groupBy("model1", "model2").agg(F.count("*").alias("n"), F.avg(d).alias("_m"), F.stddev_samp(d).alias("_s"))
    t = stats.withColumn("t", F.when(F.col("_s") > 0, F.col("_m") / (F.col("_s") / F.sqrt("n"))))
    return t.withColumn("p", pvalues.paired_t_p("t", (F.col("n") - 1).cast("double"))).drop("_m", "_s")


def wilcoxon(pairs: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """(model1, model2, n, statistic, w_plus, p): zero differences dropped, equal ones share their mid-rank."""
    rows = pairs.where("model1 <> model2").withColumn("d", F.round(F.col("a") - F.col("b"), 12))
    size = Window.partitionBy("model1", "model2", F.abs("d"))
    order = Window.partitionBy("model1", "model2").orderBy(F.abs("d"))
    used = rows.where("d <> 0").withColumn("_c", F.count("*").over(size)).withColumn("_r", F.rank().over(order) + (F.col("_c") - 1) / 2)
    sums = used.groupBy("model1", "model2").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("_r")).otherwise(0.0)).alias("_minus"), F.sum(F.col("_c") * F.col("_c") - 1).cast("double").alias("_ties"))
    zeros = rows.groupBy("model1", "model2").agg(F.count(F.when(F.col("d") == 0, 1)).alias("_zeros"))
    out = zeros.join(sums, ["model1", "model2"], "left").fillna(0, subset=["n", "w_plus", "_minus", "_ties"])
    out = out.withColumn("statistic", F.least("w_plus", "_minus"))
    p = pvalues.wilcoxon_p("w_plus", "n", "_ties", "_zeros", F.lit(alternative))
    return out.withColumn("p", p).select("model1", "model2", "n", "statistic", "w_plus", "p")


def shapiro(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, w, p, normal): weights follow from rank and size; ranks come from ranges of the values, so a group of any size is spread."""
    placed = ranked(df.select(by, value), by, [value])
    weighted = placed.withColumn("_a", pvalues.order_weight(F.col("rank") + 1, "size"))
    out = weighted.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("_a") * F.col(value)).alias("_b"), F.var_pop(value).alias("_v"))
    out = out.withColumn("w", F.col("_b") * F.col("_b") / (F.col("_v") * F.col("n")))
    out = out.withColumn("p", pvalues.shapiro_p("w", "n")).drop("_b", "_v")
    return out.withColumn("normal", F.col("p") > ALPHA)


def significance(results: DataFrame, normal_test: bool = True) -> DataFrame:
    """(model1, model2, verdict). With the normality rule a non-normal sample is named, else the paired t test
    decides; without it the signed-rank test decides."""
    # Verdict texts.
    yes, no, first, second = "statistically significant", "not statistically significant", "sample 1 not normal", "sample 2 not normal"
    pairs = model_pairs(results)
    if not normal_test:
        return wilcoxon(pairs).select("model1", "model2", F.when(F.col("p") < ALPHA, yes).otherwise(no).alias("verdict"))
    ok = shapiro(results, "model", "f1").select("model", "normal")
    side = lambda i: ok.select(F.col("model").alias(f"model{i}"), F.col("normal").alias(f"_n{i}"))
    t = paired_t(pairs).join(side(1), "model1").join(side(2), "model2")
    verdict = F.when(~F.col("_n1"), first).when(~F.col("_n2"), second).when(F.col("p") < ALPHA, yes).otherwise(no)
    return t.select("model1", "model2", verdict.alias("verdict"))


def significance_matrix(results: DataFrame) -> DataFrame:
    """(model1, model2, mean F1 of both, p): labels cut to 50 characters, a model with itself has p = 1."""
    pairs = model_pairs(results)
    means = pairs.groupBy("model1", "model2").agg(F.avg("a").alias("model1_avg_f1"), F.avg("b").alias("model2_avg_f1"))
    tests = wilcoxon(pairs).select("model1", "model2", "p")
    out = means.join(tests, ["model1", "model2"], "left").withColumn("pvalue", F.when(F.col("model1") == F.col("model2"), 1.0).otherwise(F.col("p")))
    return out.select(F.substring("model1", 1, 50).alias("model1"), F.substring("model2", 1, 50).alias("model2"), "model1_avg_f1", "model2_avg_f1", "pvalue")
