"""Queries: metrics, agreement, significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixed
from claimlens.operators import articles, evaluation
from claimlens.operators.selectors import item_selector
from claimlens.plans import views
from claimlens.plans.queries_articles import FOUR, rounded
from claimlens.plans.queries_updates import ITEM_WHERE
from claimlens.plans.registry import register
from claimlens.plans.views import with_views

PRED_SQL = with_views("item", "sentence") + f"""
, pred AS (SELECT i.id, any_value(i.item_class_4) AS y, {FOUR} AS yhat, any_value(CASE WHEN {ITEM_WHERE['dev'].replace('skip_validations', 'i.skip_validations').replace('review_level', 'i.review_level').replace('instance_type', 'i.instance_type')} THEN 1 ELSE 0 END) AS dev,
  CASE WHEN min(s.sentence_class_score_auto) > 0.5 THEN 1 ELSE 0 END AS bin FROM item i LEFT JOIN sentence s ON s.item_id = i.id GROUP BY i.id)
"""


def report_sql(source, y="y", yhat="yhat", tag="rep"):
    return f"""{tag} AS (SELECT label, sum(s) AS support, sum(p) AS predicted, sum(h) AS hits FROM (
  SELECT {y} AS label, 1 AS s, 0 AS p, CASE WHEN {y} = {yhat} THEN 1 ELSE 0 END AS h FROM {source} UNION ALL SELECT {yhat}, 0, 1, 0 FROM {source}) GROUP BY label),
{tag}s AS (SELECT label, CAST(support AS BIGINT) AS support, CAST(hits AS BIGINT) AS hits, coalesce(hits / nullif(predicted, 0), 0) AS precision,
  coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f1 FROM {tag})"""


MACRO = "round(sum(hits) / sum(support), 9) AS accuracy, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1"


def _plus(labels):
    members = ", ".join(f"'{x}'" for x in labels)
    return ", ".join(f'round(coalesce(sum({c}) FILTER (label IN ({members})), 0) / {len(labels)}, 9) AS "{c}+"' for c in ("precision", "recall", "f1"))


def predictions(spark, d):
    items = views.item(spark, d).select("id", "item_class_4", "skip_validations", "review_level", "instance_type")
    return articles.verdicts(items, views.sentence(spark, d)).select("*", F.col("item_class_4").alias("y"), F.col("verdict4").alias("yhat"))


@register("E1", PRED_SQL + ", " + report_sql("pred") + f"SELECT {MACRO} FROM reps")
def e1(spark, d):
    return rounded(evaluation.evaluate(predictions(spark, d), "y", "yhat"), ["accuracy", "precision", "recall", "f1"])


@register("E2", PRED_SQL + ", " + report_sql("pred") + f"SELECT {MACRO}, {_plus(['NA', 'F', 'PF'])} FROM reps")
def e2(spark, d):
    out = evaluation.evaluate(predictions(spark, d), "y", "yhat", fixed.POSITIVE_LABELS["fd", "text"])
    return rounded(out, ["accuracy", "precision", "recall", "f1", "precision+", "recall+", "f1+"])


@register("E3", PRED_SQL + ", " + report_sql("pred") + "SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM reps")
def e3(spark, d):
    out = evaluation.class_report(predictions(spark, d), "y", "yhat")
    return rounded(out.select("label", "precision", "recall", "f1", "support"), ["precision", "recall", "f1"])


@register("E4", PRED_SQL + ", dev4 AS (SELECT * FROM pred WHERE dev = 1), dev2 AS (SELECT CASE WHEN y = 'T' THEN '1' ELSE '0' END AS y, CAST(bin AS VARCHAR) AS yhat FROM dev4), "
          + report_sql("dev4", tag="four") + ", " + report_sql("dev2", tag="two") + f"""
SELECT 'multi' AS mode, {MACRO}, {_plus(['NA', 'F', 'PF'])} FROM fours UNION ALL SELECT 'binary', {MACRO}, {_plus(['0'])} FROM twos""")
def e4(spark, d):
    dev = predictions(spark, d).where(item_selector("dev"))
    two = dev.select((F.col("item_class_4") == "T").cast("int").alias("y"), F.col("verdict_bin_score").alias("yhat"))
    cols = ["accuracy", "precision", "recall", "f1", "precision+", "recall+", "f1+"]
    multi = evaluation.evaluate(dev, "y", "yhat", fixed.POSITIVE_LABELS["fd", "text"]).withColumn("mode", F.lit("multi"))
    binary = evaluation.evaluate(two, "y", "yhat", fixed.POSITIVE_LABELS["fd", True]).withColumn("mode", F.lit("binary"))
    return rounded(multi.unionByName(binary), cols)


@register("E5", PRED_SQL + ", " + report_sql("pred") + "SELECT round(avg(f1), 9) AS f1 FROM reps")
def e5(spark, d):
    return rounded(evaluation.macro_f1(predictions(spark, d), "y", "yhat"), ["f1"])


LABELS = ["NA", "NF", "FNR", "FRC", "FR"]
VOTES_SQL = with_views("sentence") + """
, votes AS (SELECT id, check_worthy AS a, (['NA','NF','FNR','FRC','FR'])[(item_id * 3 + pos + pos % 3) % 5 + 1] AS b,
  (['NA','NF','FNR','FRC','FR'])[(item_id * 3 + pos + pos % 7) % 5 + 1] AS c FROM sentence)
"""


def votes(spark, d):
    pick = lambda i: F.element_at(F.array(*[F.lit(v) for v in LABELS]), (i % 5 + 1).cast("int"))
    base = F.col("item_id") * 3 + F.col("pos")
    return views.sentence(spark, d).select("id", F.col("check_worthy").alias("a"), pick(base + F.col("pos") % 3).alias("b"), pick(base + F.col("pos") % 7).alias("c"))


def _kappa_sql(x, y):
    return f"""SELECT '{x}{y}' AS pair, round((po - pe) / (1 - pe), 9) AS kappa FROM (SELECT
  (SELECT avg(CASE WHEN {x} = {y} THEN 1.0 ELSE 0.0 END) FROM votes WHERE {x} IN ('NF','FNR','FR') AND {y} IN ('NF','FNR','FR')) AS po,
  (SELECT sum(p * q) FROM (SELECT l, (SELECT count(*) FROM votes WHERE {x} = l AND {y} IN ('NF','FNR','FR'))::DOUBLE / n AS p,
     (SELECT count(*) FROM votes WHERE {y} = l AND {x} IN ('NF','FNR','FR'))::DOUBLE / n AS q
     FROM (SELECT unnest(['NF','FNR','FR']) AS l), (SELECT count(*) AS n FROM votes WHERE {x} IN ('NF','FNR','FR') AND {y} IN ('NF','FNR','FR')))) AS pe)"""


@register("E6", VOTES_SQL + " UNION ALL ".join(_kappa_sql(x, y) for x, y in ("ab", "ac", "bc")))
def e6(spark, d):
    v, out = votes(spark, d), None
    for x, y in ("ab", "ac", "bc"):
        one = evaluation.cohen_kappa(v, x, y, ["NF", "FNR", "FR"]).withColumn("pair", F.lit(x + y))
        out = one if out is None else out.unionByName(one)
    return rounded(out, ["kappa"])


@register("E7", VOTES_SQL + """
, n AS (SELECT id, l, CAST(a = l AS INTEGER) + CAST(b = l AS INTEGER) + CAST(c = l AS INTEGER) AS k FROM votes, (SELECT unnest(['NA','NF','FNR','FRC','FR']) AS l)),
p AS (SELECT avg(pi) AS po FROM (SELECT id, (sum(k * k) - 3) / 6.0 AS pi FROM n GROUP BY id)),
e AS (SELECT sum(s * s) AS pe FROM (SELECT l, sum(k)::DOUBLE / (3 * (SELECT count(*) FROM votes)) AS s FROM n GROUP BY l))
SELECT round((po - pe) / (1 - pe), 9) AS kappa FROM p, e""")
def e7(spark, d):
    hits = F.array(*[sum(((F.col(c) == l).cast("int") for c in "abc"), F.lit(0)) for l in LABELS])
    return rounded(evaluation.fleiss_kappa(votes(spark, d).withColumn("counts", hits), "counts", 5), ["kappa"])


@register("E8", with_views("results") + """
, m AS (SELECT model, count(*) AS n, avg(f1) AS mu FROM results GROUP BY 1),
c AS (SELECT r.model, any_value(n) AS n, avg((f1 - mu) ** 2) AS m2, avg((f1 - mu) ** 3) AS m3, avg((f1 - mu) ** 4) AS m4 FROM results r JOIN m USING (model) GROUP BY 1),
j AS (SELECT model, n / 6.0 * ((m3 / m2 ** 1.5) ** 2 + (m4 / (m2 * m2) - 3) ** 2 / 4) AS jb FROM c)
SELECT model, round(jb, 6) AS statistic, round(exp(-jb / 2), 6) AS p, exp(-jb / 2) > 0.05 AS normal FROM j""")
def e8(spark, d):
    return rounded(evaluation.jarque_bera(views.results(spark, d), "model", "f1"), ["statistic", "p"], 6)


PAIRS_SQL = with_views("results") + """
, pr AS (SELECT x.model AS model1, y.model AS model2, x.seed, x.f1 AS a, y.f1 AS b FROM results x JOIN results y USING (seed))
"""


@register("J11", PAIRS_SQL + "SELECT model1, model2, count(*) AS n, round(avg(a), 9) AS avg1, round(avg(b), 9) AS avg2 FROM pr GROUP BY 1, 2")
def j11(spark, d):
    pairs = evaluation.model_pairs(views.results(spark, d))
    return rounded(pairs.groupBy("model1", "model2").agg(F.count("*").alias("n"), F.avg("a").alias("avg1"), F.avg("b").alias("avg2")), ["avg1", "avg2"])


@register("E9", PAIRS_SQL + """
SELECT model1, model2, count(*) AS n, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t FROM pr WHERE model1 <> model2 GROUP BY 1, 2""".replace("SELECT model1, model2, count(*) AS n, round(", ", tt AS (SELECT model1, model2, count(*) AS n, ").replace(", 6) AS t FROM", " AS t FROM") + """),
-- distribution function of t for nine degrees of freedom (ten seeds)
th AS (SELECT *, atan(t / 3) AS x FROM tt)
SELECT model1, model2, n, round(t, 6) AS t, CASE WHEN n = 10 THEN
  round(1 - abs(2 / pi() * (x + sin(x) * (cos(x) + 2.0 / 3 * cos(x) ** 3 + 8.0 / 15 * cos(x) ** 5 + 16.0 / 35 * cos(x) ** 7))), 9) END AS p FROM th""")
def e9(spark, d):
    out = evaluation.paired_t(evaluation.model_pairs(views.results(spark, d)))
    return rounded(rounded(out.select("model1", "model2", "n", "t", "p"), ["t"], 6), ["p"])


WILCOXON_SQL = PAIRS_SQL + """
, dd AS (SELECT model1, model2, round(a - b, 12) AS d FROM pr WHERE model1 <> model2),
rk AS (SELECT *, rank() OVER (PARTITION BY model1, model2 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model1, model2, abs(d)) - 1) / 2.0 AS r FROM dd WHERE d <> 0),
wx AS (SELECT model1, model2, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus,
  least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END))::DOUBLE AS statistic FROM rk GROUP BY 1, 2)
"""


# Exact two-sided p for samples without ties: all signs of the ranks, counted by their rank sum.
EXACT_SQL = """
, sub AS (SELECT n, list_sum(list_transform(range(0, n), lambda i: CASE WHEN (s >> i) & 1 = 1 THEN i + 1 ELSE 0 END)) AS w
  FROM (SELECT n, unnest(range(0, CAST(2 ** n AS BIGINT))) AS s FROM (SELECT DISTINCT n FROM wx))),
px AS (SELECT model1, model2, any_value(wx.n) AS n, any_value(w_plus) AS w_plus, any_value(statistic) AS statistic,
  least(1.0, 2 * least(count(*) FILTER (WHERE w <= w_plus), count(*) FILTER (WHERE w >= w_plus)) / count(*)) AS p FROM wx JOIN sub ON sub.n = wx.n GROUP BY 1, 2)
"""


@register("E10", WILCOXON_SQL + EXACT_SQL + "SELECT model1, model2, n, w_plus, statistic, round(p, 9) AS p FROM px")
def e10(spark, d):
    out = evaluation.wilcoxon(evaluation.model_pairs(views.results(spark, d))).select("model1", "model2", "n", "w_plus", "statistic", "p")
    return rounded(out, ["p"])


# Normality of ten seeds a model: fixed values are the standard normal quantiles of (i - 0.375) / 10.25 and the published
# polynomials; the upper tail of the normal distribution is summed as a series.
QUANTILES = "-1.546635271399230, -1.000490545619315, -0.655423505234427, -0.375461770235518, -0.122580843888802, 0.122580843888803, 0.375461770235518, 0.655423505234427, 1.000490545619315, 1.546635271399230"
NORMALITY_SQL = f"""
, qm AS (SELECT unnest([{QUANTILES}]) AS m, unnest(range(1, 11)) AS i),
ss AS (SELECT sum(m * m) AS ssm, max(m) AS m10, max(m) FILTER (i = 9) AS m9, 1 / sqrt(10) AS u FROM qm),
en AS (SELECT *, 0.221157 * u - 0.147981 * u ** 2 - 2.07119 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5 + m10 / sqrt(ssm) AS a10,
  0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4 - 3.582633 * u ** 5 + m9 / sqrt(ssm) AS a9 FROM ss),
wt AS (SELECT i, CASE i WHEN 10 THEN a10 WHEN 9 THEN a9 WHEN 2 THEN -a9 WHEN 1 THEN -a10
  ELSE m / sqrt((ssm - 2 * m10 ** 2 - 2 * m9 ** 2) / (1 - 2 * a10 ** 2 - 2 * a9 ** 2)) END AS a FROM qm, en),
rs AS (SELECT model, f1, row_number() OVER (PARTITION BY model ORDER BY f1) AS i FROM results),
sw AS (SELECT model, count(*) AS n, sum(a * f1) ** 2 / (var_pop(f1) * count(*)) AS w FROM rs LEFT JOIN wt USING (i) GROUP BY 1),
sz AS (SELECT model, n, w, (-ln(0.459 * n - 2.273 - ln(1 - w)) - (0.544 - 0.39978 * n + 0.025054 * n ** 2 - 6.714e-4 * n ** 3))
  / exp(1.3822 - 0.77857 * n + 0.062767 * n ** 2 - 0.0020322 * n ** 3) AS z FROM sw WHERE n = 10),
sp AS (SELECT model, n, w, 0.5 - exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 80), lambda k: z ** (2 * k + 1) * sqrt(pi()) / (2.0 ** (k + 1) * gamma(k + 1.5)))) AS p FROM sz)
"""


@register("E11", with_views("results") + NORMALITY_SQL + "SELECT model, n, round(w, 6) AS w, round(p, 6) AS p, p > 0.05 AS normal FROM sp")
def e11(spark, d):
    return rounded(evaluation.shapiro(views.results(spark, d), "model", "f1"), ["w", "p"], 6)


# Two-sided p of the paired t test for nine degrees of freedom (ten seeds).
T_SQL = """
, t0 AS (SELECT model1, model2, atan(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) / 3) AS x FROM pr WHERE model1 <> model2 GROUP BY 1, 2),
tp AS (SELECT model1, model2, 1 - abs(2 / pi() * (x + sin(x) * (cos(x) + 2.0 / 3 * cos(x) ** 3 + 8.0 / 15 * cos(x) ** 5 + 16.0 / 35 * cos(x) ** 7))) AS p FROM t0)
"""


@register("E12", WILCOXON_SQL + EXACT_SQL + T_SQL + NORMALITY_SQL + """
SELECT 'normal' AS rule, model1, model2, CASE WHEN s1.p <= 0.05 THEN 'sample 1 not normal' WHEN s2.p <= 0.05 THEN 'sample 2 not normal'
  WHEN tp.p < 0.05 THEN 'statistically significant' ELSE 'not statistically significant' END AS verdict
FROM tp JOIN sp s1 ON s1.model = model1 JOIN sp s2 ON s2.model = model2
UNION ALL SELECT 'not normal', model1, model2, CASE WHEN p < 0.05 THEN 'statistically significant' ELSE 'not statistically significant' END FROM px""")
def e12(spark, d):
    r = views.results(spark, d)
    return evaluation.significance(r).withColumn("rule", F.lit("normal")).unionByName(
        evaluation.significance(r, normal_test=False).withColumn("rule", F.lit("not normal")))


@register("E13", WILCOXON_SQL + EXACT_SQL + """
SELECT left(g.model1, 50) AS model1, left(g.model2, 50) AS model2, round(m1, 9) AS model1_avg_f1, round(m2, 9) AS model2_avg_f1,
  CASE WHEN g.model1 = g.model2 THEN 1.0 ELSE round(p, 9) END AS pvalue
FROM (SELECT model1, model2, avg(a) AS m1, avg(b) AS m2 FROM pr GROUP BY 1, 2) g LEFT JOIN px USING (model1, model2)""")
def e13(spark, d):
    return rounded(evaluation.significance_matrix(views.results(spark, d)), ["model1_avg_f1", "model2_avg_f1", "pvalue"])
