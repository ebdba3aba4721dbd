"""Readers: stored tables, dimension files, line lists, external article and feature files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import fixed
from claimlens.functions.text import encode_class


def scan(spark: SparkSession, path: str, where: Column | str | None = None, fields: list[str] | None = None,
         order: list[str] | None = None) -> DataFrame:
    """Filtered, pruned and optionally ordered scan; filter and columns reach the Parquet reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    if fields is not None:
        df = df.select(*fields)
    return df.orderBy(*order) if order else df


def scan_jdbc(spark: SparkSession, url: str, table: str, predicates: list[str], properties: dict, where: str | None = None) -> DataFrame:
    """The same scan over a live database: one partition per predicate, filters pushed to the server."""
    df = spark.read.jdbc(url, table, predicates=predicates, properties=properties)
    return df.where(where) if where else df


def load_sem_types(spark: SparkSession, path: str) -> DataFrame:
    """abbr|tui|name file."""
    return spark.read.schema("abbr string, tui string, type_name string").option("sep", "|").csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file with a number that grows in file order (gaps between splits)."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def load_sem_groups(spark: SparkSession, path: str) -> DataFrame:
    """group|group name|tui|type name file, with line numbers in file order."""
    cut = F.split("value", r"\|")
    names = ("group", "group_name", "tui", "member")
    return numbered_lines(spark, path).select(*[F.get(cut, F.lit(i)).alias(c) for i, c in enumerate(names)], "line_no")


def sem_groups(df: DataFrame, group: str = "group", order: str = "line_no") -> DataFrame:
    """Distinct groups in order of first appearance."""
    return df.groupBy(group).agg(F.min(order).alias("first_line")).orderBy("first_line")


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    """A line-list file as a set of phrases."""
    return spark.read.text(path).select(F.col("value").alias("phrase")).distinct()


def load_valid_groups(spark: SparkSession, path: str) -> DataFrame:
    """Predicate rules: predicate, subject groups and object groups of well-formed lines, last line winning.

    A list such as ``['DISO', 'CHEM']`` becomes an array of codes; ``[]`` becomes an empty array.
    """
    fields = F.split("value", "\t")
    rows = numbered_lines(spark, path).where(F.size(fields) == 4)
    codes = lambda i: F.regexp_extract_all(fields[i], F.lit(r"[A-Z]+"), F.lit(0))
    return rows.groupBy(fields[0].alias("predicate")).agg(
        F.max_by(codes(2), "line_no").alias("subject_groups"), F.max_by(codes(3), "line_no").alias("object_groups"))


def article_class(c: Column) -> Column:
    """Class of an external text rating; unknown ratings are F."""
    out = F.lit("F")
    for name, cls in fixed.ARTICLE_RATINGS.items():
        out = F.when(F.lower(c) == name, cls).otherwise(out)
    return out


def load_external(spark: SparkSession, path: str) -> DataFrame:
    """External labelled articles: text, class, numeric and binary class code."""
    raw = spark.read.schema("text string, article_rating string").json(path)
    cls = article_class(F.col("article_rating"))
    return raw.select("text", cls.alias("item_class_4"), encode_class(cls, fixed.TRUTH_CLASSES).alias("label"),
                      encode_class(cls, fixed.TRUTH_CLASSES, True).alias("binary_label"))


def load_liwc(spark: SparkSession, path: str, class_values: list[str], binary: bool = False) -> DataFrame:
    """Linguistic feature file with decimal commas: label code plus one double per feature column."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    number = lambda c: F.regexp_replace(F.col(f"`{c}`"), r"^(\d+),(?=\d+)", "$1.").cast("double").alias(c)
    features = [c for c in raw.columns if c not in ("Source (A)", "Source (B)")]
    return raw.select(encode_class(F.col("`Source (B)`"), class_values, binary).alias("label"), *[number(c) for c in features])


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Score log with a header; scores become doubles."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    return raw.select(*[F.col(f"`{c}`").cast("double").alias(c) if c != "model" else F.col(c) for c in raw.columns])
