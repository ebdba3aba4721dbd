"""Writers. Each writes with one task per partition; none passes rows through the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.cluster import gather_ordered
from claimlens.functions.text import strip_symbols, tsv_clean, xml_label


def export_json(df: DataFrame, path: str, split_by: str | None = None) -> None:
    """JSON lines, optionally split into folders by a flag column."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(split_by) if split_by else writer).json(path)


def dataset_records(items: DataFrame, sentences: DataFrame) -> DataFrame:
    """One record per accepted corpus item with the ordered array of its sentences (empty if none)."""
    binary = lambda c: F.when(c, "T").otherwise("F")
    kind = F.when(F.col("instance_type").isin("Dev", "Other"), "Test").otherwise(F.col("instance_type"))
    entry = F.struct(
        F.col("new_sentence_id").alias("sentence_id"), "check_worthy", F.col("sentence_class").alias("sentence_class_mc"),
        binary(F.col("sentence_class") == "T").alias("sentence_class"), F.col("instance_type").alias("pipeline_instance_type"),
        kind.alias("instance_type"))
    kept = (F.col("review_level") > 0) & ~F.col("skip_validations")
    lists = gather_ordered(sentences.where(kept), ["item_id"], "new_sentence_id", entry, "sentences")
    rows = items.where(kept).select(
        F.col("id").alias("item_id"), F.col("url").alias("item_url"), "review_url", F.col("item_class_4").alias("item_class_mc"),
        binary(F.col("item_class") == 1).alias("item_class"))
    joined = rows.join(lists, "item_id", "left")
    none = F.filter(F.array(F.lit(None).cast(lists.schema["sentences"].dataType.elementType)), lambda x: F.lit(False))
    return joined.withColumn("sentences", F.coalesce("sentences", none))


def export_dataset(items: DataFrame, sentences: DataFrame, path: str) -> None:
    dataset_records(items, sentences).write.mode("overwrite").json(path)


def export_text_class(df: DataFrame, path: str, text: str, label: str) -> None:
    rows = df.select(tsv_clean(F.col(text)).alias("document"), F.col(label).alias("class"))
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def sentence_files(df: DataFrame, level: int, clean: bool = False) -> DataFrame:
    """(id, value) lines of the per-sentence text export, blank lines dropped."""
    text = strip_symbols(F.col("sentence")) if clean else F.col("sentence")
    lines = df.where(F.col("review_level") == level).select("id", F.posexplode(F.split(text, "\n")).alias("line_no", "value"))
    return lines.where(F.col("value") != "").select("id", "line_no", "value")


def export_sentences(df: DataFrame, path: str, level: int, clean: bool = False) -> None:
    """Lines ``id<TAB>text`` in order of the ids; the part files follow each other by name."""
    ordered = sentence_files(df, level, clean).orderBy("id", "line_no")
    ordered.select(F.concat_ws("\t", F.col("id").cast("string"), "value").alias("value")).write.mode("overwrite").text(path)


def export_triples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ordered lines of a graph interchange file: nodes(node, first_seen), edges(edge_id, src, dst, rel)."""
    spark = nodes.sparkSession
    # The frame of the file format.
    head = ['<?xml version="1.0" encoding="UTF-8"?>',
            '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2" xmlns:viz="http://www.gexf.net/1.2draft/viz" >',
            '    <graph mode="static" defaultedgetype="directed">', '        <nodes>']
    middle = ['        </nodes>', '        <edges>']
    tail = ['        </edges>', '    </graph>', '</gexf>']
    color = '<viz:color r="123" g="104" b="238" a="0.5" />'
    frame = spark.createDataFrame(
        [(section, i, line) for section, lines in ((0, head), (2, middle), (4, tail)) for i, line in enumerate(lines)],
        "section int, ord long, line string")
    label = lambda c: xml_label(F.col(c))
    node_line = F.format_string(f'            <node id = "%s" label = "%s"> {color} </node>', label("node"), label("node"))
    edge_line = F.format_string('            <edge id = "%s" source = "%s" target= "%s" label = "%s" />',
                                F.col("edge_id").cast("string"), label("src"), label("dst"), label("rel"))
    parts = (
        frame.unionByName(nodes.select(F.lit(1).alias("section"), F.col("first_seen").alias("ord"), node_line.alias("line")))
        .unionByName(edges.select(F.lit(3).alias("section"), F.col("edge_id").cast("long").alias("ord"), edge_line.alias("line"))))
    return parts.orderBy("section", "ord")


def export_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Ordered text parts; part files concatenate to one document in name order."""
    gexf_lines(nodes, edges).select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


RESULT_FIELDS = ["accuracy", "precision", "recall", "f1", "precision+", "recall+", "f1+", "model"]


def append_results(df: DataFrame, path: str) -> None:
    """Appends metric rows (a few per run) at three decimals; the header is written once, before the first rows."""
    spark = df.sparkSession
    shown = df.select(*[F.format_string("%.3f", F.col(f"`{c}`")).alias(c) if c != "model" else F.col(c) for c in RESULT_FIELDS])
    lines = shown.select(F.concat_ws("\t", *[F.col(f"`{c}`") for c in RESULT_FIELDS]).alias("value"))
    if not exists(spark, path):
        lines = spark.createDataFrame([("\t".join(RESULT_FIELDS),)], "value string").unionByName(lines)
    lines.coalesce(1).write.mode("append").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    cut = F.split("value", "\t")
    rows = spark.read.text(path).where(F.col("value") != "\t".join(RESULT_FIELDS))
    return rows.select(*[cut[i].alias(c) for i, c in enumerate(RESULT_FIELDS)])


def export_predictions(df: DataFrame, path: str, truth: str, prediction: str, features: list[str] = ()) -> None:
    rows = df.select(*features, F.col(truth).alias("truth"), F.col(prediction).alias("prediction"))
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's columns and rows that does not depend on the order of either; repeated rows count."""
    names = sorted(df.columns)
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
    hashed = df.select(F.xxhash64(F.lit(1), row).alias("a"), F.xxhash64(F.lit(2), row).alias("b"))
    sums = hashed.agg(F.count("*"), *[F.sum(F.col(c).cast("decimal(38,0)")) for c in "ab"], *[F.bit_xor(c) for c in "ab"]).first()
    return hashlib.sha256(repr([[(c, df.schema[c].dataType.simpleString()) for c in names], *sums]).encode()).hexdigest()[:32]


def cached(label: str, folder: str, build: Callable[..., DataFrame], *sources: DataFrame) -> DataFrame:
    """The stored result of ``build(*sources)`` for a label, built and written first unless it is there for just these rows.

    The sources' fingerprint, one pass over them, names the stored table: changed data is built anew, and a table that is
    still used by another run is never overwritten.
    """
    spark = sources[0].sparkSession
    path = f"{folder.rstrip('/')}/features-{label}-{hashlib.sha256(''.join(map(fingerprint, sources)).encode()).hexdigest()[:32]}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build(*sources).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
