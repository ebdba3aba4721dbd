"""Steps that large tables need: batch functions, shared passes, small rows between steps."""

import gc

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from claimlens.functions.readings import clause_reading, whole_reading
from claimlens.operators import graphs, hidden, models, parsed

WORD = ["id", "text", "upos", "xpos", "head", "deprel", "feats", "start_char", "end_char"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def word(*values):
    return dict(zip(WORD, values))


def test_readings_are_made_by_batches(spark):
    """parser and both readings run in one batch step, and parts are read once."""
    from claimlens.plans import queries_spo

    rows = spark.createDataFrame([(1, 'Mr Smith, causing much loss, left'), (2, 'He said "the rain causes floods" and left'), (3, "..."), (4, None)], "id long, sentence string")
    out = parsed.spo_cascade(queries_spo.parse_parts(parsed.reading_parts(rows)))
    assert plan(out).count("ArrowEvalPython [both_readings(dependency_rows(") == 1
    assert {r["id"]: tuple(r)[1:] for r in out.collect()} == {
        1: ("sentence", "Smith", "causing", "left", "Mr Smith", "causing", "much loss left"), 2: ("quoted text", "rain", "causes", "floods", "the rain", "causes", "floods")}


def test_readings_of_odd_words():
    """missing values, words out of order, glued helpers and empty rows of a batch."""
    whole = [
        None, [], [None],
        [word(1, "It", "PRON", "PRP", 3, "nsubj", "", 0, 2), word(2, "ca", "AUX", "MD", 3, "aux", "", 3, 5), word(3, "n't", "VERB", "VB", 0, "root", "", 5, 8),
         word(4, None, "PART", "RP", 3, "prt", "", 9, 11), word(5, "harm", "NOUN", "NN", 3, "obj", "", 12, 16)],
        [word(1, "A", "NOUN", "NN", 2, "nsubj", "", 0, 1), word(2, "is", "AUX", "VBZ", 3, "aux", "", 2, 4), word(3, "ran", "VERB", "VB", 0, "root", "", 5, 8),
         word(3, "A", "NOUN", "NN", 3, "nsubj", "", 0, 1), word(4, "not", "PART", "RB", 3, "adv", "", 8, 11), word(5, None, "DET", "DT", 3, "det", "", 12, 13),
         word(6, "x", "ADJ", "JJ", 3, None, "", 12, 13), word(7, "big", "ADJ", "JJ", 3, "xcomp", "", 14, 17), None],
        [word(None, "go", "VERB", "VB", 0, "root", "", 0, 1), word(2, "a", "NOUN", "NN", None, "nsubj", "", 0, 1), word(3, "b", "NOUN", "NN", None, "obj", "", 0, 1)]]
    kind = pa.list_(pa.struct([(c, pa.int32() if c in ("id", "head", "start_char", "end_char") else pa.string()) for c in WORD]))
    names = ["subject", "predicate", "object", "big_subject", "big_predicate", "big_object"]
    found = [r and [r[n] for n in names] for r in whole_reading(pa.array(whole, kind)).to_pylist()]
    assert found == [None, None, None, ["It", "n't", "harm", "It", None, "harm"], ["A", "ran", "big", "", "is rannot", ""], None]
    assert [r and [r[n] for n in names] for r in clause_reading(pa.array(whole, kind)).to_pylist()] == [*found[:4], None, None]


def test_triple_file_is_made_in_one_pass(spark, data):
    """both layouts come from one reading of the sentences, and concepts travel with what their labels are made of."""
    from claimlens.plans.queries_graphs import graph

    rows = graph(spark, data).where("item_id < 20")
    out = graphs.triple_rows(rows, by_token=None)
    assert plan(out).count("[word_spans(") == 1
    names = [c for c in out.columns if c != "layout"]
    for layout, by_token in (("by token", True), ("joined", False)):
        alone = sorted(map(tuple, graphs.triple_rows(rows, by_token).select(names).collect()))
        assert alone and alone == sorted(map(tuple, out.where(F.col("layout") == layout).select(names).collect()))
    tokens = spark.createDataFrame([([("w", "C1", "n", "st", "T", "Ty", "DISO"), ("v", "[UNK]", "n", "st", "T", "Ty", "DISO"), None],), (None,)],
                                   "x array<struct<token_text:string,cui:string,preferred:string,sem_type:string,tui:string,type_name:string,group:string>>")
    kept = tokens.select(graphs._read(F.col("x"), "cui").alias("x"))
    assert kept.schema["x"].dataType.elementType.names == ["cui", "group"]
    assert [r["x"] and [tuple(c) for c in r["x"]] for r in kept.collect()] == [[("C1", "DISO")], None]


def test_triple_file_without_labels(spark):
    """a sentence without labels, or with none known, still has both joined rows."""
    labels = "norm_s array<string>, norm_o array<string>, subject_groups array<string>, object_groups array<string>"
    rows = spark.createDataFrame([(1, 10, "a", "b c", "is", None, ["[x]"], ["G"], None), (1, 11, None, "d", "had", ["[s]", "[t]"], None, ["G"], ["H", "I"]),
                                  (2, 12, "e", "f", None, ["[s]"], ["[o]", None], ["G"], ["H", "I"])],
                                 f"item_id long, id long, big_subject string, big_object string, norm_p string, {labels}")
    found = sorted((tuple(r) for r in graphs.triple_rows(rows, by_token=None).collect()), key=str)
    names = ["item_id", "sentence_id", "layout", "subject", "predicate", "object", "subject_groups", "object_groups"]
    assert graphs.triple_rows(rows, by_token=None).columns == names
    assert found == sorted([
        (1, 10, "joined", "a", "is", "b c", "", ""), (1, 10, "joined", None, "is", "[x]", "", ""), (1, 11, "joined", None, "had", "d", "", ""),
        (1, 11, "joined", "[s] [t]", "had", None, "", ""), (2, 12, "joined", "e", None, "f", "", ""), (2, 12, "joined", "[s]", None, "[o]", "", ""),
        (2, 12, "by token", "[s]", None, "[o]", "G", "H,I"), (2, 12, "by token", "[s]", None, None, "G", "H,I")], key=str)


def test_hidden_layer_scores_sparse_rows(spark):
    """F2: scores are those of Spark's model, from the non-zero entries; runs of entries of any length are summed."""
    from pyspark.ml.classification import MultilayerPerceptronClassificationModel

    rows = spark.createDataFrame([(f"word{i % 5} other{i % 3} " + "more " * (i % 2), int(i % 5 > 2)) for i in range(60)] + [("", 0)], "text string, label int")
    model = models.text_classifier(rows, 2, hidden=4, width=64, iterations=5)
    head, ready = model.stages[-1], PipelineModel(model.stages[:-1]).transform(rows)
    dense = spark.createDataFrame([("dense", 1, Vectors.dense([i / 64 for i in range(64)]))], ["text", "label", "features"])
    ready = ready.select("text", "label", "features").unionByName(dense)
    out = head.transform(ready)
    assert "score(features" in plan(out) and head.transform(ready).columns == [*ready.columns, "rawPrediction", "probability", "prediction"]
    gc.collect()  # the trainer's own model goes; what scores has to stay
    own = MultilayerPerceptronClassificationModel(head._java_obj.copy(head._empty_java_param_map())).transform(ready).collect()
    for a, b in zip(out.collect(), own):
        assert a["prediction"] == b["prediction"] and np.allclose(a["probability"], b["probability"]) and np.allclose(a["rawPrediction"], b["rawPrediction"])
    table, sizes = np.arange(20.0).reshape(10, 2), np.array([3, 0, 1, 700, 3])
    places, entries = np.arange(sizes.sum()) % 10, np.arange(sizes.sum()) / 100
    runs = np.split(table[places] * entries[:, None], np.cumsum(sizes)[:-1])
    assert np.allclose(hidden._run_sums(table, places, entries, sizes), [r.sum(axis=0) for r in runs])
