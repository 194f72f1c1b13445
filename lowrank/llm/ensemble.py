"""Quality classifier: a sparse ensemble of rules (operator 9).

``text_features`` computes statistics of every whole text.  A random forest of
shallow trees is fitted on the labelled training rows; every path from a root
to a node is a rule, a conjunction of comparisons of statistics.  Lasso
logistic regression over the rules as 0/1 columns keeps few of them, and the
kept ones are compiled into one Spark column expression, which scores rows
without Python.  Fits are distributed (spark.ml) over all training rows.

Labels are learned only from rows whose ``crc32(doc_id as text) mod 5`` is not
0; ids, languages, sources and labels are no features.

Defined cases: null text is empty, and its statistics are 0; a null or missing
label does not train; repeated labels train each; without both classes
among the training rows the score is their smoothed share of label 1; rows
repeated with one doc_id are scored each; an empty table gives an empty
result; further columns are ignored (``keep_good`` keeps them).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lowrank.llm.common import by_value, read_table, save_table, text_blocks, text_bytes

by_value(__name__)

CUTOFF = 0.3
TREES, DEPTH, LASSO = 24, 3, 0.0005
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&<>@^~=+\\", "pipe": b"|", "bang": b"!?",
           "stop": b".", "comma": b",;:", "space": b" \t\r", "line": b"\n"}
FEATURES = ("log_bytes", "log_words", "word_bytes", "longest_word", "distinct_words", "top_word", "repeat_pairs", "capital_words",
            "stops_per_word", "lines_per_word", "distinct_lines", *(f"share_{c}" for c in CLASSES))


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)
    for i, c in enumerate(CLASSES.values()):
        table[list(c)] = i
    return table


def _word_features(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 6
    first = set(words)
    pairs = set(zip(words, words[1:]))
    top = max(Counter(words).values())
    return [math.log1p(n), float(max(map(len, first))), len(first) / n, top / n, 1 - len(pairs) / max(1, n - 1) if n > 1 else 0.0,
            sum(w[0].isupper() for w in words) / n]


def _statistics(texts: pa.LargeStringArray, table: np.ndarray) -> list[pa.Array]:
    """The columns ``FEATURES`` of a block of texts."""
    data, offs = text_bytes(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offs))
    k = len(CLASSES) + 1
    counts = np.bincount(doc * k + table[data], minlength=len(texts) * k).reshape(len(texts), k)
    size = np.maximum(np.diff(offs), 1)
    cols = {n: np.zeros(len(texts)) for n in FEATURES}
    for i, c in enumerate(CLASSES):
        cols[f"share_{c}"] = counts[:, i] / size
    cols["log_bytes"] = np.log1p(np.diff(offs))
    names = ("log_words", "longest_word", "distinct_words", "top_word", "repeat_pairs", "capital_words")
    texts = texts.to_pylist()
    got = np.array([_word_features(t) for t in texts]).reshape(len(texts), len(names))
    for i, n in enumerate(names):
        cols[n] = got[:, i]
    words = np.maximum(np.expm1(cols["log_words"]), 1)
    cols["word_bytes"] = (size - counts[:, list(CLASSES).index("space")]) / words
    cols["stops_per_word"] = counts[:, list(CLASSES).index("stop")] / words
    cols["lines_per_word"] = (counts[:, list(CLASSES).index("line")]) / words
    lines = [t.split("\n") for t in texts]
    cols["distinct_lines"] = np.array([len(set(x)) / len(x) for x in lines])
    return [pa.array(np.asarray(cols[n], np.float64)) for n in FEATURES]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _class_table()
    for rows, texts in text_blocks(batches, "text"):
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *_statistics(texts, table)], names=["doc_id", *FEATURES])


def _rows_and_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _class_table()
    for rows, texts in text_blocks(batches, "text"):
        whole = pa.StructArray.from_arrays(rows.columns, fields=list(rows.schema))
        yield pa.RecordBatch.from_arrays([whole, *_statistics(texts, table)], names=["whole_row", *FEATURES])


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_features, "doc_id long, " + ", ".join(f"{n} double" for n in FEATURES))


Rule = tuple[tuple[int, bool, float], ...]     # (feature, at most?, threshold) joined by and


def tree_rules(debug: str) -> list[Rule]:
    """Conjunctions of all paths from the root of a tree printed by spark.ml."""
    out, path = [], {}
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if m:
            depth = len(m[1])
            path = {d: c for d, c in path.items() if d < depth}
            path[depth] = (int(m[2]), m[3] == "<=", float(m[4]))
            out.append(tuple(sorted(path[d] for d in path)))
    return out


def rule_column(rule: Rule) -> Column:
    out = F.lit(True)
    for i, at_most, x in rule:
        out = out & (F.col(FEATURES[i]) <= x if at_most else F.col(FEATURES[i]) > x)
    return out


def fit_rules(train: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, [(rule, weight)]) from rows of statistics and ``quality``."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    n, good = train.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if not 0 < good < n:
        share = (good + 1) / (n + 2)
        return math.log(share / (1 - share)), []
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train).select("features", "quality", *FEATURES)
    forest = RandomForestClassifier(labelCol="quality", numTrees=trees, maxDepth=depth, maxBins=64, seed=1, featureSubsetStrategy="onethird").fit(rows)
    rules = sorted({r for t in forest.trees for r in tree_rules(t.toDebugString)})
    if not rules:
        share = good / n
        return math.log(share / (1 - share)), []
    matrix = train.select(F.col("quality").cast("double").alias("quality"),
                          array_to_vector(F.array(*[rule_column(r).cast("double") for r in rules])).alias("features"))
    matrix = save_table(matrix, "rules")
    fit = LogisticRegression(labelCol="quality", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(matrix)
    return float(fit.intercept), [(r, float(w)) for r, w in zip(rules, fit.coefficients) if abs(w) > 1e-9]


def score_column(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.when(rule_column(rule), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def _fit(stats: DataFrame, labels: DataFrame) -> tuple[float, list[tuple[Rule, float]]]:
    """The model of the labelled rows of a stored table that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    return fit_rules(save_table(stats.where(~held_out()).join(known, "doc_id"), "train"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score) of every row of ``docs``."""
    stats = save_table(text_features(docs), "features")
    return stats.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score_column(*_fit(stats, labels)).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` whose own text scores at least ``cutoff``: ids play
    no part in it, and no row moves (statistics are counted again beside it)."""
    model = _fit(save_table(text_features(docs), "features"), labels)
    schema = T.StructType([T.StructField("whole_row", docs.schema), *(T.StructField(n, T.DoubleType()) for n in FEATURES)])
    rows = docs.mapInArrow(_rows_and_features, schema)
    return rows.where(score_column(*model) >= cutoff).select("whole_row.*")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
