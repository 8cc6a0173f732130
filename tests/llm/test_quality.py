"""op6: held-out accuracy, and the compiled rules against numpy."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from wefthread.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_held_out_accuracy(spark):
    rows = quality.op6_quality(spark, "/root/testdata/sf0.1").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    good = [p for y, p, _ in held if y == 1]
    bad = [p for y, p, _ in held if y == 0]
    print(len(good), len(bad), sum(good) / len(good), sum(bad) / len(bad))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2


def test_compiled_rules_equal_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    table = quality.with_statistics(docs, ["doc_id"]).withColumn("score", model.column()).toPandas()
    x = table[[f"__s_{n}" for n in quality.NAMES]].to_numpy()
    assert np.allclose(model.score(x), table["score"].to_numpy())


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (2, "", "", "", 0), (None, "a b", "", "", 0), (5, "é " * 50_000, "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as score", "2 as quality")
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.score_quality(docs, labels).collect()) == 5
    assert len(quality.score_quality(docs, labels.limit(0)).collect()) == 5
    assert quality.score_quality(docs.limit(0), labels).collect() == []
    kept = quality.keep_good(docs.drop("score", "quality"), labels.limit(0))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == 5
    assert quality.fold(F.lit(7)) is not None
