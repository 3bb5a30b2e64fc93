import random
import zlib

from pyspark.sql import functions as F

from floodlens.llm.compression_classifier import compression_quality, fit, fit_on_table
from floodlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Ranks at least 95 of 100 pairs of the held-out fold rightly, and its probabilities are calibrated."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = (QUERIES["op4_compression_quality"](spark, SF).join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").collect())
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95
    assert sum(r.predicted == r.quality for r in got) > 0.95 * len(got)
    assert sum((r.score - r.quality) ** 2 for r in got) < 0.05 * len(got)


def test_fold_is_not_learnt_from(spark):
    """Labels of the held-out fold may say anything."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=60)) + "." if i % 2 else " ".join(["BUY NOW!!"] * 40)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    frame = lambda flip: spark.createDataFrame([(i, (1 - i % 2) if flip and i in held else i % 2, 0) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    a, b = (fit_on_table(docs, frame(f)) for f in (False, True))
    assert (a.good, a.bad, a.weights) == (b.good, b.bad, b.weights)
    got = compression_quality(docs, a).collect()
    assert all(r.held_out == (r.doc_id in held) and r.predicted == r.doc_id % 2 for r in got)


def test_edges(spark, docs, no_docs):
    model = fit(["a good text about things."] * 5, ["### $$$ %%%"] * 5)
    got = compression_quality(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out is None for r in got if r.doc_id is None)
    assert compression_quality(no_docs, model).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert compression_quality(docs, fit_on_table(docs, labels)).select(F.max("score")).first()[0] == 0.5
