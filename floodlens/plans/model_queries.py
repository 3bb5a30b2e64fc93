"""Queries of the model operators, on the embedding table and on feature rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.operators import model
from floodlens.plans.oracle_parts import part, rounded, sql
from floodlens.plans.registry import query
from floodlens.session import scratch_path
from floodlens.sources import sinks, vectors

#: The first and the next two fifths of the rows are the learning phases, however many there are.
_MAP = "(SELECT count(*) // 5 FROM vec)"

part("vec", "SELECT vec_id AS row_no, embedding AS vector FROM embeddings")
part("long_vec", """SELECT row_no, CAST(unnest(range(len(vector))) AS BIGINT) AS i,
  CAST(unnest(vector) AS DOUBLE) AS x FROM vec""")


def _vectors(c):
    return c.table("embeddings").select(F.col("vec_id").alias("row_no"),
                                        F.col("embedding").cast("array<double>").alias("vector"))


def _phases(c):
    fifth = c.table("embeddings").count() // 5
    return fifth, 2 * fifth


def _model(c):
    phased = model.phase_split(_vectors(c), *_phases(c))
    return model.ensemble_fit(phased.filter("phase <> 'score'"))


@query("feature_corr_distance", sql(f"""SELECT a.i, b.i AS j,
  {rounded('greatest(0, 1 - corr(a.x, b.x))', 'distance')}
  FROM long_vec a JOIN long_vec b ON a.row_no = b.row_no AND a.i < b.i GROUP BY a.i, b.i"""))
def feature_corr_distance(c):
    return model.feature_distances(_vectors(c)).select(
        F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "distance")


@query("feature_corr_shifted", sql(f"""SELECT a.i, b.i AS j,
  {rounded('greatest(0, 1 - corr(a.x, b.x))', 'distance')}
  FROM long_vec a JOIN long_vec b ON a.row_no = b.row_no AND a.i < b.i GROUP BY a.i, b.i"""))
def feature_corr_shifted(c):
    """Distances do not change when every feature moves by 2^20."""
    moved = _vectors(c).withColumn("vector", F.transform("vector", lambda x: x + 2.0 ** 20))
    return model.feature_distances(moved).select(
        F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "distance")


part("run_res", """SELECT row_no, i, x - avg(x) OVER (PARTITION BY i ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS r FROM long_vec""")


@query("feature_corr_running", sql(f"""SELECT a.i, b.i AS j,
  {rounded('greatest(0, 1 - sum(a.r * b.r) / (sqrt(sum(a.r * a.r)) * sqrt(sum(b.r * b.r))))', 'distance')}
  FROM run_res a JOIN run_res b ON a.row_no = b.row_no AND a.i < b.i GROUP BY a.i, b.i"""))
def feature_corr_running(c):
    return model.running_distances(_vectors(c)).select(
        F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "distance")


@query("feature_groups")
def feature_groups(c):
    groups = model.group_features(model.running_distances(_vectors(c)))
    return c.spark.createDataFrame([(g, i) for g, m in enumerate(groups) for i in m],
                                   "grp int, feature int")


@query("minmax_norm", sql(f"""SELECT row_no, i, {rounded(
    '(x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w + 1e-16)', 'x')}
  FROM long_vec WINDOW w AS (PARTITION BY i)"""))
def minmax_norm(c):
    return model.minmax_norm(_vectors(c)).select("row_no", F.posexplode("vector").alias("i", "x"))


@query("phase_split", sql(f"""SELECT row_no, CASE WHEN row_no <= {_MAP} THEN 'map'
  WHEN row_no <= 3 * {_MAP} THEN 'train' ELSE 'score' END AS phase FROM vec"""))
def phase_split(c):
    return model.phase_split(_vectors(c).select("row_no"), *_phases(c))


@query("ensemble_fit")
def ensemble_fit(c):
    return _model(c).select("layer", "grp", F.size("members").alias("width"),
                            F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x).alias("w_norm"))


@query("ensemble_denoising")
def ensemble_denoising(c):
    """Training with a fifth of the inputs hidden; the mask is a hash of row, step and feature."""
    rows = model.phase_split(_vectors(c), *_phases(c)).filter("phase <> 'score'")
    groups = [list(range(k, k + 8)) for k in range(0, 64, 8)]
    return model.ensemble_fit(rows, groups, rounds=5, corruption=0.2).select(
        "layer", "grp", F.size("members").alias("width"), F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x).alias("w_norm"))


@query("ensemble_score")
def ensemble_score(c):
    return model.process(_vectors(c), _model(c), *_phases(c)).select(
        "row_no", "phase", "loss")


@query("model_roundtrip")
def model_roundtrip(c):
    path = scratch_path(c.spark, "model")
    model.save_model(_model(c), path)
    return model.ensemble_score(_vectors(c), model.load_model(c.spark, path)).select("row_no", "loss")


@query("score_with", sql(f"""SELECT src_ip, chunk_id,
  {rounded('0.5 * pkt_size_avg - 2 * port_src_entropy + 3 * proto_tcp_share', 'loss')} FROM feat"""))
def score_with(c):
    """A linear model as the pluggable function."""
    names = ["pkt_size_avg", "port_src_entropy", "proto_tcp_share"]
    return model.score_with(c.features.select("src_ip", "chunk_id", *names),
                            lambda x: x @ [0.5, -2.0, 3.0], names).drop(*names)


# --- vector files --------------------------------------------------------------------

@query("scan_vectors_csv", sql(f"SELECT row_no, i, {rounded('x')} FROM long_vec"))
def scan_vectors_csv(c):
    path = scratch_path(c.spark, "vectors-csv")
    sinks.write_vectors(_vectors(c), path, fmt="csv")
    return vectors.read_csv(c.spark, path, 64).select("row_no", F.posexplode("vector").alias("i", "x"))


@query("scan_vectors_parquet", sql(f"SELECT row_no, i, {rounded('x')} FROM long_vec"))
def scan_vectors_parquet(c):
    path = scratch_path(c.spark, "vectors")
    sinks.write_vectors(_vectors(c), path)
    return vectors.read_parquet(c.spark, path).select("row_no", F.posexplode("vector").alias("i", "x"))


@query("vector_sink", sql(f"SELECT row_no, len(vector) AS width, {rounded('list_sum(vector)', 'total')} FROM vec"))
def vector_sink(c):
    back = sinks.write_vectors(_vectors(c))
    return back.select("row_no", F.size("vector").cast("long").alias("width"),
                       F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("multi_scan_limit", sql(f"""SELECT file_no, row_no, {rounded('list_sum(vector)', 'total')} FROM (
  SELECT 0 AS file_no, * FROM vec WHERE row_no % 2 = 0 UNION ALL
  SELECT 1, * FROM vec WHERE row_no % 2 = 1) v ORDER BY file_no, row_no LIMIT 300"""))
def multi_scan_limit(c):
    even, odd = (_vectors(c).filter(F.col("row_no") % 2 == k) for k in (0, 1))
    both = vectors.read_many([even, odd], 300)
    return both.select("file_no", "row_no",
                       F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("dataset_sink", sql(f"""SELECT src_ip, chunk_id, {rounded('pkt_rate')},
  CASE WHEN src_ip IN (SELECT src_ip FROM attackers) THEN 1 ELSE 0 END AS target FROM feat"""))
def dataset_sink(c):
    from floodlens.operators.prepare import label_packets

    rows = label_packets(c.features.select("src_ip", "chunk_id", "pkt_rate"), c.attackers, "target")
    return sinks.write_dataset(rows, separate=True)
