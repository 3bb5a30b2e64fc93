"""Predictions, deny-list replay and its evaluation.

A chunk is scored when the next non-empty window begins. The packet that begins it is
still judged by the old deny list, but already carries the new loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from floodlens.functions.blocks import BLOCK_ROWS, asof_last
from floodlens.operators.windows import Calendar
from floodlens.options import NS_PER_S


def decide(scored: DataFrame, threshold: float | None, loss: str = "loss") -> DataFrame:
    """``loss < threshold`` is benign. Without a threshold the score itself is the decision."""
    if threshold is None:
        return (scored.withColumn("is_attack", (F.col(loss) != 0).cast("int"))
                .withColumn(loss, F.lit(0.0)))
    return scored.withColumn("is_attack", F.when(F.col(loss) < threshold, 0).otherwise(1))


def predictions(scored: DataFrame, calendar: Calendar, threshold: float | None) -> DataFrame:
    """Add the trigger: first packet of the window after the chunk's last one."""
    when = calendar.windows.select(F.col("window_id").alias("last_window_id"),
                                   F.col("next_frame").alias("trigger_frame"),
                                   F.col("next_ts").alias("trigger_ts"))
    origin = calendar.origin if calendar.origin is not None else 0
    return (decide(scored, threshold).join(when, "last_window_id")
            .select("src_ip", "chunk_id", "trigger_frame", "trigger_ts",
                    (F.col("trigger_ts") - F.lit(origin)).alias("elapsed_ns"),
                    "loss", "is_attack"))


def packet_loss(packets: DataFrame, preds: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Latest loss of the source at each packet (0 before its first score)."""
    marks = preds.select("src_ip", F.col("trigger_frame").alias("frame_no"), "loss")
    return (asof_last(packets, marks, ["src_ip"], "frame_no", ["loss"], block_rows=block_rows)
            .withColumn("loss", F.coalesce("loss", F.lit(0.0))))


def first_detection(preds: DataFrame) -> DataFrame:
    return preds.filter("is_attack = 1").groupBy("src_ip").agg(
        F.min("trigger_frame").alias("denied_from"))


def packet_decisions(packets: DataFrame, preds: DataFrame) -> DataFrame:
    """``denied`` from the packet after the first positive on, for good.

    At most one row per source on the right; a hot source on the left is split by AQE.
    """
    denied = F.coalesce(F.col("frame_no") > F.col("denied_from"), F.lit(False))
    return (packets.join(first_detection(preds), "src_ip", "left")
            .withColumn("denied", denied).drop("denied_from"))


def detection_counts(preds: DataFrame) -> DataFrame:
    return preds.groupBy("src_ip").agg(
        F.count_if(F.col("is_attack") == 1).alias("detections_pos"),
        F.count_if(F.col("is_attack") == 0).alias("detections_neg"))


def detection_delay(preds: DataFrame) -> DataFrame:
    """Whole seconds until the first positive; a rounded 0 gives way to a later positive."""
    seconds = F.bround(F.col("elapsed_ns") / NS_PER_S).cast("long")
    pos = preds.filter("is_attack = 1").select("src_ip", "trigger_frame", seconds.alias("_s"))
    return pos.groupBy("src_ip").agg(F.coalesce(
        F.min_by(F.col("_s"), F.when(F.col("_s") != 0, F.col("trigger_frame"))),
        F.lit(0)).alias("detected_after"))


def mitigation_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("src_ip").agg(
        F.count_if(~F.col("denied")).alias("pkts_allowed"),
        F.count_if(F.col("denied")).alias("pkts_denied"))


def ip_stats(packets: DataFrame, preds: DataFrame) -> DataFrame:
    """One row per source of the input, zeros where it was never scored."""
    stats = (mitigation_counts(packet_decisions(packets, preds))
             .join(detection_counts(preds), "src_ip", "left")
             .join(detection_delay(preds), "src_ip", "left"))
    return stats.select("src_ip", *[F.coalesce(n, F.lit(0)).alias(n) for n in (
        "detected_after", "detections_pos", "detections_neg", "pkts_allowed", "pkts_denied")])


def label_sources(stats: DataFrame, attackers: DataFrame) -> DataFrame:
    marks = attackers.select("src_ip", F.lit(1).alias("_hit")).distinct()
    return (stats.join(marks, "src_ip", "left")
            .withColumn("label", F.when(F.col("_hit").isNotNull(), "Attack").otherwise("Benign"))
            .drop("_hit"))


def _real(name: str) -> Column:
    return F.col("label") == name


def _scored() -> Column:
    return (F.col("detections_pos") > 0) | (F.col("detections_neg") > 0)


def caught() -> Column:
    """A source caught for good: detected, and at least four denied packets per allowed one."""
    return (F.col("detections_pos") > 0) & (F.col("pkts_denied") >= F.col("pkts_allowed") * 4)


def spared() -> Column:
    """A source scored as benign only."""
    return (F.col("detections_neg") > 0) & (F.col("detections_pos") == 0)


def attacker_success(labelled: DataFrame) -> DataFrame:
    return labelled.filter(_real("Attack")).select(
        "src_ip", _scored().alias("processed"), caught().alias("successful"))


def legit_success(labelled: DataFrame) -> DataFrame:
    return labelled.filter(_real("Benign")).select(
        "src_ip", _scored().alias("processed"), spared().alias("successful"))


def _sum_if(cond: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(name))), F.lit(0))


def confusion(labelled: DataFrame) -> DataFrame:
    attack, benign = _real("Attack"), _real("Benign")
    return labelled.agg(
        _sum_if(attack & caught(), "detections_pos").alias("tp"),
        _sum_if(benign & spared(), "detections_neg").alias("tn"),
        _sum_if(benign & (F.col("detections_pos") > 0), "detections_pos").alias("fp"),
        _sum_if(attack & (F.col("detections_neg") > 0), "detections_neg").alias("fn"),
        F.coalesce(F.sum(F.col("detections_pos") + F.col("detections_neg")), F.lit(0))
        .alias("classified"))


def classification_metrics(labelled: DataFrame) -> DataFrame:
    """Null where the denominator is zero."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion(labelled).select(
        F.try_divide(tp + F.col("tn"), F.col("classified")).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.when(tp + fp != 0, F.try_divide(tp, tp + fn)).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("fscore"))


def packet_metrics(labelled: DataFrame) -> DataFrame:
    attack, benign = _real("Attack"), _real("Benign")
    total = F.col("pkts_allowed") + F.col("pkts_denied")
    sums = labelled.agg(
        _sum_if(attack, "pkts_denied").alias("attack_denied"),
        F.coalesce(F.sum(F.when(attack, total)), F.lit(0)).alias("attack_pkts"),
        _sum_if(benign, "pkts_allowed").alias("legit_allowed"),
        F.coalesce(F.sum(F.when(benign, total)), F.lit(0)).alias("legit_pkts"))
    return sums.select(
        "*", F.coalesce(F.try_divide("attack_denied", "attack_pkts"), F.lit(1.0))
        .alias("attack_denied_ratio"),
        F.try_divide("legit_allowed", "legit_pkts").alias("legit_allowed_ratio"))


def detected_ratio(labelled: DataFrame) -> DataFrame:
    attack, hit = _real("Attack"), F.col("detections_pos") > 0
    return labelled.agg(
        F.coalesce(F.try_divide(F.count_if(attack & hit), F.count_if(attack)), F.lit(1.0))
        .alias("attackers_detected"),
        F.count_if(hit & (F.col("detections_neg") > 0)).alias("hosts_both"))


def evaluation_report(labelled: DataFrame) -> DataFrame:
    attack, benign = _real("Attack"), _real("Benign")
    return labelled.agg(
        F.coalesce(F.sum(F.col("detections_pos") + F.col("detections_neg")), F.lit(0))
        .alias("classifications"),
        F.count_if(attack & caught()).alias("attackers_successful"),
        F.count_if(attack & _scored()).alias("attackers_processed"),
        F.count_if(attack).alias("attackers_all"),
        F.count_if(benign & spared()).alias("legit_successful"),
        F.count_if(benign & _scored()).alias("legit_processed"),
        F.count_if(benign).alias("legit_all"))
