"""Queries of the window, history, feature and mitigation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.operators import features, history, mitigation, windows
from floodlens.plans.oracle_parts import feature_sql, part, rounded, sql
from floodlens.plans.registry import DAY_NS, query
from floodlens.schemas import INTERWINDOW, SUMMARY, WINDOW_STATS

KEY = ("src_ip", "window_id")
INTEGERS = {
    "window_id", "pkts_total", "bytes_total", "tstamp_start", "tstamp_end", "pkt_size_min",
    "pkt_size_max", "tcp_pkt_count", "udp_pkt_count", "icmp_pkt_count", "port_src_unique",
    "pkts_frag_count",
}


def _cols(names, integers=frozenset()):
    out = []
    for n in names:
        if n in integers:
            out.append(n)
        elif n.startswith("pkt_arrivals_"):
            out.append(f"round({n} / {DAY_NS}.0, 9) + 0.0 AS {n}")
        else:
            out.append(rounded(n))
    return ", ".join(out)


def _window_sql(*names):
    return sql(f"SELECT src_ip, window_id, {_cols(names, INTEGERS)} FROM win")


def _window_query(name, *measures):
    @query(name, _window_sql(*measures))
    def run(c):
        return c.windows.select(*KEY, *measures)
    return run


_window_query("window_volume", "pkts_total", "bytes_total")
_window_query("window_bounds", "tstamp_start", "tstamp_end")
_window_query("window_iat", "pkt_arrivals_avg", "pkt_arrivals_std")
_window_query("window_sizes", "pkt_size_min", "pkt_size_max", "pkt_size_avg", "pkt_size_std")
_window_query("window_protocols", "tcp_pkt_count", "udp_pkt_count", "icmp_pkt_count")
_window_query("window_frag", "pkts_frag_count")
_window_query("window_hdr_ratio", "hdrs_payload_ratio_avg")


@query("window_stats", sql(f"SELECT src_ip, cell, {_cols(WINDOW_STATS, INTEGERS)} FROM win"))
def window_stats(c):
    return windows.window_stats(c.packets, c.opts)


@query("window_assign", sql("SELECT frame_no, src_ip, cell FROM celled"))
def window_assign(c):
    return windows.assign_windows(c.packets, c.opts, c.calendar).select(
        "frame_no", "src_ip", "cell")


part("delayed", f"""SELECT *, max(ts_ns) OVER (ORDER BY frame_no) AS open_ns FROM (
  SELECT frame_no, src_ip, CASE WHEN frame_no % 7 = 3 THEN ts_ns - {8 * DAY_NS // 5} ELSE ts_ns END AS ts_ns FROM packets) l""")
part("arrived", f"""SELECT *, (open_ns - first) // {DAY_NS} AS cell, floor((ts_ns - first) / {DAY_NS}.0) AS own
  FROM delayed, (SELECT min(open_ns) AS first FROM delayed) o""")


@query("late_into_open_window", sql("""SELECT a.src_ip, i.window_id, count(*) AS pkts_total,
  CAST(sum(CASE WHEN a.own < a.cell THEN 1 ELSE 0 END) AS BIGINT) AS late FROM arrived a JOIN (
    SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS window_id FROM (SELECT DISTINCT cell FROM arrived) c) i ON i.cell = a.cell
  GROUP BY a.src_ip, i.window_id"""))
def late_into_open_window(c):
    """Every seventh packet comes 1.6 windows late."""
    late = F.col("ts_ns") - F.when(F.col("frame_no") % 7 == 3, 8 * DAY_NS // 5).otherwise(0)
    rows, calendar = windows.arrival_windows(c.packets.withColumn("ts_ns", late), c.opts)
    own = F.floor((F.col("ts_ns") - calendar.origin) / F.lit(float(DAY_NS)))
    return (rows.groupBy("src_ip", "cell").agg(F.count(F.lit(1)).alias("pkts_total"), F.count_if(own < F.col("cell")).alias("late"))
            .join(calendar.windows.select("cell", "window_id"), "cell").select("src_ip", "window_id", "pkts_total", "late"))


@query("window_ordinals",
       sql("SELECT cell, window_id, first_frame, first_ts, coalesce(next_frame, -1) AS next_frame, "
           "coalesce(next_ts, -1) AS next_ts FROM ids"))
def window_ordinals(c):
    return c.calendar.windows.fillna(-1, ["next_frame", "next_ts"])


@query("closed_windows", sql("SELECT frame_no, src_ip, cell FROM closed"))
def closed_windows(c):
    return c.closed.select("frame_no", "src_ip", "cell")


@query("window_qualified", sql("SELECT src_ip, cell, pkts_total FROM all_windows "
                               "WHERE pkts_total >= 2"))
def window_qualified(c):
    return (c.closed.groupBy("src_ip", "cell").agg(F.count(F.lit(1)).alias("pkts_total"))
            .filter(F.col("pkts_total") >= c.opts.packets_min))


@query("window_ports_exact", sql("SELECT src_ip, cell, port_src_unique FROM all_windows"))
def window_ports_exact(c):
    return windows.port_stats(c.closed).select("src_ip", "cell", "port_src_unique")


@query("window_ports_approx")
def window_ports_approx(c):
    """Sketch estimate; its error bound is tested."""
    aggs = windows.port_sketches()
    return c.closed.groupBy("src_ip", "cell").agg(
        F.hll_sketch_estimate(aggs["_ports_sketch"][0]).alias("port_src_unique"))


@query("window_entropy",
       sql(f"SELECT src_ip, cell, {rounded('port_src_entropy')} FROM port_entropy"))
def window_entropy(c):
    return windows.port_stats(c.closed).select("src_ip", "cell", "port_src_entropy")


@query("window_entropy_sampled", sql(f"""SELECT src_ip, cell,
  {rounded("CASE WHEN sum(c) = 1 THEN 0 ELSE -sum((c / n) * log2(c / n)) / log2(sum(c)) END",
           'port_src_entropy')}
  FROM (SELECT src_ip, cell, src_port, count(*) AS c,
          sum(count(*)) OVER (PARTITION BY src_ip, cell) AS n
        FROM (SELECT *, row_number() OVER (PARTITION BY src_ip, cell
                ORDER BY md5(concat(CAST(frame_no AS VARCHAR), ':7')), frame_no) AS r FROM closed) s
        WHERE r <= 3 GROUP BY src_ip, cell, src_port) x GROUP BY src_ip, cell"""))
def window_entropy_sampled(c):
    """Three ports per window, so that the sample is smaller than the windows."""
    return windows.sampled_entropy(c.closed, 3)


@query("window_conn", sql(f"SELECT src_ip, cell, {rounded('conn_pkts_avg')} FROM all_windows"))
def window_conn(c):
    return windows.port_stats(c.closed).select("src_ip", "cell", "conn_pkts_avg")


# --- history -------------------------------------------------------------------------

@query("history_rank", sql("SELECT src_ip, window_id, rn AS rank FROM ranked"))
def history_rank(c):
    return history.history_rank(c.windows, c.opts).select(*KEY, "rank")


@query("history_ready", sql("SELECT src_ip, window_id, ok AS ready FROM ranked"))
def history_ready(c):
    return history.history_ready(c.windows, c.opts)


@query("history_chunks", sql("SELECT src_ip, window_id, chunk_id FROM chunks"))
def history_chunks(c):
    return history.history_chunks(c.windows, c.opts).select(*KEY, "chunk_id")


@query("ready_sources", sql("SELECT DISTINCT src_ip FROM ranked WHERE ok"))
def ready_sources(c):
    return history.ready_sources(c.windows, c.opts)


@query("history_valid_suffix", sql(
    "SELECT src_ip, window_id FROM ranked WHERE rn_desc <= 6 OR "
    "(SELECT max(ts_ns) FROM packets) - tstamp_start < 12 * 86400000000000"))
def history_valid_suffix(c):
    now = c.packets.agg(F.max("ts_ns")).first()[0]
    return history.valid_suffix(c.windows, now, c.opts).select(*KEY)


@query("history_last_n", sql("SELECT src_ip, window_id FROM ranked WHERE rn_desc <= 8"))
def history_last_n(c):
    return history.last_windows(c.windows, 8, c.opts).select(*KEY)


@query("history_dump", sql(
    "SELECT src_ip, chunk_id, window_id, "
    "row_number() OVER (PARTITION BY src_ip, chunk_id ORDER BY window_id) - 1 AS pos, "
    f"pkts_total, bytes_total, {rounded('port_src_entropy')} FROM chunks"))
def history_dump(c):
    dumped = history.dump_windows(c.chunked)
    return (dumped.select("src_ip", "chunk_id", F.posexplode("windows").alias("pos", "w"))
            .select("src_ip", "chunk_id", "pos", "w.window_id", "w.pkts_total", "w.bytes_total",
                    "w.port_src_entropy"))


@query("history_expanding", sql(f"""SELECT src_ip, window_id, window_count,
  {rounded('a', 'pkts_total_mean')}, {rounded('b', 'bytes_total_mean')},
  {rounded('d', 'pkt_size_avg_mean')} FROM (
  SELECT src_ip, window_id, ok, count(*) OVER w AS window_count, avg(pkts_total) OVER w AS a,
    avg(bytes_total) OVER w AS b, avg(pkt_size_avg) OVER w AS d FROM ranked
  WINDOW w AS (PARTITION BY src_ip ORDER BY window_id)) x WHERE ok"""))
def history_expanding(c):
    return history.expanding_history(c.windows, c.opts)


# --- features ------------------------------------------------------------------------

FEATURE_INTS = {"window_count", "window_span", "pkt_size_min", "pkt_size_max"}


def _feature_query(name, *measures):
    @query(name, sql(f"SELECT src_ip, chunk_id, {_cols(measures, FEATURE_INTS)} FROM feat"))
    def run(c):
        return c.features.select("src_ip", "chunk_id", *measures)
    return run


_feature_query("summary_core", "window_count", "window_span", "pkts_total", "bytes_total",
               "pkt_size_min", "pkt_size_max")
_feature_query("summary_rates", "pkt_rate", "byte_rate")
_feature_query("summary_means", "pkt_arrivals_avg", "pkt_arrivals_std", "pkt_size_avg",
               "pkt_size_std", "port_src_unique", "port_src_entropy", "conn_pkts_avg",
               "hdrs_payload_ratio_avg")
_feature_query("summary_shares", "proto_tcp_share", "proto_udp_share", "proto_icmp_share",
               "pkts_frag_share")
_feature_query("interwindow_std", *[n for n in INTERWINDOW[:10]])
_feature_query("dominant_proto", "dominant_proto_ratio_std")
_feature_query("activity_ratios", "intrawindow_activity_ratio", "interwindow_activity_ratio")
ALL = [*SUMMARY, *INTERWINDOW]


@query("summary_truncated", sql("""SELECT src_ip, chunk_id, floor(pkts_total) AS pkts_total,
  floor(bytes_total) AS bytes_total FROM feat"""))
def summary_truncated(c):
    """Mean totals as whole numbers, as a record of integers stores them."""
    return features.summarise(c.chunked, c.opts, truncate_totals=True).select(
        "src_ip", "chunk_id", "pkts_total", "bytes_total")


@query("chain_decisions", sql(f"""SELECT src_ip, chunk_id, {rounded('x', 'loss')},
  CASE WHEN x < 300 THEN 0 ELSE 1 END AS is_attack
  FROM (SELECT src_ip, chunk_id, 0.5 * pkt_size_avg + 2 * pkt_size_std AS x FROM feat) y"""))
def chain_decisions(c):
    """Model inputs, a pluggable model and the decision in one chain."""
    from floodlens.operators.model import score_with

    names = ["pkt_size_avg", "pkt_size_std"]
    scored = score_with(c.features.select("src_ip", "chunk_id", *names), lambda x: x @ [0.5, 2.0], names)
    return mitigation.decide(scored, 300.0).drop(*names)


part("grown", """SELECT k.src_ip, k.window_id AS ready_id, r.* EXCLUDE (src_ip, ok) FROM ranked k JOIN ranked r
  ON r.src_ip = k.src_ip AND r.rn <= k.rn WHERE k.ok""")
part("grown_feat", feature_sql("src_ip, ready_id", "grown"))
part("fresh", f"""SELECT * FROM ranked WHERE rn_desc <= 6 OR
  (SELECT max(ts_ns) FROM packets) - tstamp_start < 12 * {DAY_NS}""")
part("fresh_feat", feature_sql("src_ip", "fresh"))
part("newest", "SELECT * FROM ranked WHERE rn_desc <= 8")
part("newest_feat", feature_sql("src_ip", "newest"))


def _settled(n: str) -> str:
    return _cols([n], FEATURE_INTS) if n in FEATURE_INTS or n.startswith("pkt_arrivals_") else rounded(f"{n} + {NUDGE}", n)


#: Means of few windows often lie in the middle of two rounded values; this moves them off, whatever the order of summation.
NUDGE = 1e-9


@query("history_expanding_features",
       sql(f"SELECT src_ip, ready_id AS window_id, {', '.join(map(_settled, ALL))} FROM grown_feat"))
def history_expanding_features(c):
    rows = features.expanding_features(c.windows, c.opts)
    return rows.withColumns({n: F.col(n) + NUDGE for n in ALL
                             if n not in FEATURE_INTS and not n.startswith("pkt_arrivals_")})


@query("history_suffix_features",
       sql(f"SELECT src_ip, last_window_id, {_cols(ALL, FEATURE_INTS)} FROM fresh_feat"))
def history_suffix_features(c):
    """At the time of the last packet, over the windows that have not expired then."""
    now = c.packets.agg(F.max("ts_ns")).first()[0]
    return features.history_features(history.valid_suffix(c.windows, now, c.opts), c.opts)


@query("history_last_n_features",
       sql(f"SELECT src_ip, last_window_id, {_cols(ALL, FEATURE_INTS)} FROM newest_feat"))
def history_last_n_features(c):
    return features.history_features(history.last_windows(c.windows, 8, c.opts), c.opts)


@query("flow_features",
       sql(f"SELECT src_ip, chunk_id, last_window_id, {_cols(ALL, FEATURE_INTS)} FROM feat"))
def flow_features(c):
    return features.flow_features(c.packets, c.opts)


def class_sql():
    """The whole chain once per class, each with its own origin and window ids."""
    base = sql(f"SELECT src_ip, chunk_id, {_cols(ALL, FEATURE_INTS)} FROM feat")
    both = []
    for target, cond in ((0, "NOT is_attacker"), (1, "is_attacker")):
        text = base.replace("celled AS (SELECT", "own AS (SELECT * FROM packets WHERE "
                            f"{cond}),\ncelled AS (SELECT", 1)
        head, tail = text.split("celled AS (", 1)
        body, rest = tail.split("),\n", 1)
        body = body.replace("FROM packets", "FROM own")
        both.append(f"SELECT *, {target} AS target FROM ({head}celled AS ({body}),\n{rest}) t")
    return " UNION ALL ".join(both)


@query("labelled_dataset", class_sql())
def labelled_dataset(c):
    return features.labelled_dataset(
        [(c.packets.filter("NOT is_attacker"), 0), (c.packets.filter("is_attacker"), 1)], c.opts)


MODEL_COLS = [n for n in ALL if n not in ("window_count", "window_span", "pkts_frag_share",
                                          "pkts_frag_share_std")]


@query("model_inputs", sql(f"SELECT chunk_id, {_cols(MODEL_COLS, FEATURE_INTS)} FROM feat"))
def model_inputs(c):
    return features.model_inputs(c.features.drop("last_window_id"))


@query("strip_columns", sql(
    f"SELECT chunk_id, {_cols([n for n in ALL if n not in ('window_count', 'window_span')], FEATURE_INTS)} FROM feat"))
def strip_columns(c):
    return features.strip_columns(c.features.drop("last_window_id").withColumn(
        "target", F.lit(1)), keep_frag=True)


# --- predictions and deny list -------------------------------------------------------

@query("decide", sql(f"SELECT src_ip, chunk_id, {rounded('loss')}, is_attack FROM preds"))
def decide(c):
    scored = c.features.select("src_ip", "chunk_id", F.col("pkt_size_std_std").alias("loss"))
    return mitigation.decide(scored, c.opts.threshold)


@query("predictions", sql("SELECT src_ip, chunk_id, trigger_frame, trigger_ts, elapsed_ns, "
                          f"{rounded('loss')}, is_attack FROM preds"))
def predictions(c):
    return c.predictions


@query("prediction_rows", sql(
    f"SELECT src_ip, {rounded('loss')}, CASE WHEN src_ip IN (SELECT src_ip FROM attackers) "
    "THEN 1 ELSE 0 END AS label FROM preds"))
def prediction_rows(c):
    from floodlens.operators.prepare import label_packets

    return label_packets(c.predictions.select("src_ip", "loss"), c.attackers)


@query("packet_loss_asof", sql(f"""SELECT p.frame_no, p.src_ip, {rounded('coalesce(q.loss, 0)', 'loss')}
  FROM packets p ASOF LEFT JOIN preds q ON p.src_ip = q.src_ip AND p.frame_no >= q.trigger_frame"""))
def packet_loss_asof(c):
    return mitigation.packet_loss(c.packets.select("frame_no", "src_ip"), c.predictions)


@query("decision_rows", sql(f"""SELECT p.frame_no, p.src_ip, {rounded('coalesce(q.loss, 0)', 'loss')},
  CASE WHEN p.src_ip IN (SELECT src_ip FROM attackers) THEN 1 ELSE 0 END AS label
  FROM packets p ASOF LEFT JOIN preds q ON p.src_ip = q.src_ip AND p.frame_no >= q.trigger_frame"""))
def decision_rows(c):
    from floodlens.operators.prepare import label_packets
    from floodlens.sources.sinks import write_decisions

    rows = mitigation.packet_loss(c.packets.select("frame_no", "src_ip"), c.predictions)
    return write_decisions(label_packets(rows, c.attackers), ["frame_no", "src_ip", "loss", "label"])


@query("packet_decisions", sql("SELECT frame_no, src_ip, denied FROM decisions"))
def packet_decisions(c):
    return mitigation.packet_decisions(c.packets.select("frame_no", "src_ip"), c.predictions)


@query("first_detection", sql("SELECT src_ip, denied_from FROM detected"))
def first_detection(c):
    return mitigation.first_detection(c.predictions)


@query("detection_delay", sql("SELECT src_ip, detected_after FROM delays"))
def detection_delay(c):
    return mitigation.detection_delay(c.predictions)


@query("detection_counts", sql("SELECT src_ip, detections_pos, detections_neg FROM det_counts"))
def detection_counts(c):
    return mitigation.detection_counts(c.predictions)


@query("mitigation_counts", sql("SELECT src_ip, pkts_allowed, pkts_denied FROM mit_counts"))
def mitigation_counts(c):
    return mitigation.mitigation_counts(mitigation.packet_decisions(c.packets, c.predictions))


STATS = "src_ip, detected_after, detections_pos, detections_neg, pkts_allowed, pkts_denied"


@query("ip_stats", sql(f"SELECT {STATS} FROM stats"))
def ip_stats(c):
    return mitigation.ip_stats(c.packets, c.predictions)


@query("ip_stats_labelled", sql(f"SELECT {STATS}, label FROM stats"))
def ip_stats_labelled(c):
    return mitigation.label_sources(mitigation.ip_stats(c.packets, c.predictions), c.attackers)


@query("attacker_success", sql("SELECT src_ip, processed, caught AS successful FROM flagged "
                               "WHERE label = 'Attack'"))
def attacker_success(c):
    return mitigation.attacker_success(c.ip_stats)


@query("legit_success", sql("SELECT src_ip, processed, spared AS successful FROM flagged "
                            "WHERE label = 'Benign'"))
def legit_success(c):
    return mitigation.legit_success(c.ip_stats)


@query("confusion", sql("SELECT tp, tn, fp, fn, classified FROM conf"))
def confusion(c):
    return mitigation.confusion(c.ip_stats)


@query("classification_metrics", sql(f"""SELECT
  {rounded('CASE WHEN classified <> 0 THEN (tp + tn) / classified END', 'accuracy')},
  {rounded('CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) END', 'precision')},
  {rounded('CASE WHEN tp + fp <> 0 AND tp + fn <> 0 THEN tp / (tp + fn) END', 'recall')},
  {rounded('CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn) END', 'fscore')}
  FROM conf"""))
def classification_metrics(c):
    return mitigation.classification_metrics(c.ip_stats)


@query("packet_metrics", sql(f"""SELECT attack_denied, attack_pkts, legit_allowed, legit_pkts,
  {rounded('CASE WHEN attack_pkts = 0 THEN 1.0 ELSE attack_denied / attack_pkts END',
           'attack_denied_ratio')},
  {rounded('CASE WHEN legit_pkts <> 0 THEN legit_allowed / legit_pkts END', 'legit_allowed_ratio')}
  FROM (SELECT
    CAST(coalesce(sum(pkts_denied) FILTER (label = 'Attack'), 0) AS BIGINT) AS attack_denied,
    CAST(coalesce(sum(pkts_allowed + pkts_denied) FILTER (label = 'Attack'), 0) AS BIGINT) AS attack_pkts,
    CAST(coalesce(sum(pkts_allowed) FILTER (label = 'Benign'), 0) AS BIGINT) AS legit_allowed,
    CAST(coalesce(sum(pkts_allowed + pkts_denied) FILTER (label = 'Benign'), 0) AS BIGINT) AS legit_pkts
    FROM stats) x"""))
def packet_metrics(c):
    return mitigation.packet_metrics(c.ip_stats)


@query("detected_ratio", sql(f"""SELECT {rounded(
    "coalesce(count(*) FILTER (label = 'Attack' AND detections_pos > 0) / "
    "nullif(count(*) FILTER (label = 'Attack'), 0), 1.0)", 'attackers_detected')},
  count(*) FILTER (detections_pos > 0 AND detections_neg > 0) AS hosts_both FROM stats"""))
def detected_ratio(c):
    return mitigation.detected_ratio(c.ip_stats)


@query("evaluation_report", sql("""SELECT
  CAST(coalesce(sum(detections_pos + detections_neg), 0) AS BIGINT) AS classifications,
  count(*) FILTER (label = 'Attack' AND caught) AS attackers_successful,
  count(*) FILTER (label = 'Attack' AND processed) AS attackers_processed,
  count(*) FILTER (label = 'Attack') AS attackers_all,
  count(*) FILTER (label = 'Benign' AND spared) AS legit_successful,
  count(*) FILTER (label = 'Benign' AND processed) AS legit_processed,
  count(*) FILTER (label = 'Benign') AS legit_all FROM flagged"""))
def evaluation_report(c):
    return mitigation.evaluation_report(c.ip_stats)
