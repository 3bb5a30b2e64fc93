"""Common table expressions of the oracle SQL (plain, single-node formulations)."""

from __future__ import annotations

import re

from floodlens.plans import views
from floodlens.plans.registry import DAY_NS

DAY = DAY_NS
PARTS: dict[str, str] = {}


def part(name: str, body: str) -> None:
    PARTS[name] = body


def sql(select: str) -> str:
    """Prefix ``select`` with the named parts it uses, dependencies first."""
    needed: list[str] = []

    def visit(text: str, seen: tuple = ()):
        for name in PARTS:
            if name in needed or name in seen:
                continue
            if re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                visit(PARTS[name], (*seen, name))
                needed.append(name)

    visit(select)
    if not needed:
        return select
    ctes = ",\n".join(f"{name} AS ({PARTS[name]})" for name in needed)
    return f"WITH RECURSIVE {ctes}\n{select}"


def rounded(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0 AS {name or expr}"


_duck = [e.replace("{micros}", views.DUCK_MICROS) for e in views.PACKET_EXPRS]
part("packets", f"SELECT {', '.join(_duck)} FROM (SELECT *, {views.K} AS k FROM events) e")
part("frames", f"SELECT {', '.join(views.FRAME_EXPRS)} FROM packets")
part("scores", f"SELECT {', '.join(views.SCORE_EXPRS)} FROM events")
part("flows", """SELECT src_ip, dst_ip, src_port, dst_port, proto_l4 AS proto,
  CAST(floor(min(ts_ns) / 1000000000.0) AS BIGINT) AS start_s,
  CAST(floor(max(ts_ns) / 1000000000.0) AS BIGINT) AS end_s,
  max(CASE WHEN is_attacker THEN 'dos' ELSE 'a_normal' END) AS label
FROM packets WHERE frame_no % 3 = 0
GROUP BY src_ip, dst_ip, src_port, dst_port, proto_l4,
  CAST(floor(ts_ns / 432000000000000.0) AS BIGINT)""")
part("attackers", "SELECT DISTINCT src_ip FROM packets WHERE is_attacker")
part("ext_timestamps", "SELECT frame_no, ts_ns + 250000000 AS ts_ns_ext FROM packets")

part("celled", f"SELECT *, (ts_ns - (SELECT min(ts_ns) FROM packets)) // {DAY} AS cell "
     "FROM packets")
part("closed", "SELECT * FROM celled WHERE cell < (SELECT max(cell) FROM celled)")
part("ids", """SELECT *, lead(first_frame) OVER (ORDER BY cell) AS next_frame,
  lead(first_ts) OVER (ORDER BY cell) AS next_ts FROM (
  SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS window_id,
    min(frame_no) AS first_frame, min(ts_ns) AS first_ts FROM celled GROUP BY cell) c""")
part("gaps", """SELECT *, len_headers + len_payload AS size,
  coalesce(ts_ns - lag(ts_ns) OVER (PARTITION BY src_ip, cell ORDER BY ts_ns, frame_no), 0) AS gap
  FROM closed""")
part("port_entropy", """SELECT src_ip, cell, CASE WHEN sum(c) = 1 THEN 0
    ELSE -sum((c / n) * log2(c / n)) / log2(sum(c)) END AS port_src_entropy
  FROM (SELECT src_ip, cell, src_port, count(*) AS c,
          sum(count(*)) OVER (PARTITION BY src_ip, cell) AS n
        FROM closed GROUP BY src_ip, cell, src_port) x GROUP BY src_ip, cell""")
part("all_windows", """SELECT src_ip, cell, count(*) AS pkts_total,
  CAST(sum(size) AS BIGINT) AS bytes_total,
  min(ts_ns) AS tstamp_start, max(ts_ns) AS tstamp_end, avg(gap) AS pkt_arrivals_avg,
  coalesce(stddev_samp(gap), 0) AS pkt_arrivals_std, min(size) AS pkt_size_min,
  max(size) AS pkt_size_max, avg(size) AS pkt_size_avg,
  coalesce(stddev_samp(size), 0) AS pkt_size_std,
  count(*) FILTER (proto_l4 = 6) AS tcp_pkt_count,
  count(*) FILTER (proto_l4 = 17) AS udp_pkt_count,
  count(*) FILTER (proto_l4 = 1) AS icmp_pkt_count,
  count(DISTINCT src_port) AS port_src_unique,
  count(*) / count(DISTINCT concat_ws('|', src_port, dst_ip, dst_port)) AS conn_pkts_avg,
  count(*) FILTER (fragmented) AS pkts_frag_count,
  avg(CASE WHEN size <> 0 THEN len_headers / size END) AS hdrs_payload_ratio_avg
FROM gaps GROUP BY src_ip, cell""")
part("win", """SELECT a.*, e.port_src_entropy, i.window_id FROM all_windows a
  JOIN port_entropy e ON a.src_ip = e.src_ip AND a.cell = e.cell
  JOIN ids i ON a.cell = i.cell WHERE a.pkts_total >= 2""")
part("ranked", """SELECT *, row_number() OVER w AS rn,
  row_number() OVER (PARTITION BY src_ip ORDER BY window_id DESC) AS rn_desc,
  coalesce(tstamp_end - lag(tstamp_start, 5) OVER w < 12 * 86400000000000, FALSE) AS ok
  FROM win WINDOW w AS (PARTITION BY src_ip ORDER BY window_id)""")
part("runs", """SELECT src_ip, min(rn) AS last_rn, CAST(0 AS BIGINT) AS chunk_id
  FROM ranked WHERE ok GROUP BY src_ip
  UNION ALL
  SELECT r.src_ip, (SELECT min(k.rn) FROM ranked k WHERE k.src_ip = r.src_ip AND k.ok
                    AND k.rn >= r.last_rn + 6), r.chunk_id + 1
  FROM runs r WHERE r.last_rn IS NOT NULL""")
part("chunks", """SELECT k.*, r.chunk_id FROM ranked k JOIN runs r
  ON k.src_ip = r.src_ip AND k.rn > r.last_rn - 6 AND k.rn <= r.last_rn""")


def feature_sql(keys: str, source: str) -> str:
    """The feature row of each group of windows."""
    return f"""SELECT {keys}, max(window_id) AS last_window_id,
  count(*) AS window_count, max(window_id) - min(window_id) + 1 AS window_span,
  avg(pkts_total) AS pkts_total, avg(bytes_total) AS bytes_total,
  sum(pkts_total) / ((max(tstamp_end) - min(tstamp_start)) / 1e9) AS pkt_rate,
  sum(bytes_total) / ((max(tstamp_end) - min(tstamp_start)) / 1e9) AS byte_rate,
  avg(pkt_arrivals_avg) AS pkt_arrivals_avg, avg(pkt_arrivals_std) AS pkt_arrivals_std,
  min(pkt_size_min) AS pkt_size_min, max(pkt_size_max) AS pkt_size_max,
  avg(pkt_size_avg) AS pkt_size_avg, avg(pkt_size_std) AS pkt_size_std,
  avg(tcp_pkt_count / pkts_total) AS proto_tcp_share,
  avg(udp_pkt_count / pkts_total) AS proto_udp_share,
  avg(icmp_pkt_count / pkts_total) AS proto_icmp_share,
  avg(port_src_unique) AS port_src_unique, avg(port_src_entropy) AS port_src_entropy,
  avg(conn_pkts_avg) AS conn_pkts_avg, avg(pkts_frag_count / pkts_total) AS pkts_frag_share,
  avg(hdrs_payload_ratio_avg) AS hdrs_payload_ratio_avg,
  stddev_pop(pkts_total) AS pkts_total_std, stddev_pop(bytes_total) AS bytes_total_std,
  stddev_pop(pkt_size_avg) AS pkt_size_avg_std, stddev_pop(pkt_size_std) AS pkt_size_std_std,
  stddev_pop(pkt_arrivals_avg) AS pkt_arrivals_avg_std,
  stddev_pop(port_src_unique) AS port_src_unique_std,
  stddev_pop(port_src_entropy) AS port_src_entropy_std,
  stddev_pop(conn_pkts_avg) AS conn_pkts_avg_std,
  stddev_pop(pkts_frag_count / pkts_total) AS pkts_frag_share_std,
  stddev_pop(hdrs_payload_ratio_avg) AS hdrs_payload_ratio_avg_std,
  CASE WHEN sum(tcp_pkt_count) >= sum(udp_pkt_count) AND sum(tcp_pkt_count) >= sum(icmp_pkt_count)
       THEN stddev_pop(tcp_pkt_count / pkts_total)
       WHEN sum(udp_pkt_count) >= sum(icmp_pkt_count) THEN stddev_pop(udp_pkt_count / pkts_total)
       ELSE stddev_pop(icmp_pkt_count / pkts_total) END AS dominant_proto_ratio_std,
  sum(tstamp_end - tstamp_start) / (count(*) * {DAY}.0) AS intrawindow_activity_ratio,
  count(*) / (max(window_id) - min(window_id) + 1) AS interwindow_activity_ratio
FROM {source} GROUP BY {keys}"""


part("feat", feature_sql("src_ip, chunk_id", "chunks"))
part("preds", """SELECT f.src_ip, f.chunk_id, i.next_frame AS trigger_frame,
  i.next_ts AS trigger_ts, i.next_ts - (SELECT min(ts_ns) FROM packets) AS elapsed_ns,
  f.pkt_size_std_std AS loss, CASE WHEN f.pkt_size_std_std < 230 THEN 0 ELSE 1 END AS is_attack
  FROM feat f JOIN ids i ON f.last_window_id = i.window_id""")
part("detected", """SELECT src_ip, min(trigger_frame) AS denied_from FROM preds
  WHERE is_attack = 1 GROUP BY src_ip""")
part("delays", """SELECT src_ip, coalesce(arg_min(s, trigger_frame) FILTER (s <> 0), 0) AS detected_after
  FROM (SELECT src_ip, trigger_frame, CAST(round_even(elapsed_ns / 1e9, 0) AS BIGINT) AS s
        FROM preds WHERE is_attack = 1) d GROUP BY src_ip""")
part("decisions", """SELECT p.*, coalesce(p.frame_no > d.denied_from, FALSE) AS denied
  FROM packets p LEFT JOIN detected d ON p.src_ip = d.src_ip""")
part("det_counts", """SELECT src_ip, count(*) FILTER (is_attack = 1) AS detections_pos,
  count(*) FILTER (is_attack = 0) AS detections_neg FROM preds GROUP BY src_ip""")
part("mit_counts", """SELECT src_ip, count(*) FILTER (NOT denied) AS pkts_allowed,
  count(*) FILTER (denied) AS pkts_denied FROM decisions GROUP BY src_ip""")
part("stats", """SELECT m.src_ip, coalesce(l.detected_after, 0) AS detected_after,
  coalesce(c.detections_pos, 0) AS detections_pos, coalesce(c.detections_neg, 0) AS detections_neg,
  m.pkts_allowed, m.pkts_denied,
  CASE WHEN m.src_ip IN (SELECT src_ip FROM attackers) THEN 'Attack' ELSE 'Benign' END AS label
  FROM mit_counts m LEFT JOIN det_counts c ON m.src_ip = c.src_ip
  LEFT JOIN delays l ON m.src_ip = l.src_ip""")
part("flagged", """SELECT *, detections_pos > 0 OR detections_neg > 0 AS processed,
  detections_pos > 0 AND pkts_denied >= 4 * pkts_allowed AS caught,
  detections_neg > 0 AND detections_pos = 0 AS spared FROM stats""")
part("conf", """SELECT
  CAST(coalesce(sum(detections_pos) FILTER (label = 'Attack' AND caught), 0) AS BIGINT) AS tp,
  CAST(coalesce(sum(detections_neg) FILTER (label = 'Benign' AND spared), 0) AS BIGINT) AS tn,
  CAST(coalesce(sum(detections_pos) FILTER (label = 'Benign'), 0) AS BIGINT) AS fp,
  CAST(coalesce(sum(detections_neg) FILTER (label = 'Attack'), 0) AS BIGINT) AS fn,
  CAST(coalesce(sum(detections_pos + detections_neg), 0) AS BIGINT) AS classified FROM flagged""")
