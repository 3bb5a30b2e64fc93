"""Queries of the preparation, flow, split, curve and statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.functions import stats
from floodlens.operators import curves, flows, prepare, split
from floodlens.plans.oracle_parts import rounded, sql
from floodlens.plans.registry import query

MID_NS = 1_705_363_200_000_000_000  # 2024-01-16, in the middle of the data


# --- projections and filters ---------------------------------------------------------

@query("ip_only", sql("""SELECT frame_no, coalesce(ip_src, ipv6_src) AS src_ip FROM frames
  WHERE coalesce(ip_src, ipv6_src) IS NOT NULL"""))
def ip_only(c):
    return prepare.ip_only(c.frames.select("frame_no", F.coalesce("ip_src", "ipv6_src")
                                           .alias("src_ip")))


@query("time_units", sql(f"""SELECT frame_no, CAST(floor(sec * 1e9) AS BIGINT) // 1000 AS us,
  {rounded('sec')}, CAST(round_even(ts_ns / 1e9, 0) AS BIGINT) AS whole
  FROM (SELECT frame_no, ts_ns, CAST(ts_ns AS DOUBLE) / 1e9 AS sec FROM packets) x"""))
def time_units(c):
    sec = stats.ns_to_seconds(F.col("ts_ns"))
    return (c.packets.select("frame_no", "ts_ns", sec.alias("sec"))
            .withColumn("_ns", stats.seconds_to_ns(F.col("sec")))
            .select("frame_no", F.expr("_ns div 1000").alias("us"), "sec",
                    stats.ns_to_whole_seconds(F.col("ts_ns")).alias("whole")))


@query("host_filter", sql("""SELECT frame_no, src_ip, dst_ip FROM packets
  WHERE NOT (src_ip IN ('10.0.0.1', '10.0.0.2') OR dst_ip = '192.168.0.3')"""))
def host_filter(c):
    cond = prepare.hosts(["10.0.0.1", "10.0.0.2"], ["192.168.0.3"], exclude=True)
    return c.packets.filter(cond).select("frame_no", "src_ip", "dst_ip")


@query("cidr_filter", sql("""SELECT frame_no, dst_ip FROM packets
  WHERE CAST(split_part(dst_ip, '.', 4) AS INT) BETWEEN 4 AND 7
    AND dst_ip LIKE '192.168.0.%'"""))
def cidr_filter(c):
    return c.packets.filter(prepare.in_network("dst_ip", "192.168.0.4/30")).select(
        "frame_no", "dst_ip")


@query("time_slice", sql(f"""SELECT frame_no, ts_ns FROM packets
  WHERE ts_ns >= {MID_NS} AND ts_ns < {MID_NS} + 86400000000000"""))
def time_slice(c):
    return prepare.time_slice(c.packets, MID_NS, MID_NS + 86_400_000_000_000).select(
        "frame_no", "ts_ns")


@query("time_split", sql(f"""SELECT frame_no, CASE WHEN ts_ns < {MID_NS} THEN 0 ELSE 1 END AS part
  FROM packets"""))
def time_split(c):
    return prepare.time_split(c.packets, MID_NS).select("frame_no", "part")


@query("time_shift", sql("""SELECT frame_no, ts_ns + (SELECT min(ts_ns) FROM packets WHERE NOT is_attacker)
    - (SELECT min(ts_ns) FROM packets WHERE is_attacker) AS ts_ns
  FROM packets WHERE is_attacker"""))
def time_shift(c):
    attack, benign = c.packets.filter("is_attacker"), c.packets.filter("NOT is_attacker")
    return prepare.time_shift(attack, prepare.align_offset(attack, benign)).select(
        "frame_no", "ts_ns")


@query("ip_remap", sql("""SELECT frame_no, CASE WHEN src_ip LIKE '10.0.0.%'
  THEN replace(src_ip, '10.0.0.', '172.16.9.') ELSE src_ip END AS src_ip,
  CASE WHEN dst_ip = '192.168.0.1' THEN '203.0.113.5' ELSE dst_ip END AS dst_ip FROM packets"""))
def ip_remap(c):
    moved = prepare.ip_remap(c.packets, "10.0.0", "172.16.9")
    return prepare.ip_remap(moved, "192.168.0.1", "203.0.113.5", "dst_ip").select(
        "frame_no", "src_ip", "dst_ip")


# --- flows ---------------------------------------------------------------------------

_NAMES = "CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'ospf' END"


@query("flow_proto_recode", sql(
    "SELECT src_ip, dst_ip, src_port, dst_port, start_s, end_s, proto FROM flows "
    "WHERE proto IN (1, 6, 17)"))
def flow_proto_recode(c):
    named = c.flows.withColumn("proto", F.expr(_NAMES)).drop("label")
    return flows.recode_protocols(named)


@query("flow_time_parse", sql("""SELECT src_ip, dst_ip, src_port, dst_port, proto, start_s, us
  FROM (SELECT *, start_s * 1000000 + 250 AS us FROM flows) x"""))
def flow_time_parse(c):
    text = F.date_format(F.timestamp_micros(F.col("start_s") * 1_000_000 + 250),
                         "yyyy-MM-dd HH:mm:ss.SSSSSS")
    parsed = flows.parse_flow_time(text)
    return c.flows.withColumn("us", (parsed * 1_000_000).cast("long")).drop("end_s", "label")


@query("flow_class_filter", sql("SELECT src_ip, dst_ip, start_s FROM flows WHERE label = 'dos'"))
def flow_class_filter(c):
    return flows.flow_class(c.flows, "dos").select("src_ip", "dst_ip", "start_s")


_MATCH = """FROM packets p WHERE EXISTS (SELECT 1 FROM flows f WHERE f.proto = p.proto_l4
  AND f.start_s <= ceil(p.ts_ns / 1000000000) AND f.end_s >= p.ts_ns // 1000000000 AND ({}))"""
_FORWARD = ("f.src_ip = p.src_ip AND f.dst_ip = p.dst_ip AND f.src_port = p.src_port "
            "AND f.dst_port = p.dst_port")
_BACKWARD = ("f.src_ip = p.dst_ip AND f.dst_ip = p.src_ip AND f.src_port = p.dst_port "
             "AND f.dst_port = p.src_port")


@query("packets_in_flows", sql("SELECT p.frame_no " + _MATCH.format(_FORWARD)))
def packets_in_flows(c):
    return flows.packets_in_flows(c.packets, c.flows).select("frame_no")


_TURNED = """SELECT frame_no, ts_ns, proto_l4,
  CASE WHEN frame_no % 2 = 0 THEN src_ip ELSE dst_ip END AS src_ip,
  CASE WHEN frame_no % 2 = 0 THEN dst_ip ELSE src_ip END AS dst_ip,
  CASE WHEN frame_no % 2 = 0 THEN src_port ELSE dst_port END AS src_port,
  CASE WHEN frame_no % 2 = 0 THEN dst_port ELSE src_port END AS dst_port FROM packets"""


@query("packets_in_biflows", sql(
    "SELECT p.frame_no " + _MATCH.format(_FORWARD).replace("FROM packets p", f"FROM ({_TURNED}) p")
    + " UNION SELECT p.frame_no "
    + _MATCH.format(_BACKWARD).replace("FROM packets p", f"FROM ({_TURNED}) p")))
def packets_in_biflows(c):
    """Every other packet has its endpoints turned round."""
    even = F.col("frame_no") % 2 == 0
    pairs = (("src_ip", "dst_ip"), ("src_port", "dst_port"))
    turned = c.packets.withColumns({
        name: F.when(even, F.col(name)).otherwise(F.col(other))
        for a, b in pairs for name, other in ((a, b), (b, a))})
    return flows.packets_in_flows(turned, c.flows, bidirectional=True).select("frame_no")


@query("flow_max_duration", sql("SELECT max(end_s - start_s) AS max_duration FROM flows"))
def flow_max_duration(c):
    return flows.max_duration(c.flows)


@query("flows_time_pruned", sql(f"""SELECT src_ip, dst_ip, src_port, dst_port, proto, start_s, end_s
  FROM flows f, (SELECT min(ts_ns) AS lo, max(ts_ns) AS hi FROM packets
                 WHERE ts_ns >= {MID_NS} AND ts_ns < {MID_NS} + 86400000000000) b
  WHERE f.end_s >= b.lo // 1000000000 AND f.start_s <= ceil(b.hi / 1000000000)"""))
def flows_time_pruned(c):
    batch = prepare.time_slice(c.packets, MID_NS, MID_NS + 86_400_000_000_000)
    return flows.prune_by_time(c.flows, batch).drop("label")


# --- joins and set operations --------------------------------------------------------

@query("label_packets", sql("""SELECT frame_no, CASE WHEN coalesce(ip_src, ipv6_src) IN
  (SELECT src_ip FROM attackers) THEN 1 ELSE 0 END AS label FROM frames"""))
def label_packets(c):
    rows = c.frames.select("frame_no", F.coalesce("ip_src", "ipv6_src").alias("src_ip"))
    return prepare.label_packets(rows, c.attackers).select("frame_no", "label")


@query("ignore_ips", sql("SELECT frame_no, src_ip FROM packets WHERE NOT is_attacker"))
def ignore_ips(c):
    return prepare.ignore_ips(c.packets, c.attackers).select("frame_no", "src_ip")


@query("ip_intersect", sql("""SELECT src_ip FROM packets WHERE proto_l4 = 17
  INTERSECT SELECT src_ip FROM attackers"""))
def ip_intersect(c):
    return prepare.ip_intersect(c.packets.filter("proto_l4 = 17"), c.attackers)


@query("external_timestamps", sql("SELECT e.frame_no, p.src_ip, e.ts_ns_ext AS ts_ns "
                                  "FROM packets p JOIN ext_timestamps e ON p.frame_no = e.frame_no"))
def external_timestamps(c):
    from floodlens.plans import views

    stamps = views.ext_timestamps(c.spark, c.sf_dir)
    return prepare.external_timestamps(c.packets, stamps).select("frame_no", "src_ip", "ts_ns")


@query("scores_with_labels", sql(f"SELECT row_no, {rounded('score')}, label FROM scores"))
def scores_with_labels(c):
    return curves.scores_with_labels(c.scores.select("row_no", "score"),
                                     c.scores.select("row_no", "label"))


@query("merge_classes", sql("SELECT frame_no, CASE WHEN is_attacker THEN 1 ELSE 0 END AS target "
                            "FROM packets"))
def merge_classes(c):
    return prepare.merge_classes([
        (c.packets.filter("NOT is_attacker"), 0), (c.packets.filter("is_attacker"), 1)]).select(
        "frame_no", "target")


@query("merge_captures", sql("""SELECT ts_ns, source_no, frame_no, src_ip FROM (
  SELECT *, 0 AS source_no FROM packets WHERE NOT is_attacker
  UNION ALL SELECT *, 1 FROM packets WHERE is_attacker) x ORDER BY ts_ns, source_no, frame_no"""))
def merge_captures(c):
    return prepare.merge_captures([
        c.packets.filter("NOT is_attacker"), c.packets.filter("is_attacker")]).select(
        "ts_ns", "source_no", "frame_no", "src_ip")


@query("distinct_ips", sql("SELECT DISTINCT src_ip FROM packets"))
def distinct_ips(c):
    return prepare.distinct_ips(c.packets)


@query("reorder", sql("SELECT ts_ns, frame_no FROM packets ORDER BY ts_ns, frame_no"))
def reorder(c):
    shuffled = c.packets.select("ts_ns", "frame_no").orderBy(F.md5(F.col("frame_no").cast("string")))
    return prepare.reorder(shuffled)


# --- splits --------------------------------------------------------------------------

_COUNTS = "SELECT src_ip, count(*) AS packets FROM packets GROUP BY src_ip"
_ELIGIBLE = (f"SELECT * FROM ({_COUNTS}) c WHERE packets BETWEEN 20 AND (SELECT count(*) FROM packets) "
             "AND src_ip NOT IN (SELECT src_ip FROM attackers)")


def _eligible(c):
    return split.eligible_ips(split.ip_packet_counts(c.packets), 20, c.packets.count(), c.attackers)


@query("ip_packet_counts", sql(_COUNTS))
def ip_packet_counts(c):
    return split.ip_packet_counts(c.packets)


@query("eligible_ips", sql(_ELIGIBLE))
def eligible_ips(c):
    return _eligible(c)


@query("select_ips", sql(f"SELECT src_ip, packets FROM ({_ELIGIBLE}) e "
                         "ORDER BY packets, src_ip LIMIT 40"))
def select_ips(c):
    return split.select_ips(_eligible(c), 40, "leastactive")


# 9 to train, 4 to test: r = round(2.25) = 2, every third source goes to test until 9 are in train
_SPLIT = f"""SELECT src_ip, CASE
    WHEN k - k // 3 >= 9 THEN 'test' WHEN k // 3 >= 4 THEN 'train'
    WHEN k % 3 <> 2 THEN 'train' ELSE 'test' END AS subset FROM (
  SELECT src_ip, row_number() OVER (ORDER BY packets DESC, src_ip) - 1 AS k FROM ({_ELIGIBLE}) e) x
  WHERE k < 13"""


@query("train_test_ips", sql(_SPLIT))
def train_test_ips(c):
    return split.train_test_ips(_eligible(c), 9, 4)


@query("split_packets", sql(f"SELECT p.frame_no, p.src_ip, s.subset FROM packets p "
                            f"JOIN ({_SPLIT}) s ON p.src_ip = s.src_ip"))
def split_packets(c):
    from floodlens.sources.sinks import write_subsets

    chosen = split.train_test_ips(_eligible(c), 9, 4)
    return write_subsets(prepare.split_packets(c.packets, chosen).select(
        "frame_no", "src_ip", "subset"))


@query("limit_rows", sql("SELECT frame_no, ts_ns FROM packets ORDER BY frame_no LIMIT 500"))
def limit_rows(c):
    return split.limit_rows(c.packets.select("frame_no", "ts_ns"), "frame_no", 500)


# --- curves --------------------------------------------------------------------------

@query("roc_curve", sql(f"""SELECT {rounded('score', 'threshold')},
  {rounded('sum(n) OVER w / sum(n) OVER ()', 'fpr')}, {rounded('sum(p) OVER w / sum(p) OVER ()', 'tpr')}
  FROM (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
        FROM scores GROUP BY score) x WINDOW w AS (ORDER BY score DESC)"""))
def roc_curve(c):
    return curves.roc_curve(c.scores)


def _auc_sql(group):
    """Average-rank formula, unlike the trapezoids of the Spark side."""
    over = f"PARTITION BY {group} " if group else ""
    keys = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    value = ("(sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * "
             "(count(*) FILTER (label = 1) + 1) / 2) / "
             "(CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0))")
    return f"""SELECT {keys}{rounded(value, 'auc')} FROM (
      SELECT *, rank() OVER ({over}ORDER BY score)
        + (count(*) OVER (PARTITION BY {keys}score) - 1) / 2 AS rk FROM scores) x {tail}"""


@query("auc", sql(_auc_sql("")))
def auc(c):
    return curves.auc(c.scores)


@query("auc_by_group", sql(f"SELECT run_id, CASE WHEN run_id >= 1 THEN auc END AS auc "
                           f"FROM ({_auc_sql('run_id')}) y"))
def auc_by_group(c):
    return curves.auc_by_group(c.scores, "run_id", skip=1)


@query("score_series", sql(f"""SELECT s.row_no, s.label, {rounded('s.score', 'score')},
  {rounded('(p.ts_ns - (SELECT ts_ns FROM packets WHERE frame_no = 100)) / 1e9', 'elapsed_s')}
  FROM scores s JOIN packets p ON s.row_no = p.frame_no
  WHERE s.row_no >= 100 AND s.row_no < (SELECT count(*) - 10 FROM scores)"""))
def score_series(c):
    timed = c.scores.join(c.packets.select(F.col("frame_no").alias("row_no"), "ts_ns"), "row_no")
    return curves.score_series(timed, 100, c.scores.count() - 10).select(
        "row_no", "label", "score", "elapsed_s")


@query("score_linthresh", sql(f"SELECT {rounded('least(1.0, min(score) FILTER (score > 0))', 'linthresh')} "
                              "FROM scores"))
def score_linthresh(c):
    return curves.smallest_positive(c.scores)


# --- statistics primitives -----------------------------------------------------------

_RUN = "PARTITION BY src_ip ORDER BY frame_no ROWS UNBOUNDED PRECEDING"


@query("running_avg", sql(f"""SELECT frame_no, src_ip,
  {rounded(f'avg(len_payload) OVER ({_RUN})', 'running_avg')} FROM packets"""))
def running_avg(c):
    rows = c.packets.select("frame_no", "src_ip", "len_payload")
    return stats.running_average(rows, ["src_ip"], "frame_no", "len_payload").drop("len_payload")


@query("running_var", sql(f"""SELECT frame_no, src_ip,
  {rounded(f'coalesce(var_samp(len_payload) OVER ({_RUN}), 0)', 'running_var')} FROM packets"""))
def running_var(c):
    rows = c.packets.select("frame_no", "src_ip", "len_payload")
    return stats.running_variance(rows, ["src_ip"], "frame_no", "len_payload").drop("len_payload")


_FREQ = "SELECT src_ip, src_port, count(*) AS c FROM packets GROUP BY src_ip, src_port"
_BITS = ("SELECT src_ip, {} FROM (SELECT *, sum(c) OVER (PARTITION BY src_ip) AS n "
         f"FROM ({_FREQ}) f) x GROUP BY src_ip")
_H = "-sum((c / n) * log2(c / n))"


@query("entropy", sql(_BITS.format(rounded(_H, "entropy"))))
def entropy(c):
    return stats.entropy(c.packets, ["src_ip"], "src_port")


@query("entropy_norm", sql(_BITS.format(rounded(
    f"CASE WHEN sum(c) > 1 THEN {_H} / log2(sum(c)) ELSE 0 END", "entropy"))))
def entropy_norm(c):
    return stats.entropy(c.packets, ["src_ip"], "src_port", normalise=True)


@query("entropy_from_freq", sql(_BITS.format(rounded(_H, "entropy"))))
def entropy_from_freq(c):
    freqs = c.packets.groupBy("src_ip", "src_port").agg(F.count(F.lit(1)).alias("freq"))
    return stats.entropy_from_freq(freqs, ["src_ip"], "freq")


@query("reservoir_sample", sql("""SELECT src_ip, frame_no FROM (SELECT *, row_number() OVER (
  PARTITION BY src_ip ORDER BY md5(concat(CAST(frame_no AS VARCHAR), ':7')), frame_no) AS r
  FROM packets) x WHERE r <= 5"""))
def reservoir_sample(c):
    return stats.reservoir_sample(c.packets.select("src_ip", "frame_no"), ["src_ip"], "frame_no", 5)


@query("distinct_sketch")
def distinct_sketch(c):
    """Sketches per source and protocol, merged per source; the error bound is tested."""
    parts = stats.distinct_sketch(c.packets, ["src_ip", "proto_l4"], "frame_no")
    return stats.merge_sketches(parts, ["src_ip"])


@query("rolling_mean", sql(f"""SELECT row_no, {rounded(
    'sum(score) OVER (ORDER BY row_no ROWS 9 PRECEDING) / 10', 'rolling_mean')} FROM scores"""))
def rolling_mean(c):
    return stats.rolling_mean(c.scores.select("row_no", "score"), [], "row_no", "score", 10
                              ).select("row_no", "rolling_mean")
