"""Streaming queries: the tables are landed as files in time order and replayed."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.plans.damped_queries import RATES, _state_sql
from floodlens.plans.oracle_parts import part, rounded, sql
from floodlens.plans.registry import DAY_NS, query
from floodlens.session import scratch_path
from floodlens.streaming import carry, run, windows

FILES = 6
SLICED = {"slices": 8}


#: The landed files follow event time, so no row is late for the stream that goes by watermarks.
IN_ORDER = "0 seconds"


def _landed(c, packets=None):
    """Packets written as files in order of arrival, so that every micro-batch comes after the one before.

    Each micro-batch takes as many files as there are cores, and its packets are dealt over them.
    """
    path, files = scratch_path(c.spark, "landed"), _cores(c)
    packets = c.packets if packets is None else packets
    frames = c.last_frame + 1
    edges = [-((frames - 1) // FILES)] + [-(-i * frames // FILES) for i in range(1, FILES + 1)]
    for low, high in zip(edges, edges[1:]):
        part = f"{path}/until={high}"
        rows = packets.filter((F.col("frame_no") >= low) & (F.col("frame_no") < high))
        rows.repartition(files, "frame_no").write.parquet(part)
        for _ in range(files - len(c.spark.read.parquet(part).inputFiles())):  # a file for each one left out as empty
            rows.limit(0).coalesce(1).write.mode("append").parquet(part)
    return path, windows.read_packets(c.spark, f"{path}/*", packets.schema, files)


def _cores(c):
    return c.spark.sparkContext.defaultParallelism


def _run(c, stream, name):
    path = scratch_path(c.spark, name)
    run.run_to_table(stream, path, scratch_path(c.spark, name + "-log"), _cores(c))
    return path


def _windows(c):
    _, packets = _landed(c)
    opts = c.opts.with_changes(**SLICED)
    stream = windows.window_stream(packets, opts, c.calendar.origin, delay=IN_ORDER)
    return _run(c, stream, "windows"), stream.schema


@query("stream_packets", sql("SELECT frame_no, src_ip FROM packets"))
def stream_packets(c):
    _, packets = _landed(c)
    path = _run(c, packets.select("frame_no", "src_ip"), "packets")
    return c.spark.read.schema("frame_no long, src_ip string").parquet(path)


@query("stream_window_stats", sql(f"""SELECT src_ip, cell AS window_id, pkts_total, bytes_total,
  tstamp_start, tstamp_end, round(pkt_arrivals_avg / {DAY_NS}.0, 9) + 0.0 AS pkt_arrivals_avg,
  round(pkt_arrivals_std / {DAY_NS}.0, 9) + 0.0 AS pkt_arrivals_std, {rounded('pkt_size_std')},
  {rounded('hdrs_payload_ratio_avg')}, {rounded('port_src_entropy')}, tcp_pkt_count, pkts_frag_count
  FROM win WHERE cell < (SELECT max(cell) FROM celled)"""))
def stream_window_stats(c):
    path, schema = _windows(c)
    return c.spark.read.schema(schema).parquet(path).select(
        "src_ip", "window_id", "pkts_total", "bytes_total", "tstamp_start", "tstamp_end",
        "pkt_arrivals_avg", "pkt_arrivals_std", "pkt_size_std", "hdrs_payload_ratio_avg",
        "port_src_entropy", "tcp_pkt_count", "pkts_frag_count")


#: How late the delayed packets come: 1.6 windows.
LATE_NS = 8 * DAY_NS // 5
part("late_packets", f"""SELECT * REPLACE (CASE WHEN frame_no % 7 = 3 THEN ts_ns - {LATE_NS} ELSE ts_ns END AS ts_ns)
  FROM packets""")
part("late_celled", f"""SELECT *, (open_ns - first) // {DAY_NS} AS cell, floor((ts_ns - first) / {DAY_NS}.0) AS own,
    len_headers + len_payload AS size FROM (
  SELECT *, max(ts_ns) OVER (ORDER BY frame_no) AS open_ns FROM late_packets) o, (SELECT min(ts_ns) AS first FROM packets) f""")
part("late_gaps", """SELECT *, coalesce(ts_ns - lag(ts_ns) OVER (PARTITION BY src_ip, cell ORDER BY frame_no), 0) AS gap
  FROM late_celled WHERE cell < (SELECT max(cell) FROM late_celled)""")


@query("stream_arrival_windows", sql(f"""SELECT src_ip, cell AS window_id, count(*) AS pkts_total,
  CAST(sum(size) AS BIGINT) AS bytes_total, min(ts_ns) AS tstamp_start, max(ts_ns) AS tstamp_end,
  round(avg(gap) / {DAY_NS}.0, 9) + 0.0 AS pkt_arrivals_avg,
  round(coalesce(stddev_samp(gap), 0) / {DAY_NS}.0, 9) + 0.0 AS pkt_arrivals_std,
  {rounded('coalesce(stddev_samp(size), 0)', 'pkt_size_std')}, min(size) AS pkt_size_min, max(size) AS pkt_size_max,
  count(*) FILTER (proto_l4 = 17) AS udp_pkt_count, count(*) FILTER (fragmented) AS pkts_frag_count,
  {rounded('avg(CASE WHEN size <> 0 THEN len_headers / size END)', 'hdrs_payload_ratio_avg')},
  count(*) FILTER (own < cell) AS late FROM late_gaps GROUP BY src_ip, cell"""))
def stream_arrival_windows(c):
    """Every seventh packet comes 1.6 windows late and counts in the window that is open then."""
    late = F.col("ts_ns") - F.when(F.col("frame_no") % 7 == 3, LATE_NS).otherwise(0)
    _, packets = _landed(c, c.packets.withColumn("ts_ns", late))
    state, out = scratch_path(c.spark, "open-windows"), scratch_path(c.spark, "arrival-windows")
    windows_open = carry.OpenWindows(packets, c.opts, state, c.calendar.origin)
    carry.run_steps(packets, lambda batch, i: windows_open.closed_by(batch, i)[0], out,
                    scratch_path(c.spark, "arrival-log"), _cores(c))
    return c.spark.read.parquet(out).select(
        "src_ip", "window_id", "pkts_total", "bytes_total", "tstamp_start", "tstamp_end", "pkt_arrivals_avg",
        "pkt_arrivals_std", "pkt_size_std", "pkt_size_min", "pkt_size_max", "udp_pkt_count", "pkts_frag_count",
        "hdrs_payload_ratio_avg", "late")


@query("stream_features", sql(f"""SELECT src_ip, last_window_id, {rounded('pkts_total')},
  {rounded('pkt_rate')}, {rounded('pkt_size_std_std')}, {rounded('dominant_proto_ratio_std')}
  FROM feat"""))
def stream_features(c):
    from floodlens.operators.features import summarise

    _, packets = _landed(c)
    state, out = scratch_path(c.spark, "chunk-state"), scratch_path(c.spark, "chunks")
    opened = carry.OpenWindows(packets, c.opts, f"{state}/windows", c.calendar.origin)
    histories = carry.OpenHistories(c.windows.schema, c.opts, f"{state}/histories")

    def step(batch, batch_id):
        closed, _ = opened.closed_by(batch, batch_id)
        return histories.chunks_of(closed.filter(F.col("pkts_total") >= c.opts.packets_min), batch_id)
    carry.run_steps(packets, step, out, scratch_path(c.spark, "chunk-log"), _cores(c))
    rows = summarise(c.spark.read.schema(histories.state.schema).parquet(out), c.opts)
    return rows.select("src_ip", "last_window_id", "pkts_total", "pkt_rate", "pkt_size_std_std",
                       "dominant_proto_ratio_std")


@query("stream_denylist", sql("""SELECT p.frame_no, p.src_ip, coalesce(p.cell >= d.w, FALSE) AS denied
  FROM celled p LEFT JOIN (SELECT f.src_ip, min(f.last_window_id) + 1 AS w FROM feat f
    WHERE f.pkt_size_std_std >= 230 GROUP BY f.src_ip) d ON p.src_ip = d.src_ip"""))
def stream_denylist(c):
    """Two streams at once: one scores and fills the deny list, the other marks packets by it."""
    score = lambda f: f.withColumn("loss", F.col("pkt_size_std_std"))
    path, (_, packets) = scratch_path(c.spark, "deny"), _landed(c)
    deny = carry.DenyList(c.spark, f"{path}/list")
    marking = carry.Marking(packets, c.opts, deny, f"{path}/marking", c.calendar.origin)
    streams = [marking.start(f"{path}/marking-log", _cores(c)),
               carry.start_scoring(packets, c.opts, score, deny, f"{path}/scoring", f"{path}/scoring-log",
                                   c.calendar.origin, partitions=_cores(c))]
    for stream in streams:
        stream.awaitTermination()
    marking.settle()
    return c.spark.read.schema("frame_no long, src_ip string, denied boolean, batch int").parquet(
        marking.out).drop("batch")


@query("stream_damped_1d", sql(
    f"SELECT frame_no, k AS src_ip, rate, {rounded('weight')}, {rounded('mean')}, {rounded('var')} "
    f"FROM ({_state_sql('src_ip', 'payload_kb', 'timed')}) y"))
def stream_damped_1d(c):
    _, packets = _landed(c)
    rows = packets.withColumn("payload_kb", F.col("len_payload") / 1000)
    out = scratch_path(c.spark, "damped")
    state = carry.DampedState(rows, "src_ip", "payload_kb", RATES, scratch_path(c.spark, "damped-state"),
                              unit_ns=DAY_NS, origin_ns=c.calendar.origin)
    carry.run_steps(rows, state.after, out, scratch_path(c.spark, "damped-log"), _cores(c))
    return c.spark.read.schema("src_ip string, rate double, frame_no long, weight double, mean double, var double, "
                               "batch int").parquet(out).drop("batch")
