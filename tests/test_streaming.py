
import pytest
from pyspark.sql import functions as F

import sequential as seq
from floodlens.options import WindowOptions
from floodlens.operators.damped import damped_1d
from floodlens.streaming import carry, run, windows


def land(spark, rows, path, parts):
    step = -(-len(rows) // parts)
    for i in range(parts):
        part = rows[i * step:(i + 1) * step]
        if part:
            spark.createDataFrame(part, seq.SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_late_packets_are_dropped_and_batches_do_not_matter(spark, tmp_path):
    ms = 1_000_000
    rows = [(i, i * 100 * ms, "a", "b", 6, 1, 80, 40, i, False) for i in range(100)]
    late = (100, 50 * ms, "a", "b", 6, 1, 80, 40, 5, False)
    opts = WindowOptions(window_length=1, packets_min=1, slices=4)
    schema = spark.createDataFrame([], seq.SCHEMA).schema
    results = []
    for parts, extra in ((1, []), (5, []), (5, [late])):
        base = str(tmp_path / f"p{parts}{len(extra)}")
        land(spark, rows, base + "/in", parts)
        if extra:
            land(spark, extra, base + "/in", 1)
        stream = windows.window_stream(windows.read_packets(spark, base + "/in", schema), opts, delay="0 seconds")
        run.run_to_table(stream, base + "/out", base + "/log")
        out = spark.read.parquet(base + "/out").orderBy("window_id").collect()
        results.append([(r.window_id, r.pkts_total, r.bytes_total, r.pkt_arrivals_std) for r in out])
    assert results[0] == results[1] == results[2]
    assert [r[1] for r in results[0]] == [10] * 9


def test_ports_and_connections_of_a_window_are_all_counted(spark, tmp_path):
    """More packets than a sample holds: each counts, as in the batch table."""
    from floodlens.operators.windows import window_stats

    # but for the first packet none lies on an edge, where batch and stream differ
    rows = [(i, i * 10_000_000 + 3_000_000 * (i > 0), "a" if i % 3 else "b", f"d{i % 5}", 6, i * i % 23 if i % 4 else 7, i % 11, 40, i, False) for i in range(700)]
    rows.append((700, 60 * 10 ** 9, "a", "d0", 6, 1, 1, 40, 1, False))
    opts = WindowOptions(window_length=2, packets_min=1, samples_size=4, slices=4)
    schema = spark.createDataFrame([], seq.SCHEMA).schema
    land(spark, rows, str(tmp_path / "in"), 3)
    stream = windows.window_stream(windows.read_packets(spark, str(tmp_path / "in"), schema), opts, delay="0 seconds")
    run.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "log"))
    got = {(r.src_ip, r.tstamp_start): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.src_ip, r.tstamp_start): r for r in window_stats(spark.createDataFrame(rows, seq.SCHEMA), opts).collect()}
    assert len(want) == 8 and got.keys() == want.keys()
    for k in want:
        for name in ("port_src_unique", "port_src_entropy", "conn_pkts_avg", "pkt_arrivals_std", "pkt_size_std", "bytes_total"):
            assert got[k][name] == pytest.approx(want[k][name]), (k, name)


WINDOW_SCHEMA = "src_ip string, " + ", ".join(f"{n} long" for n in windows.WINDOW_STATS)


def window(src, i, start, end):
    row = {n: 1 for n in windows.WINDOW_STATS}
    row.update(window_id=i, tstamp_start=start * 10 ** 9, tstamp_end=end * 10 ** 9)
    return (src, *[row[n] for n in windows.WINDOW_STATS])


@pytest.mark.parametrize("timeout", [10, None])
def test_histories_go_on_across_batches(spark, tmp_path, timeout):
    spans = [(0, 1), (2, 3), (4, 5), (200, 201), (202, 203), (204, 205), (206, 207)]
    # a second source is silent for some batches, and its state expires
    table = [window("s", i, *span) for i, span in enumerate(spans)] + [window("t", 1, 2, 3), window("t", 6, 206, 207)]
    schema = spark.createDataFrame([], WINDOW_SCHEMA).schema
    opts = WindowOptions(window_length=1, packets_min=1, history_min=2, history_timeout=timeout)
    histories = carry.OpenHistories(schema, opts, str(tmp_path / "state"))
    got = {}
    for batch in range(7):
        rows = spark.createDataFrame([r for r in table if r[1] == batch], WINDOW_SCHEMA)
        if batch == 4:
            histories.chunks_of(rows, batch)  # a repeated batch gives the same
        for r in histories.chunks_of(rows, batch).collect():
            got.setdefault((r.src_ip, r.chunk_id), []).append(r.window_id)
    limit = None if timeout is None else timeout * 10 ** 9
    for src in "st":
        want = seq.chunks([(r[1], r[4], r[5]) for r in table if r[0] == src], 2, limit)
        assert sorted(sorted(v) for k, v in got.items() if k[0] == src) == want
    left = {r.src_ip for r in histories.open_before(spark, 7).collect()}
    assert left == ({"t"} if timeout else {"s"})  # all of s is in runs of two, but for its seventh window


def test_state_of_windows_is_bounded_and_batches_do_not_matter(spark, tmp_path):
    ms, rows = 1_000_000, []
    for i in range(300):  # one source sends nearly all; every ninth packet comes late
        ts = i * 50 * ms - (1700 * ms if i % 9 == 8 else 0)
        rows.append((i, ts, "a" if i % 10 else "b", "x", 6, i % 7, 80, 40, i, i % 5 == 0))
    schema = spark.createDataFrame([], seq.SCHEMA).schema
    opts = WindowOptions(window_length=1, packets_min=1, samples_size=4)
    results = []
    for number in (1, 6):
        opened = carry.OpenWindows(spark.createDataFrame([], schema), opts, str(tmp_path / f"s{number}"), block_rows=8)
        out, step = [], 300 // number
        for batch in range(number):
            packets = spark.createDataFrame(rows[batch * step:(batch + 1) * step], seq.SCHEMA)
            closed, through = opened.closed_by(packets, batch)
            out += [tuple(r) for r in closed.collect()]
            state = opened.state.at(spark, batch).filter(F.col("cell") > through).collect()
            assert len(state) <= 2 and all(len(r.sample) <= 4 for r in state)
        results.append(sorted(out))
    assert len(results[0]) == len(results[1]) > 20
    for a, b in zip(*results):
        assert a == pytest.approx(b)
    want, newest, last = {}, 0, {}
    for no, ts, src, *_ in rows:
        newest = max(newest, ts)
        w = want.setdefault((src, newest // 10 ** 9), [0, 0])
        w[0] += 1
        w[1] += ts // 10 ** 9 < newest // 10 ** 9
    top = newest // 10 ** 9
    late = len(windows.WINDOW_STATS) + 1
    names = ["src_ip", *windows.WINDOW_STATS]
    got = {(r[0], r[names.index("window_id")]): [r[names.index("pkts_total")], r[late]] for r in results[1]}
    assert got == {k: v for k, v in want.items() if k[1] < top}


def test_damped_state_of_one_key(spark, tmp_path):
    rows = [("k", i, (i + (40 if i > 25 else 0) - (3 if i == 12 else 0)) * 10 ** 9, float(i % 5)) for i in range(40)]
    rows += [("quiet", 100, 2 * 10 ** 9, 1.0)]
    schema = "src string, frame_no long, ts_ns long, v double"
    whole = spark.createDataFrame(rows[:40], schema)
    state = carry.DampedState(whole, "src", "v", [1.0, 0.1], str(tmp_path / "state"), block_rows=4)
    got = {}
    batches = [rows[:7] + rows[40:], rows[7:8], rows[8:30], rows[30:35], rows[35:40]]
    for batch, part in enumerate(batches):
        part = [(k, i if k == "k" else 3, t, v) for k, i, t, v in part]
        for r in state.after(spark.createDataFrame(part, schema), batch).collect():
            if r.src == "k":
                got[r.frame_no, r.rate] = (r.weight, r.mean, r.var)
    held, now = {}, None
    for rate in (1.0, 0.1):
        w = s = q = 0.0
        now = None
        for _, i, ns, v in rows[:40]:
            t = ns / 1e9 if now is None else max(now, ns / 1e9)
            fade = 1.0 if now is None else 2.0 ** (-rate * (t - now))
            w, s, q, now = w * fade + 1, s * fade + v, q * fade + v * v, t
            held[i, rate] = (w, s / w, abs(q / w - (s / w) ** 2))
    assert got.keys() == held.keys()
    for k, value in held.items():
        assert got[k] == pytest.approx(value, abs=1e-9)


def test_state_of_a_quiet_key_goes(spark, tmp_path):
    schema = "src string, frame_no long, ts_ns long, v double"
    state = carry.DampedState(spark.createDataFrame([], schema), "src", "v", [1.0], str(tmp_path / "state"))
    for batch, second in enumerate((0, 100, 101)):
        rows = [("old" if batch == 0 else "new", batch, second * 10 ** 9, 1.0)]
        state.after(spark.createDataFrame(rows, schema), batch).collect()
        left = {r.src for r in state.state.at(spark, batch).filter("is_last").collect()}
        assert left == ({"old"} if batch == 0 else {"old", "new"} if batch == 1 else {"new"})


def test_packets_wait_for_the_scoring_stream(spark, tmp_path):
    opts = WindowOptions(window_length=1, packets_min=1)
    packets = spark.createDataFrame([(i, "a", i * 10 ** 9) for i in range(4)], "frame_no long, src_ip string, ts_ns long")
    deny = carry.DenyList(spark, str(tmp_path / "list"))
    rows = carry.in_order_of_arrival(packets, None, opts, 0)

    def judged():
        return [r.denied for r in deny.judge(rows).orderBy("frame_no").collect()]
    assert judged() == [False, None, None, None]
    hits = spark.createDataFrame([("a", 2)], "src_ip string, denied_window long")
    # deny rows that are not committed do not count
    hits.write.parquet(str(tmp_path / "list/deny/batch=0"))
    assert judged() == [False, None, None, None]
    deny.commit(hits, 1, 0)
    assert judged() == [False, False, True, None]
    deny.commit(hits.withColumn("denied_window", F.lit(0)), 1, 0)  # a repeated batch changes nothing
    assert judged() == [False, False, True, None]
    deny.commit(hits.limit(0), None, 1)
    assert judged() == [False, False, True, None]


def test_a_micro_batch_is_landed_by_all_cores_in_order(spark, tmp_path):
    """Each batch takes as many files as there are cores, also if frames are few, and holds the next stretch of frames."""
    import os

    from floodlens.plans import stream_queries
    from floodlens.plans.registry import Context

    cores = spark.sparkContext.defaultParallelism
    for name, frames in (("many", range(600)), ("few", [0, 1, 2, 300, 301, 599])):
        (spark.createDataFrame([(i,) for i in frames], "event_id long")
         .selectExpr("event_id", "event_id % 9 AS user_id", "'click' AS event_type", "1.5D AS value", "'k1' AS props",
                     "timestamp_seconds(1700000000 + event_id) AS ts").write.parquet(f"{tmp_path}/{name}/events.parquet"))
        path, _ = stream_queries._landed(Context(spark, f"{tmp_path}/{name}"))
        files = [f"{d}/{f}" for d, _, found in os.walk(path) for f in found if f.endswith(".parquet")]
        files.sort(key=os.path.getmtime)
        assert len(files) == stream_queries.FILES * cores
        batches = [files[i:i + cores] for i in range(0, len(files), cores)]
        for i, batch in enumerate(batches):
            rows = [r.frame_no for r in spark.read.parquet(*batch).select("frame_no").collect()]
            assert sorted(rows) == [f for f in frames if i * 100 <= f < (i + 1) * 100]
    assert stream_queries.FILES == 6
