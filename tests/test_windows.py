import random

import pytest
from pyspark.sql import functions as F

import sequential as seq
from floodlens.operators import features, history, mitigation, windows
from floodlens.options import WindowOptions

NS = 1e-9


def options(window=1000, **kw):
    base = dict(packets_min=2, history_min=3, history_timeout=9_000 * NS)
    return WindowOptions(window_length=window * NS, **{**base, **kw})


@pytest.mark.parametrize("seed", range(2))
def test_windows_agree_with_packet_loop(spark, seed):
    rows = seq.random_packets(seed, window=1000)
    df = spark.createDataFrame(rows, seq.SCHEMA).repartition(3)
    for slices in (1, 7):
        got = {(r.src_ip, r.window_id): r for r in
               windows.window_stats(df, options(slices=slices)).collect()}
        want = seq.window_table(rows, 1000, 2)
        assert set(got) == set(want)
        for key, row in want.items():
            for name, value in row.items():
                assert seq.close(got[key][name], value, 1e-9), (key, name)


@pytest.mark.parametrize("bucket", [2, 65_536])
def test_edge_ownership_is_exact_for_any_bucket(spark, monkeypatch, bucket):
    """Runs of packets on consecutive edges alternate between staying and opening."""
    monkeypatch.setattr(windows, "_BUCKET", bucket)
    rng = random.Random(7)
    for _ in range(2):
        ticks = sorted({0} | {rng.randrange(0, 60) * 5 for _ in range(40)})
        rows = [(i, 100 + t, "a", "b", 6, 1, 1, 40, 1, False) for i, t in enumerate(ticks)]
        df = spark.createDataFrame(rows, seq.SCHEMA)
        got = {r.frame_no: r.cell for r in windows.assign_windows(df, options(10)).collect()}
        _, done, last = seq.run_windows(rows, 10)
        want = {p[0]: cell for cell, part in [*done, last] for p in part}
        assert got == want
        calendar = windows.build_calendar(df, options(10)).windows.orderBy("cell").collect()
        assert [r.cell for r in calendar] == [cell for cell, _ in [*done, last]]
        assert [r.window_id for r in calendar] == list(range(len(done) + 1))
        assert [r.first_frame for r in calendar] == [part[0][0] for _, part in [*done, last]]
        assert [r.next_frame for r in calendar][:-1] == [r.first_frame for r in calendar][1:]


def test_single_packet_zero_size_and_empty_input(spark):
    rows = [(0, 10, "a", "b", 1, 0, 0, 0, 0, False), (1, 5_000, "a", "b", 1, 0, 0, 28, 4, False)]
    df = spark.createDataFrame(rows, seq.SCHEMA)
    one, = windows.window_stats(df, options(packets_min=1)).collect()
    assert (one.pkt_arrivals_std, one.pkt_size_std, one.port_src_entropy) == (0, 0, 0)
    assert one.port_src_unique == 1 and one.hdrs_payload_ratio_avg is None
    both = windows.window_stats(df, options(packets_min=1, flush_last=True))
    assert both.count() == 2
    empty = features.flow_features(df.limit(0), options())
    assert empty.count() == 0 and "interwindow_activity_ratio" in empty.columns


def test_sketch_and_sample_modes(spark):
    rows = [(i, i, "a", f"h{i % 3}", 17, i, 80, 28, 1, False) for i in range(400)]
    rows.append((400, 5_000, "a", "b", 17, 1, 1, 28, 1, False))
    df = spark.createDataFrame(rows, seq.SCHEMA)
    got, = windows.window_stats(df, options(samples_size=40), distinct="sketch",
                                entropy="sampled").collect()
    assert abs(got.port_src_unique - 400) <= 3 * 0.046 * 400
    assert abs(got.conn_pkts_avg - 1) <= 0.2
    assert got.port_src_entropy == pytest.approx(1.0)


def history_rows(seed, n=60):
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([10, 10, 10, 40, 90])
        out.append(("s", i * 3 + rng.randrange(3), t, t + rng.randrange(1, 9)))
    return out


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("block", [1, 5, 4096])
def test_chunks_agree_with_history_loop(spark, seed, block):
    rows = history_rows(seed)
    df = spark.createDataFrame(rows, "src_ip string, window_id long, tstamp_start long, tstamp_end long")
    for h, timeout in ((2, 60), (3, 60), (6, 130), (3, None)):
        opts = options(history_min=h, history_block=block,
                       history_timeout=None if timeout is None else timeout * NS)
        got = {}
        for r in history.history_chunks(df, opts).collect():
            got.setdefault(r.chunk_id, []).append(r.window_id)
        want = seq.chunks([r[1:] for r in rows], h, timeout)
        assert [sorted(got[k]) for k in sorted(got)] == want
        assert sorted(got) == list(range(len(want)))


def test_gap_ending_exactly_at_the_timeout_is_not_ready(spark):
    rows = [("s", 0, 0, 1), ("s", 1, 5, 100)]
    df = spark.createDataFrame(rows, "src_ip string, window_id long, tstamp_start long, tstamp_end long")
    for timeout, n in ((100, 0), (101, 2)):
        opts = options(history_min=2, history_timeout=timeout * NS)
        assert history.history_chunks(df, opts).count() == n


def spread(rows):
    values = [r["pkt_size_std"] for r in rows]
    mean = sum(values) / len(values)
    return (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5


@pytest.mark.parametrize("seed", range(2))
def test_predictions_and_replay_agree_with_packet_loop(spark, seed):
    rows = seq.random_packets(seed + 50, n=500, sources=3)
    df = spark.createDataFrame(rows, seq.SCHEMA)
    opts = options()
    calendar = windows.build_calendar(df, opts)
    rows_f = features.flow_features(df, opts, calendar)
    preds = mitigation.predictions(rows_f.withColumn("loss", F.col("pkt_size_std_std")), calendar, 25.0)
    decisions, losses, stats = seq.replay(rows, 1000, 2, 3, 9_000, spread, 25.0)
    assert any(decisions) and any(losses)
    got = mitigation.packet_decisions(df, preds).orderBy("frame_no").collect()
    assert [r.denied for r in got] == decisions
    for block in (16, 1 << 20):
        got = mitigation.packet_loss(df, preds, block).orderBy("frame_no").collect()
        assert all(seq.close(r.loss, x) for r, x in zip(got, losses))
    table = {r.src_ip: r for r in mitigation.ip_stats(df, preds).collect()}
    for ip, want in stats.items():
        r = table[ip]
        assert (r.detections_pos, r.detections_neg, r.pkts_allowed, r.pkts_denied) == (
            want["pos"], want["neg"], want["allowed"], want["denied"])
        assert r.pkts_allowed + r.pkts_denied == sum(p[2] == ip for p in rows)
        assert r.detected_after == want["after"]


def test_feature_ranges_and_protocol_ties(spark):
    rows = seq.random_packets(3, n=400)
    df = spark.createDataFrame(rows, seq.SCHEMA)
    for r in features.flow_features(df, options(history_timeout=None)).collect():
        for name in ("proto_tcp_share", "proto_udp_share", "proto_icmp_share", "pkts_frag_share",
                     "port_src_entropy", "interwindow_activity_ratio"):
            assert 0 <= r[name] <= 1 + 1e-12
        assert r.window_count == 3
    tie = [("s", 0, i, 4, 2, 2, 0) for i in (0, 1)]
    base = spark.createDataFrame(tie, "src_ip string, chunk_id int, window_id long, pkts_total long, "
                                      "tcp_pkt_count long, udp_pkt_count long, icmp_pkt_count long")
    col = features.interwindow_features(options())["dominant_proto_ratio_std"]
    assert base.groupBy("src_ip").agg(col.alias("x")).first().x == 0


def test_metrics_without_attackers_or_scores_are_null(spark):
    rows = [("a", 0, 0, 0, 5, 0, "Benign")]
    df = spark.createDataFrame(rows, "src_ip string, detected_after long, detections_pos long, "
                                     "detections_neg long, pkts_allowed long, pkts_denied long, label string")
    assert tuple(mitigation.classification_metrics(df).first()) == (None, None, None, None)
    r = mitigation.packet_metrics(df).first()
    assert (r.attack_denied_ratio, r.legit_allowed_ratio) == (1.0, 1.0)
    assert mitigation.detected_ratio(df).first().attackers_detected == 1.0


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_feature_rows_of_kept_histories(spark, block):
    """At every ready window the row equals the summary of all windows so far, whatever the blocks."""
    rng, rows = random.Random(block), []
    for src in ("a", "b"):
        t = 0
        for i in range(40):
            t += rng.choice([10, 10, 40, 300])
            n = rng.randrange(1, 50)
            tcp = rng.randrange(n + 1)
            rows.append((src, 2 * i + rng.randrange(2), n, n * 100, t, t + rng.randrange(1, 9), rng.random(), rng.random(),
                         rng.randrange(40, 90), rng.randrange(90, 1500), 1e6 + rng.random(), 5.0, tcp, n - tcp, 0, rng.randrange(9),
                         rng.random(), rng.random() * 9, rng.randrange(n + 1), None if rng.random() < 0.3 else rng.random()))
    windows_ = spark.createDataFrame(rows, "src_ip string, window_id long, pkts_total long, bytes_total long, tstamp_start long, "
                                           "tstamp_end long, pkt_arrivals_avg double, pkt_arrivals_std double, pkt_size_min long, "
                                           "pkt_size_max long, pkt_size_avg double, pkt_size_std double, tcp_pkt_count long, "
                                           "udp_pkt_count long, icmp_pkt_count long, port_src_unique long, port_src_entropy double, "
                                           "conn_pkts_avg double, pkts_frag_count long, hdrs_payload_ratio_avg double").repartition(3)
    opts = options(history_min=3, history_timeout=200 * NS, history_block=block)
    got = {(r.src_ip, r.window_id): r for r in features.expanding_features(windows_, opts).collect()}
    ready = {(r.src_ip, r.window_id) for r in history.history_ready(windows_, opts).filter("ready").collect()}
    assert set(got) == ready and ready
    for src, last in list(ready)[::7]:
        want = features.history_features(windows_.filter(f"src_ip = '{src}' AND window_id <= {last}"), opts).first().asDict()
        mine = got[src, last].asDict()
        for name, value in want.items():
            if isinstance(value, float):
                assert mine[name] == pytest.approx(value, rel=1e-7, abs=1e-7), name
            elif name != "last_window_id":
                assert mine[name] == value, name
    assert features.expanding_features(windows_.limit(0), opts).count() == 0


@pytest.mark.parametrize("flush", [False, True])
def test_classes_in_one_pass(spark, flush):
    """One pass over all classes gives what each class gives alone, with packets on window edges."""
    rng, frames = random.Random(3), []
    for k in range(2):
        t = 10_000 * k + 37
        for i in range(900):
            t += rng.choice([0, 3, 50, 100, 250])
            frames.append((i, t, rng.choice("ab"), rng.choice("xy"), rng.choice([6, 17, 1]), rng.randrange(5), 80, 28,
                           rng.randrange(900), False, k))
    df = spark.createDataFrame(frames, seq.SCHEMA + ", k int")
    opts = options(window=500, history_min=3, history_timeout=9_000 * NS, flush_last=flush)
    parts = [df.filter(f"k = {k}").drop("k") for k in range(2)]
    got = sorted(map(str, features.labelled_dataset([(parts[0], 5), (parts[1], 7)], opts).collect()))
    want = sorted(str(r) for p, t in zip(parts, (5, 7)) for r in features.flow_features(p, opts).drop("last_window_id").withColumn(
        "target", F.lit(t)).collect())
    assert len(got) > 4 and {x.split(", pkts_total=")[0] for x in got} == {x.split(", pkts_total=")[0] for x in want}
    import re
    numbers = lambda x: [float(v) for v in re.findall(r"=(-?[0-9.e+-]+)", x)]
    assert all(numbers(a) == pytest.approx(numbers(b), rel=1e-9, abs=1e-9) for a, b in zip(got, want))
    assert features.labelled_dataset([(parts[0].limit(0), 0), (parts[1].limit(0), 1)], opts).count() == 0


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_late_packets_enter_the_open_window(spark, block):
    rng = random.Random(block)
    t, rows, start, number, want = 0, [], None, 0, {}
    for f in range(300):
        t += rng.choice([0, 10, 40, 100, 330])
        own = t - rng.choice([0, 0, 0, 90, 250])
        rows.append((f, own))
        if start is None:
            start = own
        elif own - start > 100:
            start += (own - start) // 100 * 100
            number += 1
        want[f] = number
    df = spark.createDataFrame(rows, "frame_no long, ts_ns long").repartition(4)
    got, calendar = windows.arrival_windows(df, options(window=100), block)
    ids = got.join(calendar.windows.select("cell", "window_id"), "cell").collect()
    assert {r.frame_no: r.window_id for r in ids} == want and {r.frame_no: r.ts_ns for r in ids} == dict(rows)
