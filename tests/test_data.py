import math
import random

import pytest
from pyspark.sql import functions as F

import sequential as seq
from floodlens.functions import stats
from floodlens.operators import curves, flows, prepare, split
from floodlens.options import OptionError, WindowOptions

FLOW = ("src_ip string, dst_ip string, src_port int, dst_port int, proto int, start_s decimal(20,3), "
        "end_s decimal(20,3)")


@pytest.mark.parametrize("both", [False, True])
@pytest.mark.parametrize("precision", [0, 3])
def test_flow_matching_agrees_with_brute_force(spark, both, precision):
    rng = random.Random(1)
    hosts = ["a", "b"]
    records, packets = [], []
    for _ in range(25):
        start = rng.randrange(0, 400_000) / 1000
        records.append((rng.choice(hosts), rng.choice(hosts), 1, 2, 6, start,
                        start + rng.choice([0, 0.5, 3, 90])))
    for i in range(300):
        t = rng.randrange(0, 400) * 10 ** 9 + rng.choice([0, 1, 500_000_000, 999_999_999])
        packets.append((i, t, rng.choice(hosts), rng.choice(hosts), rng.choice([6, 17]),
                        *rng.choice([(1, 2), (2, 1)]), 40, 0, False))
    from decimal import Decimal
    fdf = spark.createDataFrame([(*r[:5], Decimal(f"{r[5]:.3f}"), Decimal(f"{r[6]:.3f}")) for r in records], FLOW)
    pdf = spark.createDataFrame(packets, seq.SCHEMA)
    unit = 10 ** (9 - precision)

    def inside(p):
        keys = [(p[2], p[3], p[5], p[6])] + ([(p[3], p[2], p[6], p[5])] if both else [])
        up, down = -(-p[1] // unit), p[1] // unit
        return any((r[0], r[1], r[2], r[3]) in keys and r[4] == p[4]
                   and Decimal(f"{r[5]:.3f}") * 10 ** precision <= up
                   and Decimal(f"{r[6]:.3f}") * 10 ** precision >= down for r in records)
    want = sorted(p[0] for p in packets if inside(p))
    for bucket in (None, 7):
        got = flows.packets_in_flows(pdf, fdf, precision, both, bucket_s=bucket)
        assert sorted(r.frame_no for r in got.collect()) == want


def test_flow_layouts(spark):
    raw = spark.createDataFrame(
        [("2016-01-01 00:00:01.250000", "2016-01-01 00:00:02.000001", "a", "b", "1", "2", "6")],
        "`start-time` string, `end-time` string, srcip string, dstip string, srcport string, "
        "dstport string, protocol string")
    r = flows.normalise_flows(raw, flows.TEXT_TIME_FLOWS).first()
    assert (float(r.start_s), float(r.end_s)) == (1451606401.25, 1451606402.000001)
    named = spark.createDataFrame([(1.0, 2.0, "a", "b", "1", "2", n) for n in ("tcp", "arp", "icmp6")],
                                  "stime double, ltime double, srcip string, dstip string, sport string, "
                                  "dport string, proto string")
    assert [r.proto for r in flows.normalise_flows(named, flows.EPOCH_TIME_FLOWS).collect()] == [6]


def split_loop(ips, train_n, test_n):
    r, train, test = round(train_n / test_n), [], []
    for ip in ips:
        if len(train) == train_n and len(test) == test_n:
            break
        if len(train) == train_n:
            test.append(ip)
        elif len(test) == test_n:
            train.append(ip)
        elif (len(train) + len(test)) % (r + 1) != r:
            train.append(ip)
        else:
            test.append(ip)
    if train and test and len(train) / len(test) >= 2 * r:
        test.append(train.pop(0))
    return set(train), set(test)


@pytest.mark.parametrize("train_n,test_n,size", [(4, 2, 20), (9, 4, 20), (3, 5, 20), (2, 9, 20), (5, 5, 7),
                                                 (10, 1, 20), (8, 2, 5), (1, 4, 3)])
def test_two_sided_split(spark, train_n, test_n, size):
    counts = spark.createDataFrame([(f"h{i:02}", 100 - i) for i in range(size)], "src_ip string, packets long")
    got = split.train_test_ips(counts, train_n, test_n).collect()
    want = split_loop([f"h{i:02}" for i in range(size)], train_n, test_n)
    sides = [{r.src_ip for r in got if r.subset == s} for s in ("train", "test")]
    assert tuple(sides) == want and not sides[0] & sides[1]


def test_one_sided_split_and_ignore_everything(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 7), ("c", 9)], "src_ip string, packets long")
    assert {r.src_ip for r in split.train_test_ips(counts, 0, 2).collect()} == {"b", "c"}
    none = split.eligible_ips(counts, 1, 10, counts)
    assert split.train_test_ips(none, 2, 1).count() == 0
    assert [r.src_ip for r in split.select_ips(counts, 1, "leastactive").collect()] == ["a"]
    assert split.select_ips(counts, 2, "random").count() == 2


def test_curves(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, rng.randrange(30) / 3, rng.randrange(2)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_no long, run long, score double, label int")

    def brute(part):
        pos, neg = [r[2] for r in part if r[3]], [r[2] for r in part if not r[3]]
        return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    value = curves.auc(df).first().auc
    assert value == pytest.approx(brute(rows))
    assert curves.auc(df.withColumn("score", -F.col("score"))).first().auc == pytest.approx(1 - value)
    for r in curves.auc_by_group(df, "run", skip=1).collect():
        assert r.auc is None if r.run == 0 else r.auc == pytest.approx(brute([x for x in rows if x[1] == r.run]))
    assert curves.auc(df.filter("label = 1")).first().auc is None
    # rows without a score count nowhere, and the number of ranges does not matter
    gaps = df.select("run", "label", "score").union(spark.range(7).selectExpr("1", "id % 2", "cast(null as double)"))
    assert curves.auc(gaps).first().auc == pytest.approx(value)
    assert curves.roc_curve(gaps).filter("threshold IS NULL").count() == 0
    key = lambda r: (r.score, r.pos_above, r.neg_above)
    assert (sorted(map(key, curves.score_counts(df, [], "score", "label", 3).collect()))
            == sorted(map(key, curves.score_counts(df, [], "score", "label").collect())))
    points = curves.roc_curve(df).orderBy("threshold").collect()
    assert (points[0].fpr, points[0].tpr) == (1.0, 1.0) and len(points) == len({r[2] for r in rows})
    with pytest.raises(prepare.CountMismatch):
        curves.scores_with_labels(df.limit(3), df)


def test_preparation(spark):
    rows = [(0, 5, "10.0.0.1", "147.32.9.1", 6, 1, 1, 40, 0, False),
            (1, 5, None, None, 0, 0, 0, 0, 0, False), (2, 3, "fd00::1", "8.8.8.8", 6, 1, 1, 40, 0, False)]
    df = spark.createDataFrame(rows, seq.SCHEMA)
    bad = spark.createDataFrame([("10.0.0.1",)], "src_ip string")
    assert [r.label for r in prepare.label_packets(df, bad).orderBy("frame_no").collect()] == [1, 0, 0]
    assert [r.frame_no for r in df.filter(prepare.in_network("dst_ip", "147.32.0.0/16")).collect()] == [0]
    assert [r.frame_no for r in prepare.reorder(df).collect()] == [2, 0, 1]
    merged = prepare.merge_captures([df, df.limit(1)]).collect()
    assert [(r.ts_ns, r.source_no) for r in merged] == [(3, 0), (5, 0), (5, 0), (5, 1)]
    assert prepare.ip_remap(df, "10.0.0", "9.9.9").first().src_ip == "9.9.9.1"
    with pytest.raises(prepare.CountMismatch):
        prepare.external_timestamps(df, df.limit(1).select("frame_no", F.lit(1).alias("ts_ns_ext")))


@pytest.mark.parametrize("block", [4, 1 << 20])
def test_running_statistics(spark, block):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), 1e6 + rng.random()) for i in range(40)]
    df = spark.createDataFrame(rows, "n long, k string, v double").repartition(5)
    got = {r.n: r for r in stats.running_variance(stats.running_average(
        df, ["k"], "n", "v", block_rows=block), ["k"], "n", "v", block_rows=block).collect()}
    seen = {}
    for n, k, v in rows:
        h = seen.setdefault(k, [])
        h.append(v)
        mean = sum(h) / len(h)
        var = sum((x - mean) ** 2 for x in h) / (len(h) - 1) if len(h) > 1 else 0
        assert seq.close(got[n].running_avg, mean, 1e-12) and seq.close(got[n].running_var, var, 1e-6, 1e-9)
    rolled = {r.n: r.rolling_mean for r in stats.rolling_mean(df, [], "n", "v", 4, block_rows=block).collect()}
    values = [0.0] * 3 + [r[2] for r in rows]
    assert all(seq.close(rolled[i], sum(values[i:i + 4]) / 4, 1e-12) for i in range(40))


def test_sketch_error_and_sample(spark):
    df = spark.range(3000).selectExpr("id", "id % 2 AS k")
    for r in stats.merge_sketches(stats.distinct_sketch(df.withColumn("p", df.id % 5), ["k", "p"], "id"), ["k"]).collect():
        assert abs(r.distinct - 1500) <= 3 * 0.046 * 1500
    once = stats.reservoir_sample(df, ["k"], "id", 20)
    again = stats.reservoir_sample(df.repartition(7), ["k"], "id", 20)
    assert once.groupBy("k").count().filter("count = 20").count() == 2 and once.exceptAll(again).count() == 0
    assert [r.e for r in stats.entropy(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int"),
                                       ["k"], "v", True, "e").orderBy("k").collect()] == [1.0, 0.0]


def test_options(tmp_path):
    path = tmp_path / "c.yml"
    path.write_text("logger:\n  window_length: 1\n  packets_min: 10\nmitig_simulator:\n  threshold: 10\n")
    opts = WindowOptions.from_yaml(str(path))
    assert (opts.window_ns, opts.packets_min, opts.threshold, opts.history_min) == (10 ** 9, 10, 10, 6)
    for bad in ({}, {"window_length": "1"}, {"window_length": 1, "packets_min": 1.5}, {"window_length": 0},
                {"window_length": 1, "history_timeout": "x"}):
        with pytest.raises(OptionError):
            WindowOptions.from_mapping(bad)
    assert WindowOptions(1, history_min=1).history_min == 2
    assert math.isclose(WindowOptions(1, slices=4).slice_ns, 25e7)
