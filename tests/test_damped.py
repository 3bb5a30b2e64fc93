import random

import pytest
from pyspark.sql import functions as F

import sequential as seq
from floodlens.functions import blocks
from floodlens.operators import damped, damped_pairs, histogram


def traffic(seed, n=120, hosts=4, scale=1.0):
    rng, t, rows = random.Random(seed), 0.0, []
    for f in range(n):
        t += rng.choice([0.0, 0.1, 0.5, 2.0]) * scale
        a, b = rng.sample(range(hosts), 2)
        rows.append((f, f"h{a}", f"h{b}", t, float(rng.randrange(40, 1500))))
    return rows


SCHEMA = "frame_no long, src string, dst string, t double, v double"


@pytest.mark.parametrize("block,scale", [(7, 1.0), (1 << 20, 1.0), (16, 60.0), (16, 1e5)])
def test_damped_moments(spark, block, scale):
    """Blocks, spans and the direct path give the recurrence; long gaps leave weight 1."""
    rows = traffic(1, scale=scale)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.frame_no, r.rate): r for r in damped.damped_1d(
        df, ["src"], "v", (1.0, 0.1), block_rows=block).collect()}
    for rate in (1.0, 0.1):
        streams = {}
        for f, a, _, t, v in rows:
            s = streams.setdefault(a, seq.Stream())
            s.add(t, v, rate)
            r = got[f, rate]
            assert seq.close(r.weight, s.w) and seq.close(r["mean"], s.mean)
            assert seq.close(r["var"], s.var, 1e-6, 1e-4)
        final = {r.src: r for r in damped.damped_state(df, ["src"], "v", (rate,)).collect()}
        assert all(seq.close(final[a].weight, s.w) and seq.close(final[a]["mean"], s.mean)
                   for a, s in streams.items())


def test_late_rows_do_not_decay(spark):
    rows = [(0, "a", "b", 5.0, 1.0), (1, "a", "b", 3.0, 2.0), (2, "a", "b", 6.0, 4.0)]
    df = damped.arrival_times(spark.createDataFrame(rows, SCHEMA), ["src"], "frame_no", block_rows=2)
    got = damped.damped_1d(df, ["src"], "v", (1.0,)).orderBy("frame_no").collect()
    s = seq.Stream()
    for r, (_, _, _, t, v) in zip(got, rows):
        s.add(t, v, 1.0)
        assert seq.close(r.weight, s.w) and seq.close(r["mean"], s.mean)


@pytest.mark.parametrize("residual", ["extrapolated", "last"])
@pytest.mark.parametrize("double", [True, False])
def test_pair_statistics(spark, residual, double):
    rows = traffic(2, n=80, hosts=3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = seq.pair_statistics(rows, 0.5, residual, double)
    for block in (9, 1 << 20):
        got = damped_pairs.damped_2d(df, "src", "dst", "v", (0.5,), residual=residual,
                                     double_update=double, block_rows=block).collect()
        assert len(got) == len(rows)
        for r in got:
            mean, var, radius, magnitude, cov, pcc = want[r.frame_no]
            assert seq.close(r["mean"], mean) and seq.close(r["var"], var, 1e-6, 1e-4)
            assert seq.close(r.radius, radius, 1e-6, 1e-4) and seq.close(r.magnitude, magnitude)
            assert seq.close(r["cov"], cov, 1e-5, 1e-4), (r.frame_no, r["cov"], cov)
            # a variance of zero is only reached up to rounding
            if var > 1e-3 and r["pcc"] != 0:
                assert seq.close(r["pcc"], pcc, 1e-4, 1e-5)


def test_pair_state_is_the_last_emission(spark):
    rows = traffic(3, n=40, hosts=3)
    df = spark.createDataFrame(rows, SCHEMA)
    cov = damped_pairs.damped_cov(df, "src", "dst", "v", (0.5,), residual="last")
    want = {}
    for f, a, b, *_ in rows:
        want[tuple(sorted((a, b)))] = seq.pair_statistics(rows[:f + 1], 0.5, "last")[f][4]
    got = {(r.a, r.b): r.cov for r in damped_pairs.pair_state(cov, "src", "dst").collect()}
    assert set(got) == set(want) and all(seq.close(got[k], v, 1e-6, 1e-6) for k, v in want.items())


def test_frame_vector_has_all_columns(spark):
    rows = [(f, int(t * 1e9), int(v), "m" + a, "m" + b, a, b, "80", "90")
            for f, a, b, t, v in traffic(4, n=30)]
    frames = spark.createDataFrame(rows, "frame_no long, ts_ns long, frame_len long, src_mac string, "
                                         "dst_mac string, src string, dst string, src_proto string, "
                                         "dst_proto string")
    out = damped_pairs.frame_vectors(damped.stream_keys(frames))
    assert out.columns == ["frame_no", *damped_pairs.vector_columns()]
    assert len(out.columns) == 101 and out.count() == 30
    want = seq.pair_statistics([r for r in traffic(4, n=30)], 1.0)
    for r in out.collect():
        assert seq.close(r.hh_mean_1, want[r.frame_no][0])
        assert seq.close(r.mi_mean_1, r.hh_mean_1)


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_block_helpers(spark, block):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.randrange(100)) for i in range(50)]
    df = spark.createDataFrame(rows, "n long, k string, v int").repartition(4)
    seen = {}
    got = {r.n: r for r in blocks.running_max(
        blocks.last_points(blocks.previous(blocks.running_sums(
            df, ["k"], "n", {"s": df.v}, block), ["k"], "n", {"p": df.v}, block),
            ["k"], "n", df.v, 3, "last3", block), ["k"], "n", df.v, "m", block).collect()}
    for n, k, v in rows:
        h = seen.setdefault(k, [])
        before = h[-1] if h else None
        h.append(v)
        r = got[n]
        assert (r.s, r.p, r.last3, r.m) == (sum(h), before, h[-3:], max(h))


def test_first_rows(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(40) if rng.random() < 0.9 else None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, n int").repartition(6)
    in_order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for n in (0, 1, 17, 299, 300, 400):
        got = sorted(map(tuple, blocks.first_rows(df, ["k", "n"], n).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert got == in_order[:n]
    assert blocks.first_rows(df.limit(0), ["k"], 5).count() == 0


@pytest.mark.parametrize("factor", [1, 4])
def test_pair_rows_follow_the_frames(spark, factor):
    """A hub with many peers: rows grow in line with the frames, though the hub has them all as peers."""
    n = 100 * factor
    rows = [(f, "hub" if f % 2 else f"p{f % n}", f"p{f % n}" if f % 2 else "hub", float(f), 1.0) for f in range(4 * n)]
    frames = spark.createDataFrame(rows, "f long, own string, peer string, t double, v double")
    assert damped_pairs.pair_rows(frames).count() <= 2 * len(rows)


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_both_states_come_from_one_reading(spark, block):
    """Rows are made once, whatever is derived from them, and blocks change no result."""
    rows, read = traffic(12, n=90, hosts=4), spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return v
    frames = spark.createDataFrame(rows, SCHEMA).withColumn("v", counted("v"))
    states = damped.damped_states(frames, ["src"], "v", (1.0, 0.1), block_rows=block)
    out = damped.by_rate(damped.both_states(states, "src", "dst", block_rows=block, rates=(1.0, 0.1)).select("frame_no", "st"))
    got = {(r.frame_no, r.rate): r for r in out.collect()}
    assert read.value == len(rows) and len(got) == 2 * len(rows)
    for rate in (1.0, 0.1):
        streams = {}
        for f, a, b, t, v in rows:
            streams.setdefault(a, seq.Stream()).add(t, v, rate)
            both, r = [streams[s] for s in (a, b) if s in streams], got[f, rate]
            assert seq.close(r.weight, streams[a].w)
            assert seq.close(r.radius, sum(s.var for s in both) ** 0.5, 1e-6, 1e-4)
            assert seq.close(r.magnitude, sum(s.mean ** 2 for s in both) ** 0.5)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("block", [4, 1 << 20])
def test_asof_last(spark, strict, block):
    """Latest row of the key over blocks with and without rows on either side; null values count too."""
    rng = random.Random(13)
    right = [(k, n, rng.choice([None, float(n)])) for n in range(60) for k in ("a", "b", None) if rng.random() < 0.15]
    left = [(rng.choice(["a", "b", "c"]), rng.randrange(60), i) for i in range(80)]
    got = blocks.asof_last(spark.createDataFrame(left, "k string, n long, i int"), spark.createDataFrame(right, "k string, n long, x double"),
                           ["k"], "n", ["x"], strict, block)
    assert got.columns == ["k", "n", "i", "x"] and "SortAggregate" not in got._jdf.queryExecution().toString()
    want = {i: ([x for q, m, x in right if q == k and (m < n if strict else m <= n)] or [None])[-1] for k, n, i in left}
    assert {r.i: r.x for r in got.collect()} == want


def test_histogram_learning(spark):
    rng = random.Random(6)
    rows = [(i, "s", float(i), rng.gauss(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "n long, series string, t double, v double")
    bins, used = histogram.learn_bins(df, "v", "n", 50, 10)
    first = [r[3] for r in rows[:49]]
    width = max(first) - min(first)
    assert used == 50 and bins.lower == min(first) - width and bins.upper == max(first) + width
    plain = {r.bin: r.weight for r in histogram.decayed_histogram(df, "v", "t", bins, 0.01).collect()}
    simple, last = [0.0] * 10, [0.0] * 10
    for _, _, t, v in rows:
        b = int((v - bins.lower) // bins.width)
        if not 0 <= b < 10:
            continue
        fade = 2 ** (-0.01 * (t - last[b])) if t > last[b] else 1
        simple[b], last[b] = simple[b] * fade + 1, t
    assert all(seq.close(plain.get(b, 0), w) for b, w in enumerate(simple))
    hist = spark.createDataFrame([(3, 4.0, 0.0), (5, 1.0, 0.0)], "bin long, weight double, last_t double")
    far = spark.createDataFrame([(-1e9,), (bins.lower + 3.5 * bins.width,), (1e9,)], "v double")
    scores = [r.score for r in histogram.histogram_score(far, "v", hist, bins).orderBy("v").collect()]
    assert scores == [float("inf"), 0.0, float("inf")]


@pytest.mark.parametrize("block", [5, 1 << 16])
def test_listed_frames_meet_their_streams_in_one_exchange(spark, block):
    """What is known of both streams at each listed frame and the one before, whatever the blocks; rows carry no names."""
    rows = traffic(11, n=60, hosts=5)
    frames = damped_pairs.own_frames(spark.createDataFrame(rows, SCHEMA), "src", "dst", "v")
    moments = damped_pairs.cut(damped_pairs.stream_moments(frames, [0.5], 1 << 20))
    listed = damped_pairs.cut(damped_pairs.pair_rows(moments.select("own", "peer", "own_name", "peer_name", "f", "t")))
    assert {dict(listed.dtypes)[c] for c in ("link", "small", "big")} == {"bigint"}
    out = damped_pairs.with_streams(listed, moments, block)
    sent, got, pairs = {}, out.select("link", "small", "big", "f", *[f"{c}.f" for c in "xsqo"]).collect(), {}
    for r in moments.select("own", "f").orderBy("f").collect():
        sent.setdefault(r.own, []).append(r.f)
    latest = lambda s, f: max((g for g in sent.get(s, []) if g <= f), default=None)
    assert len(got) == listed.count()
    for link, small, big, f, x, s, q, o in sorted(map(tuple, got), key=lambda r: r[3]):
        before = pairs.get(link)
        assert (x, s) == (latest(big, f), latest(small, f))
        assert (q, o) == ((None, None) if before is None else (latest(big, before), latest(small, before)))
        pairs[link] = f


def test_pairs_keep_only_what_their_sums_need(spark):
    """What was stored on the way goes; left are the frames between two streams and the ends of blocks, at each rate."""
    import os

    from floodlens.session import scratch_path

    folder = os.path.dirname(scratch_path(spark, "any")).removeprefix("file:")
    stages = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = stages()
    rows = [(i, f"s{i % 7}", f"s{i % 5}" if i % 5 != i % 7 else "x", float(i), float(i % 11)) for i in range(200)]
    cov = damped_pairs.damped_cov(spark.createDataFrame(rows, SCHEMA), "src", "dst", "v", (0.5, 0.1))
    left = stages() - before
    assert len(left) == 1
    kept = spark.read.parquet(f"{folder}/{left.pop()}")
    assert kept.filter("direct").count() == cov.count() == 400 and kept.filter("NOT direct AND NOT _end").count() == 0


def test_streams_without_asked_moments_carry_none(spark):
    frames = damped_pairs.own_frames(spark.createDataFrame(traffic(3, n=60), SCHEMA), "src", "dst", "v")
    asked = frames.filter("own_name = 'h1'").select("own").distinct()
    whole, some = (damped_pairs.stream_moments(frames, [0.5], 16, of).orderBy("f").collect() for of in (None, asked))
    for a, b in zip(whole, some, strict=True):
        assert (a.f, a.st, a.points) == (b.f, b.st, b.points)
        assert (b.sums, b.seq, b.tau) == ((a.sums, a.seq, a.tau) if a.own_name == "h1" else (None, None, None))


def test_joined_statistics_are_dealt_by_frames_once(spark):
    parts = [spark.createDataFrame([(f, r, f * r + i) for f in range(50) for r in (1.0, 0.1)], f"f long, rate double, v{i} double") for i in range(3)]
    out = damped.join_all([p.hint("merge") for p in parts], ["f", "rate"]).groupBy("f").agg(F.count("*").alias("n"), F.sum("v2").alias("s"))
    assert {(r.f, r.n) for r in out.collect()} == {(f, 2) for f in range(50)}
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 3
