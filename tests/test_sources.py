import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodlens.operators import model, packets
from floodlens.sources import captures, files, vectors


def ethernet(kind, payload, tag=b""):
    return bytes(12) + tag + struct.pack(">H", kind) + payload


def ipv4(proto, l4, flags=0x4000, declared=None, ihl=5):
    size = ihl * 4 + len(l4)
    return struct.pack(">BBHHHBBH4s4s", 0x40 | ihl, 0, size if declared is None else declared, 0, flags, 64,
                       proto, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + bytes(ihl * 4 - 20) + l4


def ipv6(following, body):
    return struct.pack(">IHBB", 6 << 28, len(body), following, 64) + bytes(15) + b"\1" + bytes(15) + b"\2" + body


TCP = struct.pack(">HH", 1000, 80) + bytes(8) + b"\x60" + bytes(7) + bytes(4)
UDP = struct.pack(">HHHH", 53, 5353, 18, 0) + bytes(10)
FRAMES = [
    ethernet(0x0800, ipv4(6, TCP + b"hello")),                     # options in the TCP header
    ethernet(0x0800, ipv4(17, UDP) + bytes(6)),                    # trailing padding
    ethernet(0x0800, ipv4(132, struct.pack(">HH", 1, 2) + bytes(20), flags=0x2000)),
    ethernet(0x0800, ipv4(1, b"\x08" + bytes(15), ihl=6)),
    ethernet(0x86DD, ipv6(58, b"\x80" + bytes(11)), tag=b"\x81\x00\x00\x05"),
    ethernet(0x86DD, ipv6(44, bytes([17, 0, 0, 0, 0, 0, 0, 0]) + UDP)),
    ethernet(0x0806, bytes(28)),                                   # not IP
    ethernet(0x0800, ipv4(6, TCP[:10])),                           # cut inside the TCP header
    ethernet(0x0800, ipv4(6, TCP, declared=0)),
    ethernet(0x0800, ipv4(17, b"xxxxxxxxxx", flags=0x0010)),       # later fragment
]


def pcap(frames, magic=0xA1B2C3D4, order="<"):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack(order + "4I", 100 + i, 7, len(f), len(f)) + f
    return out


def pcapng(frames):
    def block(kind, body):
        size = 12 + len(body) + (-len(body)) % 4
        return struct.pack("<II", kind, size) + body + bytes((-len(body)) % 4) + struct.pack("<I", size)
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + bytes(4))
    for i, f in enumerate(frames):
        ns = (100 + i) * 10 ** 9 + 7000
        out += block(6, struct.pack("<5I", 0, ns >> 32, ns & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def test_captures(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(FRAMES))
    (tmp_path / "b.pcap.gz").write_bytes(gzip.compress(pcap(FRAMES, order=">")))
    (tmp_path / "c.pcapng").write_bytes(pcapng(FRAMES))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.pcap").write_bytes(pcap(FRAMES, magic=0xA1B23C4D))
    headers = captures.read_captures(spark, str(tmp_path))
    assert headers.count() == 4 * len(FRAMES)
    full = packets.packet_features(headers).withColumn("i", F.col("frame_no") % captures.FILE_FRAMES)
    rows = {}
    for r in full.collect():
        rows.setdefault(r.frame_no // captures.FILE_FRAMES, {})[r.i] = r
    assert rows[0][0].ts_ns == 100_000_007_000 and rows[2][0].ts_ns == 100_000_007_000
    assert rows[3][1].ts_ns == 101_000_000_007
    # frame -> protocol, ports, header and payload bytes, fragment flag
    want = {0: (6, 1000, 80, 44, 5, False), 1: (17, 53, 5353, 28, 10, False), 2: (132, 1, 2, 32, 12, True),
            3: (1, 0, 0, 32, 8, False), 4: (1, 0, 0, 48, 4, False), 5: (17, 53, 5353, 56, 10, True),
            8: (6, 1000, 80, 44, 0, False), 9: (0, 0, 0, 20, 10, True)}
    for part in rows.values():
        got = {i: (r.proto_l4, r.src_port, r.dst_port, r.len_headers, r.len_payload, r.fragmented)
               for i, r in part.items()}
        assert got == want
    cut = {r.frame_no: r for r in packets.packet_features_truncated(headers.filter(
        F.col("frame_no") < captures.FILE_FRAMES)).collect()}
    assert 8 not in cut and (cut[2].proto_l4, cut[2].src_port, cut[2].fragmented) == (0, 1, False)
    assert (cut[0].len_headers, cut[0].len_payload) == (44, 5)
    assert {r.proto for r in packets.flow_key(headers).collect()} == {6, 17, 132, 1, 58}
    kept = packets.packet_features(captures.read_captures(spark, str(tmp_path / "a.pcap"), raw=True), keep=["raw"])
    assert bytes(kept.filter("frame_no = 0").first().raw) == FRAMES[0]
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(captures.CaptureError):
        captures.read_captures(spark, str(tmp_path))


def test_text_sources(spark, tmp_path):
    (tmp_path / "ips.txt").write_text("10.0.0.1  10.0.0.2\n\t10.0.0.1\n")
    assert sorted(r.src_ip for r in files.read_ip_list(spark, str(tmp_path / "ips.txt")).collect()) == [
        "10.0.0.1", "10.0.0.2"]
    (tmp_path / "ts.txt").write_text("1700000000.123456789\n1700000001.000000001\n")
    got = files.read_timestamps(spark, str(tmp_path / "ts.txt")).orderBy("frame_no").collect()
    assert [tuple(r) for r in got] == [(0, 1700000000123456789), (1, 1700000001000000001)]
    a = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "row_no long, vector array<double>")
    assert [(r.file_no, r.row_no) for r in vectors.read_many([a, a], 3).collect()] == [(0, 0), (0, 1), (1, 0)]
    with pytest.raises(vectors.VectorError):
        vectors.read_many([a], 3)
    with pytest.raises(vectors.VectorError):
        vectors.read_many([a, a.withColumn("vector", F.array(F.lit(1.0)))])


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    sizes = [3, 40, 1, 9]  # Spark packs large files first; numbers must follow names
    values = iter(range(sum(sizes)))
    for i, n in enumerate(sizes):
        (tmp_path / f"part-{i}.csv").write_text("".join(f"{next(values)}\n" for _ in range(n)))
    rows = files.read_column(spark, str(tmp_path), "v", "long").collect()
    assert len(rows) == sum(sizes) and all(r.row_no == r.v for r in rows)


def test_model(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(260, 3))
    x = np.column_stack([base[:, 0], base[:, 0] * 2 + 0.01 * base[:, 1], base[:, 1], base[:, 2],
                         -base[:, 2], np.ones(260)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                               "row_no long, vector array<double>").repartition(3)
    dist = {(r.i, r.j): r.distance for r in model.feature_distances(df).collect()}
    want = 1 - np.corrcoef(x[:, :5].T)
    assert all(abs(dist[i, j] - max(0, want[i, j])) < 1e-9 for i in range(5) for j in range(i + 1, 5))
    assert dist[0, 5] == 1.0
    # large means must not change the distances
    moved = df.withColumn("vector", F.transform("vector", lambda v: v + 1e9))
    for r in model.feature_distances(moved).filter("j < 5").collect():
        assert abs(r.distance - dist[r.i, r.j]) < 1e-5
    groups = model.group_features(model.feature_distances(df), 3)
    assert sorted(i for g in groups for i in g) == list(range(6)) and max(map(len, groups)) <= 3
    assert any({0, 1} <= set(g) for g in groups)
    learn = model.phase_split(df, 100, 120).filter("phase <> 'score'")
    fitted = model.ensemble_fit(learn, most=3).cache()
    assert fitted.filter("layer = 1").count() == 1 and fitted.count() == len(groups) + 1
    scored = {r.row_no: (r.phase, r.loss) for r in model.process(df, fitted, 100, 120).collect()}
    assert len(scored) == 260 and scored[220] == ("train", 0.0) and scored[221][1] > 0
    odd = spark.createDataFrame([(0, [50.0] * 6)], "row_no long, vector array<double>")
    assert model.ensemble_score(odd, fitted).first().loss > np.mean([v for p, v in scored.values() if p == "score"])


def test_autoencoder_gradient():
    """Against differences of the summed half squared errors; and training lowers the error."""
    rng = np.random.default_rng(2)
    x = rng.random((30, 5))
    layer = model._Layer([[0, 2], [1, 3, 4]], x.min(0), x.max(0), 0.75, 1)

    def loss():
        y = layer.scaled(x)
        total = 0.0
        for m, (w, hidden, visible) in zip(layer.members, layer.params):
            again = 1 / (1 + np.exp(-((1 / (1 + np.exp(-(y[:, m] @ w + hidden)))) @ w.T + visible)))
            total += 0.5 * ((again - y[:, m]) ** 2).sum()
        return total

    grad = layer.gradient(x)
    for k in range(len(grad)):
        step = np.zeros(len(grad))
        step[k] = 1e-5
        layer.move(step)
        up = loss()
        layer.move(-2 * step)
        down = loss()
        layer.move(step)
        assert abs((up - down) / 2e-5 - grad[k]) < 1e-5
    hidden = layer.gradient(x, lambda m: np.zeros(len(m)))
    assert hidden.shape == grad.shape and layer.errors(x).shape == (30, 2)


def test_stretches_of_captures(spark, tmp_path):
    """Stretches of any size give the rows of whole files; a file may break off within a frame."""
    many = [FRAMES[i % len(FRAMES)] for i in range(70)]
    (tmp_path / "a.pcap").write_bytes(pcap(many)[:-5])
    (tmp_path / "b.pcapng").write_bytes(pcapng(many))
    (tmp_path / "c.pcap").write_bytes(b"")
    (tmp_path / "d.pcap").write_bytes(pcap([]))
    (tmp_path / "e.pcap.gz").write_bytes(gzip.compress(pcap(many)))
    whole = {r.frame_no: r for r in captures.read_captures(spark, str(tmp_path), raw=True).collect()}
    assert len(whole) == 210 and bytes(whole[69].raw) == many[69][:-5]
    for stretch in (1, 100, 1000):
        parts = captures.capture_index(spark, str(tmp_path), stretch).count()
        assert parts > 2 if stretch == 1000 else parts > 20
        got = {r.frame_no: r for r in captures.read_captures(spark, str(tmp_path), raw=True, stretch=stretch).collect()}
        assert got == whole


def test_decoding_many_frames_at_once():
    """Against the plain decoder, on frames cut and changed at random."""
    rng = np.random.default_rng(8)
    frames, links = [], []
    for i in range(600):
        frame = bytearray(FRAMES[i % len(FRAMES)])
        for _ in range(rng.integers(0, 3)):
            frame[rng.integers(len(frame))] = rng.integers(256)
        frame = bytes(frame[:rng.integers(0, len(frame) + 1)] if i % 3 == 0 else frame)
        link = [1, 1, 1, 0, 113, 101][i % 6]
        frames.append(frame[14:] if link == 101 else frame)
        links.append(link)
    start = np.cumsum([0] + [len(f) for f in frames[:-1]])
    got = captures.decode_frames(np.frombuffer(b"".join(frames), np.uint8), start, np.array([len(f) for f in frames]), np.array(links))
    got = {c: v.to_pylist() for c, v in got.items()}
    for i, (frame, link) in enumerate(zip(frames, links)):
        want = captures.decode_headers(link, frame)
        assert {c: v[i] for c, v in got.items() if v[i] is not None} == want, (i, link, frame)


def test_captures_hold_more_sources_than_one_address_part(spark, tmp_path):
    from floodlens.plans import source_queries, views
    from floodlens.plans.registry import Context

    users = [0, 255, 256, 65_535, 65_536, 89_999, 16_777_215, 16_777_216, 4_000_000_000]
    rows = [(i, u, "click view purchase signup error".split()[i % 5], 1.5 * i) for i, u in enumerate(users)]
    (spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
     .selectExpr("*", "timestamp_seconds(1700000000 + event_id) AS ts", "concat('k', event_id) AS props")
     .write.parquet(f"{tmp_path}/events.parquet"))
    out = source_queries.ingest_captures(Context(spark, str(tmp_path)))
    want = views.packets(spark, str(tmp_path)).select("ts_ns", "src_ip", "dst_ip", "proto_l4", "len_payload", "fragmented")
    assert sorted(out.select(*want.columns).collect()) == sorted(want.collect())
    assert "10.0.351.143" in {r.src_ip for r in out.collect()}
