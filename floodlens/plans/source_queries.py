"""Queries of the sources: files are derived from the tables by Spark, then read back."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from floodlens.operators import features, flows, packets
from floodlens.operators.prepare import label_packets
from floodlens.plans import window_queries
from floodlens.plans.oracle_parts import part, rounded, sql
from floodlens.plans.registry import query
from floodlens.schemas import FRAME_TSV_COLUMNS
from floodlens.session import cut, scratch_path
from floodlens.sources import captures, files

PACKET_COLS = ("src_ip, dst_ip, proto_l4, src_port, dst_port, len_headers, len_payload")

# Header columns as a decoder would give them, built from the packet view: every fifth frame is
# IPv6, every 13th is not IP, every 19th declares length 0, every 23rd has an unknown protocol.
_HEADERS = """SELECT frame_no, ts_ns,
  CASE WHEN frame_no % 13 = 0 THEN NULL ELSE src_ip END AS src_ip, dst_ip,
  CASE WHEN frame_no % 5 = 0 THEN 6 ELSE 4 END AS ip_version, 5 + frame_no % 3 AS ihl,
  CASE WHEN frame_no % 19 = 0 THEN 0 ELSE 20 + 4 * (frame_no % 3) + l4_head + len_payload END AS ip_len,
  (CASE WHEN frame_no % 5 = 0 THEN 40 ELSE 20 + 4 * (frame_no % 3) END) + l4_head + len_payload AS l3_len,
  CASE WHEN frame_no % 17 = 0 THEN 1 ELSE 2 END AS ip_flags, 0 AS frag_offset,
  l4_head + len_payload AS v6_plen, fragmented AS v6_fragment,
  CASE WHEN frame_no % 23 = 0 THEN 47 WHEN frame_no % 5 = 0 AND proto_l4 = 1 THEN 58
       ELSE proto_l4 END AS l4,
  l4_head + len_payload AS l4_len, src_port, dst_port, 5 AS data_offset,
  8 + len_payload AS udp_len, 128 + frame_no % 3 AS icmp6_type, frame_no % 29 = 0 AS corrupt
FROM (SELECT *, len_headers - 20 AS l4_head FROM packets) p"""
part("headers", _HEADERS)


def _headers(c):
    return c.spark.sql(_HEADERS.replace("FROM packets", "FROM {packets}"), packets=c.packets)


_KNOWN = "(l4 IN (6, 17, 132, 1) OR (l4 = 58 AND icmp6_type IN (128, 129)))"
_L4HEAD = "CASE WHEN l4 = 6 THEN 20 WHEN l4 = 132 THEN 12 ELSE 8 END"
_IPHEAD = "CASE WHEN ip_version = 4 THEN ihl * 4 ELSE 40 END"
_SIZE = "CASE WHEN ip_version = 4 THEN l3_len ELSE 40 + v6_plen END"
part("usable", f"""SELECT *, {_KNOWN} AS known, {_L4HEAD} AS l4h, {_IPHEAD} AS iph FROM headers
  WHERE src_ip IS NOT NULL AND NOT corrupt""")


@query("packet_features", sql(f"""SELECT frame_no, ts_ns, src_ip, dst_ip,
  CASE WHEN NOT known THEN 0 WHEN l4 = 58 THEN 1 ELSE l4 END AS proto_l4, src_port, dst_port,
  CASE WHEN known THEN iph + l4h ELSE iph END AS len_headers,
  CASE WHEN known THEN {_SIZE} - iph - l4h ELSE {_SIZE} - iph END AS len_payload,
  CASE WHEN ip_version = 4 THEN ip_flags = 1 ELSE v6_fragment END AS fragmented FROM usable"""))
def packet_features(c):
    return packets.packet_features(_headers(c))


@query("packet_features_truncated", sql("""SELECT frame_no, ts_ns, src_ip, dst_ip,
  CASE WHEN NOT known OR l4 = 132 THEN 0 WHEN l4 = 58 THEN 1 ELSE l4 END AS proto_l4,
  src_port, dst_port, CASE WHEN known THEN iph + l4h ELSE iph END AS len_headers,
  (CASE WHEN ip_version = 4 THEN ip_len ELSE 40 + v6_plen END)
    - (CASE WHEN known THEN iph + l4h ELSE iph END) AS len_payload, FALSE AS fragmented
  FROM usable WHERE ip_len <> 0"""))
def packet_features_truncated(c):
    return packets.packet_features_truncated(_headers(c))


def _write_captures(pks, path: str):
    """Each task writes its packets as one capture file (Ethernet, IPv4), named by first time."""
    def write(batches):
        name, out, n = None, None, 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if out is None:
                    system, folder = captures.filesystem(path)
                    name = f"{folder}/{r.ts_ns:020d}.pcap"
                    out = system.open_output_stream(name)
                    out.write(struct.pack("<IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1))
                head = r.len_headers - 20
                ports = struct.pack(">HH", r.src_port, r.dst_port)
                l4 = {6: ports + bytes(8) + b"\x50" + bytes(7),
                      17: ports + struct.pack(">HH", 8 + r.len_payload, 0),
                      132: ports + bytes(8), 1: b"\x08" + bytes(7)}[r.proto_l4]
                size = 20 + head + r.len_payload
                ip = struct.pack(">BBHHHBBH", 0x45, 0, size, 0, 0x2000 if r.fragmented else 0x4000,
                                 64, r.proto_l4, 0)
                ends = b"".join(bytes(int(o) for o in a.split(".")) for a in (r.src_ip, r.dst_ip))
                frame = bytes(12) + b"\x08\x00" + ip + ends + l4 + bytes(r.len_payload)
                sec, ns = divmod(r.ts_ns, 10 ** 9)
                out.write(struct.pack("<4I", sec, ns, len(frame), len(frame)) + frame)
                n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [name], "frames": [n]})

    system, folder = captures.filesystem(path)
    system.create_dir(folder, recursive=True)
    ranged = pks.repartitionByRange(8, "ts_ns").sortWithinPartitions("ts_ns", "frame_no")
    ranged.mapInPandas(write, "file string, frames long").write.format("noop").mode("overwrite").save()


def carried(address):
    """The view's source address as a capture can hold it: its third part passes 255 from 65,536 sources on, and what is
    above that is carried into the two parts before."""
    parts = F.split(address, r"\.")
    third = parts[2].cast("long")
    text = lambda c: c.cast("string")
    return F.concat(text(F.floor(third / 65536) + 10), F.lit("."), text(F.floor(third / 256) % 256), F.lit("."),
                    text(third % 256), F.lit("."), parts[3])


def uncarried(address):
    """The view's source address again."""
    parts = F.split(address, r"\.")
    first, second, third = (parts[i].cast("long") for i in range(3))
    return F.concat(F.lit("10.0."), ((first - 10) * 65536 + second * 256 + third).cast("string"), F.lit("."), parts[3])


def _through_captures(c):
    """The packets written as capture files and decoded again."""
    path = scratch_path(c.spark, "captures")
    _write_captures(c.packets.withColumn("src_ip", carried(F.col("src_ip"))), path)
    decoded = packets.packet_features(captures.read_captures(c.spark, path))
    return decoded.withColumn("src_ip", uncarried(F.col("src_ip")))


@query("ingest_captures", sql(f"SELECT ts_ns, {PACKET_COLS}, fragmented FROM packets"))
def ingest_captures(c):
    """Capture files written from the packet view, read back through the data source."""
    return _through_captures(c).drop("frame_no")


@query("captures_to_features", window_queries.class_sql())
def captures_to_features(c):
    """Capture files to labelled feature rows: decode, lengths, labels by the attackers' addresses, windows, chunks, rows."""
    # stored once: each class reads its packets several times
    decoded = cut(label_packets(_through_captures(c), c.attackers, "target"))
    return features.labelled_dataset([(decoded.filter(f"target = {k}").drop("target"), k) for k in (0, 1)], c.opts)


@query("scan_timestamps", sql("SELECT frame_no, ts_ns AS ts_ns_ext FROM packets"))
def scan_timestamps(c):
    """Exact times, one per line, in the order of the frames."""
    path = scratch_path(c.spark, "timestamps")
    exact = "cast(cast(ts_ns as decimal(20,0)) / 1000000000 as decimal(20,9)) as seconds"
    c.packets.orderBy("frame_no").selectExpr(exact).write.csv(path)
    return files.read_timestamps(c.spark, path)


_TSV = {"frame.time_epoch": "cast(ts_ns / 1000000000 as decimal(20,9))", "frame.len": "frame_len",
        "arp.src.hw_mac": "cast(null as string)", "arp.dst.hw_mac": "cast(null as string)",
        "arp.src.proto_ipv4": "arp_src_ip", "arp.dst.proto_ipv4": "arp_dst_ip"}


@query("scan_frames", sql("""SELECT frame_no, ts_ns // 1000000 AS ts_ms, frame_len, eth_src, eth_dst,
  coalesce(ip_src, '') AS ip_src, coalesce(tcp_srcport, udp_srcport, '') AS port,
  coalesce(arp_dst_ip, '') AS arp_dst_ip, coalesce(ipv6_dst, '') AS ipv6_dst FROM frames"""))
def scan_frames(c):
    path = scratch_path(c.spark, "frames")
    exact = "cast(cast(ts_ns as decimal(20,0)) / 1000000000 as decimal(20,9))"
    cols = {**_TSV, "frame.time_epoch": exact}
    dump = c.frames.orderBy("frame_no").selectExpr(
        *[f"{cols.get(n, n.replace('.', '_'))} as `{n}`" for n in FRAME_TSV_COLUMNS])
    dump.write.option("sep", "\t").option("header", True).csv(path)
    back = files.read_frames(c.spark, path)
    text = F.coalesce(F.coalesce("tcp_srcport", "udp_srcport"), F.lit(""))
    return back.select("frame_no", F.expr("ts_ns div 1000000").alias("ts_ms"), "frame_len", "eth_src",
                       "eth_dst", F.coalesce("ip_src", F.lit("")).alias("ip_src"), text.alias("port"),
                       F.coalesce("arp_dst_ip", F.lit("")).alias("arp_dst_ip"),
                       F.coalesce("ipv6_dst", F.lit("")).alias("ipv6_dst"))


@query("scan_ip_list", sql("SELECT src_ip FROM attackers"))
def scan_ip_list(c):
    path = scratch_path(c.spark, "ips")
    lines = c.packets.filter("is_attacker").select(F.concat_ws(" ", "src_ip", "src_ip").alias("v"))
    lines.write.text(path)
    return files.read_ip_list(c.spark, path)


@query("scan_flows", sql("""SELECT src_ip, dst_ip, src_port, dst_port, proto, start_s, end_s
  FROM flows WHERE proto IN (1, 6, 17, 132)"""))
def scan_flows(c):
    path = scratch_path(c.spark, "flows")
    name = "CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'sctp' END"
    c.flows.selectExpr("src_ip AS srcip", "dst_ip AS dstip", "src_port AS sport", "dst_port AS dport",
                       "start_s AS stime", "end_s AS ltime", f"{name} AS proto"
                       ).write.option("header", True).csv(path)
    back = files.read_flows(c.spark, path, flows.EPOCH_TIME_FLOWS)
    return back.withColumns({n: F.col(n).cast("long") for n in ("start_s", "end_s")})


@query("scan_scores", sql(f"SELECT row_no, {rounded('score')} FROM scores"))
def scan_scores(c):
    path = scratch_path(c.spark, "scores")
    c.scores.orderBy("row_no").select("score").write.csv(path)
    return files.read_column(c.spark, path, "score")
