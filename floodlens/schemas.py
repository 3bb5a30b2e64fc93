"""Fixed schemas of the data model."""

from pyspark.sql import types as T

PACKETS = T.StructType([
    T.StructField("frame_no", T.LongType()),
    T.StructField("ts_ns", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("proto_l4", T.IntegerType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("len_headers", T.LongType()),
    T.StructField("len_payload", T.LongType()),
    T.StructField("fragmented", T.BooleanType()),
])

# The 19 columns of the tab-separated frame dump, in file order.
FRAME_TSV_COLUMNS = [
    "frame.time_epoch", "frame.len", "eth.src", "eth.dst", "ip.src", "ip.dst",
    "tcp.srcport", "tcp.dstport", "udp.srcport", "udp.dstport", "icmp.type", "icmp.code",
    "arp.opcode", "arp.src.hw_mac", "arp.src.proto_ipv4", "arp.dst.hw_mac",
    "arp.dst.proto_ipv4", "ipv6.src", "ipv6.dst",
]

FRAME_TSV = T.StructType([
    T.StructField(name, {"frame.time_epoch": T.DecimalType(20, 9), "frame.len": T.LongType()}
                  .get(name, T.StringType()))
    for name in FRAME_TSV_COLUMNS
])

# The measures of one source in one window.
WINDOW_STATS = [
    "window_id", "pkts_total", "bytes_total", "tstamp_start", "tstamp_end",
    "pkt_arrivals_avg", "pkt_arrivals_std", "pkt_size_min", "pkt_size_max", "pkt_size_avg",
    "pkt_size_std", "tcp_pkt_count", "udp_pkt_count", "icmp_pkt_count", "port_src_unique",
    "port_src_entropy", "conn_pkts_avg", "pkts_frag_count", "hdrs_payload_ratio_avg",
]

# The feature row, averages first, then the spread between windows.
SUMMARY = [
    "window_count", "window_span", "pkts_total", "bytes_total", "pkt_rate", "byte_rate",
    "pkt_arrivals_avg", "pkt_arrivals_std", "pkt_size_min", "pkt_size_max", "pkt_size_avg",
    "pkt_size_std", "proto_tcp_share", "proto_udp_share", "proto_icmp_share",
    "port_src_unique", "port_src_entropy", "conn_pkts_avg", "pkts_frag_share",
    "hdrs_payload_ratio_avg",
]
INTERWINDOW = [
    "pkts_total_std", "bytes_total_std", "pkt_size_avg_std", "pkt_size_std_std",
    "pkt_arrivals_avg_std", "port_src_unique_std", "port_src_entropy_std",
    "conn_pkts_avg_std", "pkts_frag_share_std", "hdrs_payload_ratio_avg_std",
    "dominant_proto_ratio_std", "intrawindow_activity_ratio", "interwindow_activity_ratio",
]
FEATURES = ["src_ip", *SUMMARY, *INTERWINDOW]
FRAGMENT_FEATURES = ["pkts_frag_share", "pkts_frag_share_std"]
