"""Packet features from decoded headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Protocol numbers, echo types and fixed header lengths.
TCP, UDP, SCTP, ICMP, ICMP6 = 6, 17, 132, 1, 58
ECHO_TYPES = (128, 129)
V6_HEADER = 40
MORE_FRAGMENTS = 1


def _l4_header() -> Column:
    """Length of the transport header; null when the protocol is not one of the known."""
    l4 = F.col("l4")
    echo = (l4 == ICMP6) & F.col("icmp6_type").isin(*ECHO_TYPES)
    return (F.when(l4 == TCP, F.col("data_offset") * 4).when(l4 == UDP, F.lit(8))
            .when(l4 == SCTP, F.lit(12)).when((l4 == ICMP) | echo, F.lit(8)))


def _proto() -> Column:
    """Protocol number, ICMPv6 echo counted as ICMP, 0 for anything else."""
    return (F.when(_l4_header().isNull(), 0).when(F.col("l4") == ICMP6, ICMP)
            .otherwise(F.col("l4")))


def _is_v4() -> Column:
    return F.col("ip_version") == 4


def _ip_header() -> Column:
    return F.when(_is_v4(), F.col("ihl") * 4).otherwise(F.lit(V6_HEADER))


def _usable() -> Column:
    return F.col("src_ip").isNotNull() & ~F.coalesce(F.col("corrupt"), F.lit(False))


def _shape(headers: DataFrame, proto: Column, head: Column, payload: Column,
           fragmented: Column, keep=()) -> DataFrame:
    return headers.select(
        "frame_no", "ts_ns", "src_ip", "dst_ip", proto.cast("int").alias("proto_l4"),
        F.coalesce("src_port", F.lit(0)).alias("src_port"),
        F.coalesce("dst_port", F.lit(0)).alias("dst_port"),
        head.cast("long").alias("len_headers"), payload.cast("long").alias("len_payload"),
        fragmented.alias("fragmented"), *keep)


def packet_features(headers: DataFrame, keep=()) -> DataFrame:
    """Packets of complete captures: lengths come from the captured bytes.

    ``keep`` names further columns to carry along, such as ``raw``.
    """
    l4 = _l4_header()
    body = F.when(_is_v4(), F.col("l3_len") - F.col("ihl") * 4).otherwise(F.col("v6_plen"))
    head = F.when(l4.isNull(), _ip_header()).otherwise(_ip_header() + body - F.col("l4_len") + l4)
    payload = (F.when(l4.isNull(), body).when(F.col("l4") == UDP, F.col("udp_len") - 8)
               .otherwise(F.col("l4_len") - l4))
    split = F.when(_is_v4(), (F.col("frag_offset") > 0) | (F.col("ip_flags") == MORE_FRAGMENTS))
    split = F.coalesce(split.otherwise(F.col("v6_fragment")), F.lit(False))
    return _shape(headers.filter(_usable()), _proto(), head, payload, split, keep)


def packet_features_truncated(headers: DataFrame, keep=()) -> DataFrame:
    """Packets of captures cut after the headers: lengths come from the IP header.

    Packets declaring length 0 are dropped. SCTP keeps its ports but reports protocol 0, and
    fragments are not flagged.
    """
    l4 = _l4_header()
    declared = F.when(_is_v4(), F.col("ip_len") - F.col("ihl") * 4).otherwise(F.col("v6_plen"))
    head = F.when(l4.isNull(), _ip_header()).otherwise(F.col("l3_len") - F.col("l4_len") + l4)
    payload = _ip_header() + declared - head
    proto = F.when(F.col("l4") == SCTP, 0).otherwise(_proto())
    kept = headers.filter(_usable() & ~F.coalesce(F.col("ip_len") == 0, F.lit(False)))
    return _shape(kept, proto, head, payload, F.lit(False), keep)


def flow_key(headers: DataFrame) -> DataFrame:
    """Packet side of flow matching: ICMPv6 keeps its own number; other protocols drop out."""
    known = F.col("l4").isin(TCP, UDP, SCTP, ICMP, ICMP6)
    return headers.filter(_usable() & known).select(
        "frame_no", "ts_ns", "src_ip", "dst_ip", F.coalesce("src_port", F.lit(0)).alias("src_port"),
        F.coalesce("dst_port", F.lit(0)).alias("dst_port"), F.col("l4").alias("proto"))
