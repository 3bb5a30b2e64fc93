"""Text sources: frame dumps, flow records, address lists, one-column files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from floodlens.operators.flows import FlowFormat, normalise_flows
from floodlens.schemas import FRAME_TSV
from floodlens.sources.vectors import number_rows


def _plain(name: str) -> str:
    return name.replace(".", "_")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated frame dump with a header, columns checked by name; empty means missing."""
    rows = (spark.read.schema(FRAME_TSV).option("sep", "\t").option("header", True)
            .option("enforceSchema", False).csv(path))
    numbered = number_rows(rows.withColumnsRenamed({c: _plain(c) for c in rows.columns}), "frame_no")
    ns = (F.col("frame_time_epoch") * 1_000_000_000).cast("long")
    return numbered.select(
        "frame_no", ns.alias("ts_ns"), F.col("frame_len"), "eth_src", "eth_dst", "ip_src", "ip_dst",
        "tcp_srcport", "tcp_dstport", "udp_srcport", "udp_dstport", "icmp_type", "icmp_code",
        "arp_opcode", F.col("arp_src_proto_ipv4").alias("arp_src_ip"),
        F.col("arp_dst_proto_ipv4").alias("arp_dst_ip"), "ipv6_src", "ipv6_dst")


def read_flows(spark: SparkSession, path: str, fmt: FlowFormat) -> DataFrame:
    """Flow CSV with a header, columns mapped by the layout's names."""
    rows = spark.read.option("header", True).csv(path)
    if fmt.time_pattern is None:
        for name in (fmt.start, fmt.end):
            rows = rows.withColumn(name, F.col(name).cast("decimal(20,6)"))
    return normalise_flows(rows, fmt)


def read_ip_list(spark: SparkSession, path: str) -> DataFrame:
    """Addresses separated by any whitespace, each once."""
    words = F.explode(F.split("value", r"\s+"))
    return (spark.read.text(path).select(words.alias("src_ip"))
            .filter(F.col("src_ip") != "").distinct())


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """Line i is the exact time of frame i in decimal seconds."""
    rows = number_rows(spark.read.schema("seconds decimal(20,9)").csv(path), "frame_no")
    return rows.select("frame_no",
                       (F.col("seconds") * 1_000_000_000).cast("long").alias("ts_ns_ext"))


def read_column(spark: SparkSession, path: str, name: str, kind: str = "double") -> DataFrame:
    """One value per line (scores, labels), numbered in file order."""
    return number_rows(spark.read.schema(f"`{name}` {kind}").csv(path))
