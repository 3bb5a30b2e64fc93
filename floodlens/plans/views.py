"""Packet, frame, flow and score views over the given tables.

The same expressions serve both engines; only the epoch function differs, so Spark side
and oracle side start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SPARK_MICROS = "unix_micros(CAST(ts AS TIMESTAMP))"
DUCK_MICROS = "epoch_us(ts)"
K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"

PACKET_EXPRS = [
    "event_id AS frame_no", "{micros} * 1000 AS ts_ns",
    "concat('10.0.', CAST(CAST(floor(user_id / 256) AS BIGINT) AS VARCHAR(20)), '.', "
    "CAST(user_id % 256 AS VARCHAR(20))) AS src_ip",
    "concat('192.168.0.', CAST(k % 8 AS VARCHAR(20))) AS dst_ip",
    "CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 6 WHEN 'purchase' THEN 17 "
    "WHEN 'signup' THEN 1 ELSE 132 END AS proto_l4",
    "CASE WHEN event_type = 'signup' THEN 0 ELSE 1024 + k % 16 END AS src_port",
    "CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'purchase' THEN 53 "
    "WHEN 'signup' THEN 0 ELSE 2905 END AS dst_port",
    "CASE event_type WHEN 'click' THEN 40 WHEN 'view' THEN 40 WHEN 'purchase' THEN 28 "
    "WHEN 'signup' THEN 28 ELSE 32 END AS len_headers",
    "CAST(floor(abs(value) * 10) AS BIGINT) AS len_payload",
    "event_id % 17 = 0 AS fragmented", "user_id % 7 = 0 AS is_attacker",
]

FRAME_EXPRS = [
    "frame_no", "ts_ns", "len_headers + len_payload AS frame_len",
    "concat('02:00:', src_ip) AS eth_src", "concat('02:00:', dst_ip) AS eth_dst",
    "CASE WHEN proto_l4 <> 132 AND dst_ip <> '192.168.0.7' THEN src_ip END AS ip_src",
    "CASE WHEN proto_l4 <> 132 AND dst_ip <> '192.168.0.7' THEN dst_ip END AS ip_dst",
    "CASE WHEN proto_l4 = 6 THEN CAST(src_port AS VARCHAR(9)) END AS tcp_srcport",
    "CASE WHEN proto_l4 = 6 THEN CAST(dst_port AS VARCHAR(9)) END AS tcp_dstport",
    "CASE WHEN proto_l4 = 17 THEN CAST(src_port AS VARCHAR(9)) END AS udp_srcport",
    "CASE WHEN proto_l4 = 17 THEN CAST(dst_port AS VARCHAR(9)) END AS udp_dstport",
    "CASE WHEN proto_l4 = 1 THEN '8' END AS icmp_type",
    "CASE WHEN proto_l4 = 1 THEN '0' END AS icmp_code",
    "CASE WHEN proto_l4 = 132 AND frame_no % 2 = 0 THEN '1' END AS arp_opcode",
    "CASE WHEN proto_l4 = 132 AND frame_no % 2 = 0 THEN src_ip END AS arp_src_ip",
    "CASE WHEN proto_l4 = 132 AND frame_no % 2 = 0 THEN dst_ip END AS arp_dst_ip",
    "CASE WHEN proto_l4 <> 132 AND dst_ip = '192.168.0.7' THEN concat('fd00::', src_ip) END AS ipv6_src",
    "CASE WHEN proto_l4 <> 132 AND dst_ip = '192.168.0.7' THEN concat('fd00::', dst_ip) END AS ipv6_dst",
]

SCORE_EXPRS = [
    "event_id AS row_no", "user_id % 5 AS run_id", "abs(value) AS score",
    "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").selectExpr("*", f"{K} AS k")
    return raw.selectExpr(*[e.replace("{micros}", SPARK_MICROS) for e in PACKET_EXPRS])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).selectExpr(*FRAME_EXPRS)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*SCORE_EXPRS)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["src_ip", "dst_ip", "src_port", "dst_port", "proto"]
    return (packets(spark, sf_dir).filter("frame_no % 3 = 0")
            .withColumn("proto", F.col("proto_l4"))
            .withColumn("bucket", F.expr("ts_ns div 432000000000000"))
            .groupBy(*key, "bucket")
            .agg(F.expr("min(ts_ns) div 1000000000").alias("start_s"),
                 F.expr("max(ts_ns) div 1000000000").alias("end_s"),
                 F.max(F.when(F.col("is_attacker"), "dos").otherwise("a_normal")).alias("label"))
            .drop("bucket"))


def attackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).filter("is_attacker").select("src_ip").distinct()


def ext_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).selectExpr("frame_no", "ts_ns + 250000000 AS ts_ns_ext")
