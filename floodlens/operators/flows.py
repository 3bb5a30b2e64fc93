"""Matching packets to flow records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

TUPLE = ["src_ip", "dst_ip", "src_port", "dst_port", "proto"]

# Protocol names of flow records and the packet-side numbers.
PROTOCOL_NUMBERS = {"icmp": 1, "tcp": 6, "udp": 17, "icmp6": 58, "sctp": 132}
KEPT_PROTOCOLS = ("tcp", "udp", "icmp", "sctp")


@dataclass(frozen=True)
class FlowFormat:
    """How a flow file names its columns and rounds its times (10**-precision seconds)."""

    start: str
    end: str
    src_ip: str
    dst_ip: str
    src_port: str
    dst_port: str
    proto: str
    precision: int
    bidirectional: bool
    time_pattern: str | None = None
    named_protocols: bool = False
    extra: tuple = field(default=())


# The two supported flow file layouts.
TEXT_TIME_FLOWS = FlowFormat(
    start="start-time", end="end-time", src_ip="srcip", dst_ip="dstip", src_port="srcport",
    dst_port="dstport", proto="protocol", precision=3, bidirectional=True,
    time_pattern="yyyy-MM-dd HH:mm:ss.SSSSSS")
EPOCH_TIME_FLOWS = FlowFormat(
    start="stime", end="ltime", src_ip="srcip", dst_ip="dstip", src_port="sport",
    dst_port="dport", proto="proto", precision=0, bidirectional=False, named_protocols=True)


def parse_flow_time(text: Column, pattern: str = TEXT_TIME_FLOWS.time_pattern) -> Column:
    """Timestamp text (UTC session) to exact decimal epoch seconds."""
    micros = F.unix_micros(F.to_timestamp(text, pattern))
    return (micros.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(20,6)")


def recode_protocols(flows: DataFrame, name: str = "proto") -> DataFrame:
    """Keep the known protocols and replace names by numbers."""
    col = F.col(name)
    number = F.lit(None).cast("int")
    for text in KEPT_PROTOCOLS:
        number = F.when(col == text, PROTOCOL_NUMBERS[text]).otherwise(number)
    return flows.filter(col.isin(*KEPT_PROTOCOLS)).withColumn(name, number)


def normalise_flows(raw: DataFrame, fmt: FlowFormat) -> DataFrame:
    """Bring a flow table of a given layout to the common columns."""
    flows = raw
    if fmt.named_protocols:
        flows = recode_protocols(flows, fmt.proto)

    def seconds(name):
        col = F.col(f"`{name}`")
        return parse_flow_time(col, fmt.time_pattern) if fmt.time_pattern else col
    return flows.select(
        seconds(fmt.start).alias("start_s"), seconds(fmt.end).alias("end_s"),
        F.col(fmt.src_ip).alias("src_ip"), F.col(fmt.dst_ip).alias("dst_ip"),
        F.col(fmt.src_port).cast("int").alias("src_port"),
        F.col(fmt.dst_port).cast("int").alias("dst_port"),
        F.col(fmt.proto).cast("int").alias("proto"), *fmt.extra)


def _spans(flows: DataFrame, unit_ns: int, bidirectional: bool) -> DataFrame:
    """Distinct (tuple, first unit, last unit), with a swapped copy for two-way flows.

    Whole units suffice: the packet side is rounded to whole units before comparing.
    """
    scale = F.lit(1_000_000_000 // unit_ns)
    spans = flows.select(*TUPLE, F.ceil(F.col("start_s") * scale).cast("long").alias("_lo"),
                         F.floor(F.col("end_s") * scale).cast("long").alias("_hi"))
    if bidirectional:
        swapped = spans.select(F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"),
                               F.col("dst_port").alias("src_port"),
                               F.col("src_port").alias("dst_port"), "proto", "_lo", "_hi")
        spans = spans.unionByName(swapped)
    return spans.distinct()


def packets_in_flows(packets: DataFrame, flows: DataFrame, precision: int = 0,
                     bidirectional: bool = False, proto: str = "proto_l4",
                     bucket_s: int | None = None) -> DataFrame:
    """Packets lying inside at least one flow of their 5-tuple (each packet once).

    A flow (start, end) holds a packet at t when start <= ceil(t) and end >= floor(t) in
    units of 10**-precision seconds. Flows are cut at bucket borders and joined on tuple
    and bucket, so a tuple with a very long history is spread over many join keys. Buckets
    are as long as the mean flow, so cutting at most triples the flow table.
    """
    unit = 10 ** (9 - precision)
    if bucket_s is None:
        mean = flows.agg(F.avg(F.col("end_s") - F.col("start_s"))).first()[0] or 0
        bucket_s = max(60, int(mean))
    bucket_units = bucket_s * 10 ** precision
    spans = _spans(flows, unit, bidirectional)
    first, last = F.expr(f"(_lo - 1) div {bucket_units}"), F.expr(f"_hi div {bucket_units}")
    spans = (spans.filter(first <= last)
             .withColumn("_bucket", F.explode(F.sequence(first, last))))
    low, high = F.expr(f"ts_ns div {unit}"), F.expr(f"(ts_ns + {unit - 1}) div {unit}")
    left = (packets.withColumn("_floor", low).withColumn("_ceil", high)
            .withColumn("_bucket", F.expr(f"_floor div {bucket_units}")))
    l, r = left.alias("l"), spans.alias("r")
    cond = F.col("l._bucket") == F.col("r._bucket")
    for name in TUPLE:
        cond &= F.col(f"l.{proto if name == 'proto' else name}") == F.col(f"r.{name}")
    cond &= (F.col("r._lo") <= F.col("l._ceil")) & (F.col("r._hi") >= F.col("l._floor"))
    return l.join(r, cond, "left_semi").drop("_floor", "_ceil", "_bucket")


def flow_class(flows: DataFrame, label: str, name: str = "label") -> DataFrame:
    return flows.filter(F.col(name) == label)


def max_duration(flows: DataFrame) -> DataFrame:
    return flows.agg(F.max(F.col("end_s") - F.col("start_s")).alias("max_duration"))


def by_end_time(flows: DataFrame) -> DataFrame:
    return flows.orderBy("end_s")


def prune_by_time(flows: DataFrame, packets: DataFrame) -> DataFrame:
    """Flows that can hold any packet of the batch (two scalars limit the scan)."""
    lo, hi = packets.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    if lo is None:
        return flows.limit(0)
    return flows.filter((F.col("end_s") >= lo // 10 ** 9) & (F.col("start_s") <= -(-hi // 10 ** 9)))
