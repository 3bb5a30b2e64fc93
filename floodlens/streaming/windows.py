"""Window statistics of a packet stream.

Windows lie on a fixed grid (dense ids would need the future), so ids are grid numbers and
a packet exactly on an edge opens the new window. Late packets are dropped by the watermark.
Statistics are built in chained aggregations: time slices of a source first, so that a flooding source is spread
over them, then its connections in a window, its ports, and the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from floodlens.options import WindowOptions
from floodlens.schemas import WINDOW_STATS


def read_packets(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Landed packet files as a stream; frames without an IP source are dropped."""
    rows = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))
    return rows.filter(F.col("src_ip").isNotNull())


def _interval(ns: int) -> str:
    if ns % 1_000:
        raise ValueError("stream windows and slices need whole microseconds")
    return f"{ns // 1_000} microseconds"


#: Measures of a slice and how they merge.
MERGED = {
    "n": F.sum, "bytes": F.sum, "low": F.min, "high": F.max, "squares": F.sum, "tcp": F.sum, "udp": F.sum, "icmp": F.sum,
    "frag": F.sum, "ratio": F.sum, "ratio_n": F.sum, "first": F.min, "last": F.max}


def slice_stream(packets: DataFrame, opts: WindowOptions, origin_ns: int, delay: str, slice_ns: int) -> DataFrame:
    """First aggregation: one row per source and time slice, with the connection of each of its packets."""
    size = F.col("len_headers") + F.col("len_payload")
    ratio = F.when(size != 0, F.col("len_headers") / size)
    start = _interval(origin_ns % slice_ns)
    timed = packets.withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000")))
    return (timed.withWatermark("ts", delay)
            .groupBy("src_ip", F.window("ts", _interval(slice_ns), startTime=start).alias("slice"))
            .agg(F.sort_array(F.collect_list("ts_ns")).alias("times"),
                 F.collect_list(F.struct("src_port", "dst_ip", "dst_port")).alias("conns"),
                 F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"),
                 F.min(size).alias("low"), F.max(size).alias("high"),
                 F.sum((size * size).cast("double")).alias("squares"),
                 F.count_if(F.col("proto_l4") == 6).alias("tcp"),
                 F.count_if(F.col("proto_l4") == 17).alias("udp"),
                 F.count_if(F.col("proto_l4") == 1).alias("icmp"),
                 F.count_if("fragmented").alias("frag"), F.sum(ratio).alias("ratio"),
                 F.count(ratio).alias("ratio_n"))
            .withColumn("gap_sq", _squared_gaps(F.col("times")))
            .withColumn("first", F.element_at("times", 1))
            .withColumn("last", F.element_at("times", -1)).drop("times"))


def _squared_gaps(times: Column) -> Column:
    """Sum of squared gaps of a sorted time array."""
    step = F.aggregate(times, F.struct(F.element_at(times, 1).alias("t"), F.lit(0.0).alias("q")),
                       lambda a, t: F.struct(t.alias("t"), (
                           a["q"] + (t - a["t"]).cast("double") * (t - a["t"])).alias("q")))
    return step["q"]


def window_stream(packets: DataFrame, opts: WindowOptions, origin_ns: int = 0, *,
                  delay: str, qualified: bool = True) -> DataFrame:
    """Window table as a stream (append mode), same columns as the batch table.

    ``delay`` is how late packets may come; Spark counts those that come later and are dropped in the progress of
    the query (``numRowsDroppedByWatermark``), so it has no default.

    Distinct counts and port entropy are exact: packets are counted by connection, those by port, and those by window.
    """
    w = opts.window_ns
    slices = slice_stream(packets, opts, origin_ns, delay, w // opts.slices)
    start = _interval(origin_ns % w)
    # a slice's measures go along with its first packet
    packet = slices.select("src_ip", F.window_time("slice").alias("at"), F.posexplode("conns").alias("pos", "conn"), *MERGED, "gap_sq")
    packet = packet.withColumns({c: F.when(F.col("pos") == 0, F.col(c)) for c in (*MERGED, "gap_sq")})
    merged = [merge(c).alias(c) for c, merge in MERGED.items()]
    part = F.when(F.col("pos") == 0, F.struct("first", "last", "gap_sq"))
    conns = (packet.groupBy("src_ip", F.window("at", _interval(w), startTime=start).alias("win"), "conn")
             .agg(F.count(F.lit(1)).alias("c"), F.collect_list(part).alias("parts"), *merged)
             .withColumn("src_port", F.col("conn.src_port")))
    parts = F.flatten(F.collect_list("parts")).alias("parts")
    ports = conns.groupBy("src_ip", "win", "src_port").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("conns"), parts, *merged)
    total = ports.groupBy("src_ip", "win").agg(
        F.count("src_port").alias("ports"), F.sum("conns").alias("conns"),
        F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("bits"), parts, *merged)
    total = total.withColumn("parts", F.sort_array("parts")).withColumnsRenamed({
        "n": "pkts_total", "bytes": "bytes_total", "low": "pkt_size_min", "high": "pkt_size_max", "tcp": "tcp_pkt_count",
        "udp": "udp_pkt_count", "icmp": "icmp_pkt_count", "frag": "pkts_frag_count", "first": "tstamp_start", "last": "tstamp_end"})
    if qualified:
        total = total.filter(F.col("pkts_total") >= opts.packets_min)
    bridged = F.aggregate("parts", F.struct(F.col("tstamp_start").alias("t"), F.lit(0.0).alias("q")),
                          lambda a, p: F.struct(p["last"].alias("t"), (
                              a["q"] + p["gap_sq"] + (p["first"] - a["t"]).cast("double")
                              * (p["first"] - a["t"])).alias("q")))["q"]
    grid = F.expr(f"({{0}} * 1000 - {origin_ns}) div {w}".format("_start"))
    total = total.withColumn("_start", F.unix_micros(F.col("win")["start"])).withColumn("gap_sq", bridged)
    counted = F.col("ports"), _entropy(F.col("bits"), F.col("pkts_total")), F.col("conns")
    return finished(total, grid, counted=counted)


def _entropy(bits: Column, n: Column) -> Column:
    """Entropy over log2 of the number of values, 0 for one; ``bits`` is the sum of c * log2 c."""
    return F.when(n > 1, F.greatest(F.lit(0.0), 1 - bits / (n * F.log2(n.cast("double"))))).otherwise(0.0)


def sketched() -> tuple[Column, Column, Column]:
    """Distinct ports, port entropy and distinct connections from two sketches and a sample of ports."""
    ports = F.col("sample.src_port")
    counts = F.transform(F.array_distinct(ports), lambda p: F.size(F.filter(ports, lambda q: q == p)))
    bits = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * F.log2(c.cast("double")))
    return F.hll_sketch_estimate("ports"), _entropy(bits, F.size("sample")), F.hll_sketch_estimate("conns")


def finished(total: DataFrame, grid: Column, extra: tuple[str, ...] = (), span: Column | None = None,
             counted: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """Window table from merged measures; ``span`` is the sum of all gaps, ``counted`` are those of ``sketched``."""
    n = F.col("pkts_total")
    span = F.col("tstamp_end") - F.col("tstamp_start") if span is None else span
    iat, size = span / n, F.col("bytes_total") / n

    def spread(squares, mean):
        return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), squares - n * mean * mean) / (n - 1))
                      ).otherwise(0.0)
    unique, entropy, conns = counted or sketched()
    return (total.select(
        "src_ip", grid.alias("window_id"), "pkts_total", "bytes_total", "tstamp_start", "tstamp_end",
        iat.alias("pkt_arrivals_avg"), spread(F.col("gap_sq"), iat).alias("pkt_arrivals_std"), "pkt_size_min",
        "pkt_size_max", size.alias("pkt_size_avg"), spread(F.col("squares"), size).alias("pkt_size_std"),
        "tcp_pkt_count", "udp_pkt_count", "icmp_pkt_count", unique.alias("port_src_unique"),
        entropy.alias("port_src_entropy"), (n / conns).alias("conn_pkts_avg"),
        "pkts_frag_count", F.try_divide("ratio", "ratio_n").alias("hdrs_payload_ratio_avg"), *extra)
        .select("src_ip", *WINDOW_STATS, *extra))
