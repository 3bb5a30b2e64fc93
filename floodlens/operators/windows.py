"""Anchored tumbling windows and per-window statistics of each source.

Windows are anchored at the first packet. A packet lying exactly on a window edge stays
in the window before it while that window is open, otherwise it opens its own. Whether
an edge is "own" depends on the windows before it, so it is resolved on the window
calendar (one row per non-empty window), never on packets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from floodlens.functions.blocks import BLOCK_ROWS, running_max
from floodlens.functions.moments import merged_deviation, sample_std, squared_deviation
from floodlens.options import WindowOptions
from floodlens.schemas import WINDOW_STATS
from floodlens.session import cut

_BUCKET = 65_536
KEY = ["src_ip", "cell"]


@dataclass(frozen=True)
class Calendar:
    """The non-empty windows of an input, materialised once and shared by the operators.

    ``windows`` has one row per window: ``cell``, dense ``window_id``, first packet, and the
    first packet of the next window. ``moved`` lists the cells whose edge packets stay in
    the window before; it is ``None`` in the usual case that there are none.
    """

    origin: int | None
    last_cell: int | None
    windows: DataFrame
    moved: DataFrame | None


def _grid(packets: DataFrame, origin: int | None, opts: WindowOptions) -> DataFrame:
    rel = F.col("ts_ns") - F.lit(origin or 0).cast("long")
    w = opts.window_ns
    return (packets.withColumn("_rel", rel)
            .withColumn("cell", F.expr(f"_rel div {w}"))
            .withColumn("_edge", F.col("_rel") % w == 0)
            .drop("_rel"))


def _edge_owners(cells: DataFrame) -> DataFrame:
    """Decide for every cell with edge packets whether they open it (``own``)."""
    before = cells.select((F.col("cell") + 1).alias("cell"),
                          F.col("inner_first").isNotNull().alias("prev_inner"),
                          F.col("edge_first").isNotNull().alias("prev_edge"))
    joined = cells.join(before, "cell", "left")
    has_edge = F.col("edge_first").isNotNull()
    prev_inner = F.coalesce(F.col("prev_inner"), F.lit(False))
    prev_edge = F.coalesce(F.col("prev_edge"), F.lit(False))
    # An edge is settled when the window before it surely is open (not own) or surely has
    # nothing in it (own). Otherwise ownership alternates from the last settled edge.
    settled = F.when(has_edge & prev_inner, F.struct("cell", F.lit(False).alias("own")))
    settled = settled.when(has_edge & ~prev_edge, F.struct("cell", F.lit(True).alias("own")))
    marked = (joined.withColumn("_settled", settled)
              .withColumn("_bucket", F.expr(f"cell div {_BUCKET}")))
    tops = marked.groupBy("_bucket").agg(F.max("_settled").alias("_top"))
    carry = tops.select("_bucket", F.max("_top").over(
        Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inside = (Window.partitionBy("_bucket").orderBy("cell")
              .rowsBetween(Window.unboundedPreceding, 0))
    anchor = F.coalesce(F.max("_settled").over(inside), F.col("_carry"))
    flips = (F.col("cell") - F.col("_anchor")["cell"]) % 2 == 1
    return (marked.join(carry, "_bucket", "left")
            .withColumn("_anchor", anchor)
            .withColumn("own", F.when(has_edge, F.col("_anchor")["own"] != flips)))


def _dense_ids(cells: DataFrame) -> DataFrame:
    """Dense ids and the next window's first packet.

    Windows are ranked in buckets of cells, the buckets' sizes give the ranks before them.
    """
    first = [F.col("first")["frame_no"].alias("first_frame"), F.col("first")["ts_ns"].alias("first_ts")]
    cells = cells.withColumn("_bucket", F.expr(f"cell div {_BUCKET}"))
    sizes = cells.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offset = sizes.select("_bucket", F.coalesce(F.sum("_n").over(
        Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("cell"))
    ids = (cells.join(offset, "_bucket")
           .select("cell", (rank - 1 + F.col("_before")).alias("window_id"), *first))
    after = ids.select((F.col("window_id") - 1).alias("window_id"),
                       F.col("first_frame").alias("next_frame"), F.col("first_ts").alias("next_ts"))
    return cut(ids.join(after, "window_id", "left"))


def build_calendar(packets: DataFrame, opts: WindowOptions, origin: int | None = None) -> Calendar:
    """Scan the time column twice (minimum, unless it is given, then cells) and keep one row per window."""
    if origin is None:
        origin = packets.agg(F.min("ts_ns")).first()[0]
    stamp = F.struct("ts_ns", "frame_no")
    cells = cut(_grid(packets, origin, opts).groupBy("cell")
                .agg(F.min(F.when(~F.col("_edge"), stamp)).alias("inner_first"),
                     F.min(F.when(F.col("_edge"), stamp)).alias("edge_first")))
    edges = F.count_if(F.col("edge_first").isNotNull() & (F.col("cell") > 0))
    shared, last = cells.agg(edges, F.max("cell")).first()
    first = F.coalesce("edge_first", "inner_first")
    moved = None
    # only the very first packet lies on an edge in most captures
    if shared:
        owners = cut(_edge_owners(cells).select("cell", "inner_first", "edge_first", "own"))
        own = F.coalesce(F.col("own"), F.lit(False))
        kept = own | F.col("inner_first").isNotNull()
        stay, last = owners.agg(F.count_if(~F.col("own")), F.max(F.when(kept, F.col("cell")))).first()
        if stay:
            moved = owners.filter(~F.col("own")).select("cell")
        first = F.when(own, F.col("edge_first")).otherwise(F.col("inner_first"))
        cells = owners.filter(kept)
    ids = _dense_ids(cells.select("cell", first.alias("first")))
    return Calendar(origin, last, ids, moved)


def assign_windows(packets: DataFrame, opts: WindowOptions,
                   calendar: Calendar | None = None) -> DataFrame:
    """Add ``cell`` (grid number of the window) to every packet."""
    calendar = calendar or build_calendar(packets, opts)
    grid = _grid(packets, calendar.origin, opts)
    if calendar.moved is None:
        return grid.drop("_edge")
    moved = calendar.moved.select(F.col("cell").alias("_edge_cell"), F.lit(1).alias("_back"))
    # packets off the edge match nothing: give them spread-out negative keys, so that a
    # shuffled join (if the edge table outgrows a broadcast) stays even
    spread = -1 - F.pmod(F.col("frame_no"), F.lit(4096))
    grid = grid.withColumn("_edge_cell", F.when(F.col("_edge"), F.col("cell")).otherwise(spread))
    return (grid.join(moved, "_edge_cell", "left")
            .withColumn("cell", F.col("cell") - F.coalesce("_back", F.lit(0)))
            .drop("_edge_cell", "_edge", "_back"))


def arrival_windows(packets: DataFrame, opts: WindowOptions, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Calendar]:
    """Windows by order of arrival (``frame_no``): a late packet belongs to the window that is open when it comes.

    The open window is that of the newest time so far, which is a running maximum over blocks of frame numbers. Adds
    ``open_ns``, that time, and ``cell``; gives the calendar of those windows too. Times stay as they are.
    """
    rows = running_max(packets, [], "frame_no", F.col("ts_ns"), "open_ns", block_rows).withColumnRenamed("ts_ns", "_own")
    rows = rows.withColumn("ts_ns", F.col("open_ns"))
    calendar = build_calendar(rows, opts)
    return assign_windows(rows, opts, calendar).drop("ts_ns").withColumnRenamed("_own", "ts_ns"), calendar


def closed_windows(packets: DataFrame, opts: WindowOptions,
                   calendar: Calendar | None = None) -> DataFrame:
    """Packets with ``cell``, without the window still open at the end of the input."""
    calendar = calendar or build_calendar(packets, opts)
    windowed = assign_windows(packets, opts, calendar)
    if opts.flush_last or calendar.last_cell is None:
        return windowed
    return windowed.filter(F.col("cell") < calendar.last_cell)


def _size() -> Column:
    return F.col("len_headers") + F.col("len_payload")


def additive_measures() -> dict[str, tuple]:
    """Registry of measures that merge slice by slice: name -> (slice aggregate, merge)."""
    ratio = F.when(_size() != 0, F.col("len_headers") / _size())
    return {
        "pkts_total": (F.count(F.lit(1)), F.sum),
        "bytes_total": (F.sum(_size()), F.sum),
        "tstamp_start": (F.min("ts_ns"), F.min),
        "tstamp_end": (F.max("ts_ns"), F.max),
        "pkt_size_min": (F.min(_size()), F.min),
        "pkt_size_max": (F.max(_size()), F.max),
        "tcp_pkt_count": (F.count_if(F.col("proto_l4") == 6), F.sum),
        "udp_pkt_count": (F.count_if(F.col("proto_l4") == 17), F.sum),
        "icmp_pkt_count": (F.count_if(F.col("proto_l4") == 1), F.sum),
        "pkts_frag_count": (F.count_if(F.col("fragmented")), F.sum),
        "_ratio_sum": (F.sum(ratio), F.sum),
        "_ratio_n": (F.count(ratio), F.sum),
    }


def window_volume_stats(windowed: DataFrame, opts: WindowOptions,
                        extra: dict[str, tuple] | None = None) -> DataFrame:
    """Counts, bounds, sizes, gaps, protocols per ``(src_ip, cell)``.

    Gaps need packet order. Packets are ordered inside time slices of a window; the gaps
    between slices are added from the slice table.
    """
    measures = {**additive_measures(), **(extra or {})}
    sliced = windowed.withColumn("_slice", F.expr(f"ts_ns div {opts.slice_ns}"))
    order = Window.partitionBy(*KEY, "_slice").orderBy("ts_ns", "frame_no")
    sliced = sliced.withColumn("_gap", F.col("ts_ns") - F.lag("ts_ns").over(order))
    slices = sliced.groupBy(*KEY, "_slice").agg(
        *[agg.alias(name) for name, (agg, _) in measures.items()],
        F.count("_gap").alias("_gap_n"), F.avg("_gap").alias("_gap_mean"),
        squared_deviation(F.col("_gap")).alias("_gap_m2"),
        F.avg(_size()).alias("_size_mean"), squared_deviation(_size()).alias("_size_m2"))
    whole = Window.partitionBy(*KEY)
    n = F.sum("pkts_total").over(whole)
    slices = slices.withColumns({
        "_bridge": F.col("tstamp_start")
        - F.lag("tstamp_end").over(whole.orderBy("_slice")),
        "_iat": (F.max("tstamp_end").over(whole) - F.min("tstamp_start").over(whole)) / n,
        "_size_all": F.sum("bytes_total").over(whole) / n})
    # the first packet counts as a zero gap, so the divisor is the packet count
    lead = F.coalesce(F.col("_bridge"), F.lit(0)) - F.col("_iat")
    merged = slices.groupBy(*KEY).agg(
        *[merge(name).alias(name) for name, (_, merge) in measures.items()],
        F.first("_iat").alias("pkt_arrivals_avg"), F.first("_size_all").alias("pkt_size_avg"),
        (merged_deviation(F.col("_gap_n"), F.col("_gap_mean"), F.col("_gap_m2"), F.col("_iat"))
         + F.sum(lead * lead)).alias("_iat_m2"),
        merged_deviation(F.col("pkts_total"), F.col("_size_mean"), F.col("_size_m2"),
                         F.col("_size_all")).alias("_size_m2"))
    return merged.select(
        "*", sample_std(F.col("_iat_m2"), F.col("pkts_total")).alias("pkt_arrivals_std"),
        sample_std(F.col("_size_m2"), F.col("pkts_total")).alias("pkt_size_std"),
        F.try_divide("_ratio_sum", "_ratio_n").alias("hdrs_payload_ratio_avg"),
    ).drop("_iat_m2", "_size_m2", "_ratio_sum", "_ratio_n")


def _normalised(sum_clogc: Column, n: Column) -> Column:
    """1 - sum(c*log2 c)/(n*log2 n): entropy over log2 of the sample count, 0 when n is 1."""
    return F.when(n > 1, F.greatest(F.lit(0.0), 1 - sum_clogc / (n * F.log2(n)))).otherwise(0.0)


def port_stats(windowed: DataFrame) -> DataFrame:
    """Exact unique source ports, port entropy and connection count per ``(src_ip, cell)``.

    Distincts are grouped away level by level, each with a map-side combine, so no
    task sees more than the distinct values of its keys.
    """
    conns = windowed.groupBy(*KEY, "src_port", "dst_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("_c"))
    ports = conns.groupBy(*KEY, "src_port").agg(F.sum("_c").alias("_c"),
                                                F.count(F.lit(1)).alias("_conns"))
    n = F.sum("_c")
    return ports.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("port_src_unique"),
        _normalised(F.sum(F.col("_c") * F.log2("_c")), n).alias("port_src_entropy"),
        (n / F.sum("_conns")).alias("conn_pkts_avg"))


def sample_ports(windowed: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """At most ``k`` packets per ``(src_ip, cell)``: the k smallest seeded hashes.

    Spark limits each map task to k rows per group before the shuffle.
    """
    ticket = F.md5(F.concat(F.col("frame_no").cast("string"), F.lit(f":{seed}")))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("_ticket", "frame_no"))
    return (windowed.withColumn("_ticket", ticket).withColumn("_rank", rank)
            .filter(F.col("_rank") <= k).drop("_ticket", "_rank"))


def sampled_entropy(windowed: DataFrame, k: int, seed: int = 7) -> DataFrame:
    counts = sample_ports(windowed, k, seed).groupBy(*KEY, "src_port").agg(
        F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*KEY).agg(_normalised(
        F.sum(F.col("_c") * F.log2("_c")), F.sum("_c")).alias("port_src_entropy"))


def port_sketches(lg_k: int = 9) -> dict[str, tuple]:
    """Mergeable distinct-count measures (2**lg_k registers)."""
    conn = F.concat_ws("|", F.col("src_port").cast("string"), "dst_ip",
                       F.col("dst_port").cast("string"))
    return {
        "_ports_sketch": (F.hll_sketch_agg(F.col("src_port").cast("long"), lg_k),
                          F.hll_union_agg),
        "_conn_sketch": (F.hll_sketch_agg(conn, lg_k), F.hll_union_agg),
    }


def window_stats(packets: DataFrame, opts: WindowOptions, calendar: Calendar | None = None,
                 distinct: str = "exact", entropy: str = "exact", seed: int = 7,
                 qualified: bool = True) -> DataFrame:
    """The full per-window table of qualifying windows, keyed ``(src_ip, window_id)``.

    ``distinct='sketch'`` and ``entropy='sampled'`` bound the work per source by sketches
    and by a fixed-size port sample.
    """
    if distinct not in ("exact", "sketch") or entropy not in ("exact", "sampled"):
        raise ValueError("distinct: exact|sketch, entropy: exact|sampled")
    calendar = calendar or build_calendar(packets, opts)
    windowed = closed_windows(packets, opts, calendar)
    sketched = port_sketches() if distinct == "sketch" else None
    stats = window_volume_stats(windowed, opts, sketched)
    if qualified:
        stats = stats.filter(F.col("pkts_total") >= opts.packets_min)
    if distinct == "exact" or entropy == "exact":
        ports = port_stats(windowed)
        if distinct == "sketch":
            ports = ports.select(*KEY, "port_src_entropy")
        elif entropy == "sampled":
            ports = ports.drop("port_src_entropy")
        stats = stats.join(ports, KEY)
    if distinct == "sketch":
        stats = (stats.withColumn("port_src_unique", F.hll_sketch_estimate("_ports_sketch"))
                 .withColumn("conn_pkts_avg", F.col("pkts_total")
                             / F.hll_sketch_estimate("_conn_sketch"))
                 .drop("_ports_sketch", "_conn_sketch"))
    if entropy == "sampled":
        stats = stats.join(sampled_entropy(windowed, opts.samples_size, seed), KEY)
    ids = calendar.windows.select("cell", "window_id")
    return stats.join(ids, "cell").select("src_ip", "cell", *WINDOW_STATS)
