"""The feature row: averages over a chunk of windows and the spread between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from floodlens.functions.blocks import running_max, running_sums
from floodlens.operators.history import history_chunks, history_ready
from floodlens.operators.windows import Calendar, build_calendar, window_stats
from floodlens.options import NS_PER_S, WindowOptions
from floodlens.schemas import FEATURES, FRAGMENT_FEATURES
from floodlens.session import cut


def _share(name: str) -> Column:
    return F.col(name) / F.col("pkts_total")


def _span() -> Column:
    return F.max("window_id") - F.min("window_id") + 1


def summary_features(truncate_totals: bool = False) -> dict[str, Column]:
    """Named aggregates over the windows of a chunk. Add an entry to add a feature."""
    seconds = (F.max("tstamp_end") - F.min("tstamp_start")) / NS_PER_S
    means = {n: F.avg(n) for n in (
        "pkts_total", "bytes_total", "pkt_arrivals_avg", "pkt_arrivals_std", "pkt_size_avg",
        "pkt_size_std", "port_src_unique", "port_src_entropy", "conn_pkts_avg",
        "hdrs_payload_ratio_avg")}
    if truncate_totals:
        for n in ("pkts_total", "bytes_total"):
            means[n] = F.floor(means[n]).cast("double")
    return {
        "window_count": F.count(F.lit(1)), "window_span": _span(), **means,
        "pkt_rate": F.try_divide(F.sum("pkts_total"), seconds),
        "byte_rate": F.try_divide(F.sum("bytes_total"), seconds),
        "pkt_size_min": F.min("pkt_size_min"), "pkt_size_max": F.max("pkt_size_max"),
        "proto_tcp_share": F.avg(_share("tcp_pkt_count")),
        "proto_udp_share": F.avg(_share("udp_pkt_count")),
        "proto_icmp_share": F.avg(_share("icmp_pkt_count")),
        "pkts_frag_share": F.avg(_share("pkts_frag_count")),
    }


def interwindow_features(opts: WindowOptions) -> dict[str, Column]:
    plain = ("pkts_total", "bytes_total", "pkt_size_avg", "pkt_size_std", "pkt_arrivals_avg",
             "port_src_unique", "port_src_entropy", "conn_pkts_avg", "hdrs_payload_ratio_avg")
    tcp, udp, icmp = (F.sum(f"{p}_pkt_count") for p in ("tcp", "udp", "icmp"))
    top = F.greatest(tcp, udp, icmp)
    ratio = {p: F.stddev_pop(_share(f"{p}_pkt_count")) for p in ("tcp", "udp", "icmp")}
    active = F.sum(F.col("tstamp_end") - F.col("tstamp_start"))
    return {
        **{f"{n}_std": F.stddev_pop(n) for n in plain},
        "pkts_frag_share_std": F.stddev_pop(_share("pkts_frag_count")),
        # ties go to TCP, then UDP
        "dominant_proto_ratio_std": F.when(tcp == top, ratio["tcp"])
        .when(udp == top, ratio["udp"]).otherwise(ratio["icmp"]),
        "intrawindow_activity_ratio": active / (F.count(F.lit(1)) * F.lit(float(opts.window_ns))),
        "interwindow_activity_ratio": F.count(F.lit(1)) / _span(),
    }


def summarise(chunked: DataFrame, opts: WindowOptions, truncate_totals: bool = False,
              extra: dict[str, Column] | None = None) -> DataFrame:
    """One feature row per ``(src_ip, chunk_id)``; both feature families in one aggregate."""
    aggs = {**summary_features(truncate_totals), **interwindow_features(opts), **(extra or {})}
    return chunked.groupBy("src_ip", "chunk_id").agg(
        F.max("window_id").alias("last_window_id"), *[a.alias(n) for n, a in aggs.items()])


#: The window measures whose average, spread or share makes the feature row; of a null the row has nothing.
_AVERAGED = ("pkts_total", "bytes_total", "pkt_arrivals_avg", "pkt_arrivals_std", "pkt_size_avg", "pkt_size_std",
             "port_src_unique", "port_src_entropy", "conn_pkts_avg", "hdrs_payload_ratio_avg")
_SHARES = {"proto_tcp_share": "tcp_pkt_count", "proto_udp_share": "udp_pkt_count", "proto_icmp_share": "icmp_pkt_count",
           "pkts_frag_share": "pkts_frag_count"}


def expanding_features(windows: DataFrame, opts: WindowOptions, truncate_totals: bool = False) -> DataFrame:
    """The whole feature row at every ready window, over all windows of the source so far (histories are kept).

    Each measure is taken relative to the source's first window and summed, as it is and squared; counts and extremes
    run along. Running values are formed inside blocks of ``history_block`` windows and carried from block to block.
    """
    values = {n: F.col(n).cast("double") for n in _AVERAGED} | {n: _share(c) for n, c in _SHARES.items()}
    base = windows.withColumns({f"_x_{n}": v for n, v in values.items()})
    first = base.groupBy("src_ip").agg(F.min_by(F.struct(
        "window_id", "tstamp_start", *[F.coalesce(f"_x_{n}", F.lit(0.0)).alias(n) for n in values]), "window_id").alias("_first"))
    base = base.join(first, "src_ip").select(
        "src_ip", "window_id", "tstamp_start", "tstamp_end", "pkt_size_min", "pkt_size_max", "pkts_total", "bytes_total",
        *_SHARES.values(), "_first", *[(F.col(f"_x_{n}") - F.col("_first")[n]).alias(f"_d_{n}") for n in values])
    sums = {"_count": F.lit(1), "_packets": F.col("pkts_total"), "_bytes": F.col("bytes_total"),
            "_active": F.col("tstamp_end") - F.col("tstamp_start"),
            **{f"_k_{c}": F.col(c) for c in _SHARES.values()}}
    for n in values:
        d = F.col(f"_d_{n}")
        sums |= {f"_n_{n}": d.isNotNull().cast("long"), f"_s_{n}": d, f"_q_{n}": d * d}
    seen = running_sums(base, ["src_ip"], "window_id", sums, opts.history_block)
    seen = running_max(seen, ["src_ip"], "window_id", -F.col("pkt_size_min"), "_low", opts.history_block)
    seen = running_max(seen, ["src_ip"], "window_id", F.col("pkt_size_max"), "_high", opts.history_block)
    ready = history_ready(windows, opts).filter("ready").select("src_ip", "window_id")
    seen = seen.join(ready, ["src_ip", "window_id"])

    def mean(n):
        return F.col("_first")[n] + F.try_divide(F.col(f"_s_{n}"), F.col(f"_n_{n}"))

    def spread(n):
        off = F.try_divide(F.col(f"_s_{n}"), F.col(f"_n_{n}"))
        return F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col(f"_q_{n}"), F.col(f"_n_{n}")) - off * off))
    count, span = F.col("_count"), F.col("window_id") - F.col("_first")["window_id"] + 1
    seconds = (F.col("tstamp_end") - F.col("_first")["tstamp_start"]) / NS_PER_S
    tcp, udp, icmp = (F.col(f"_k_{_SHARES[f'proto_{p}_share']}") for p in ("tcp", "udp", "icmp"))
    top = F.greatest(tcp, udp, icmp)
    total = (lambda n: F.floor(mean(n)).cast("double")) if truncate_totals else mean
    out = {
        "window_count": count, "window_span": span, **{n: mean(n) for n in values},
        "pkts_total": total("pkts_total"), "bytes_total": total("bytes_total"),
        "pkt_rate": F.try_divide(F.col("_packets"), seconds), "byte_rate": F.try_divide(F.col("_bytes"), seconds),
        "pkt_size_min": -F.col("_low"), "pkt_size_max": F.col("_high"),
        **{f"{n}_std": spread(n) for n in (*_AVERAGED, "pkts_frag_share") if n != "pkt_arrivals_std"},
        # ties go to TCP, then UDP
        "dominant_proto_ratio_std": F.when(tcp == top, spread("proto_tcp_share"))
        .when(udp == top, spread("proto_udp_share")).otherwise(spread("proto_icmp_share")),
        "intrawindow_activity_ratio": F.col("_active") / (count * F.lit(float(opts.window_ns))),
        "interwindow_activity_ratio": count / span,
    }
    return seen.select("src_ip", "window_id", *[out[n].alias(n) for n in FEATURES[1:]])


def history_features(windows: DataFrame, opts: WindowOptions, truncate_totals: bool = False) -> DataFrame:
    """One feature row per source over all its given windows, such as a cut history."""
    rows = summarise(windows.withColumn("chunk_id", F.lit(0)), opts, truncate_totals)
    return rows.select("src_ip", "last_window_id", *FEATURES[1:])


def flow_features(packets: DataFrame, opts: WindowOptions, calendar: Calendar | None = None,
                  truncate_totals: bool = False, **window_args) -> DataFrame:
    """Packets to feature rows. The window table is written once: chunking reads it twice."""
    calendar = calendar or build_calendar(packets, opts)
    windows = cut(window_stats(packets, opts, calendar, **window_args))
    rows = summarise(history_chunks(windows, opts), opts, truncate_totals)
    return rows.select("src_ip", "chunk_id", "last_window_id", *FEATURES[1:])


#: What the feature row is made of.
_PACKET = ("frame_no", "ts_ns", "src_ip", "dst_ip", "proto_l4", "src_port", "dst_port", "len_headers", "len_payload", "fragmented")


def labelled_dataset(classes: list[tuple[DataFrame, int]], opts: WindowOptions,
                     **window_args) -> DataFrame:
    """Feature rows of several inputs, each with its own origin and state, with ``target``.

    All inputs go through one pass: an input's times are counted from its first packet and moved to a stretch of
    its own, a whole number of windows long, and its sources are told apart by its number. No feature depends on where
    its windows lie. The last, open window of each input is dropped.
    """
    tagged = reduce(lambda a, b: a.unionByName(b), [
        p.select(*_PACKET).withColumn("_class", F.lit(k)) for k, (p, _) in enumerate(classes)])
    bounds = {r["_class"]: (r["lo"], r["hi"]) for r in tagged.groupBy("_class").agg(
        F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi")).collect()}  # a row per input
    cells = max((hi - lo for lo, hi in bounds.values()), default=0) // opts.window_ns + 2
    number = F.col("_class").cast("long")
    start = F.coalesce(*[F.when(F.col("_class") == k, F.lit(lo).cast("long")) for k, (lo, _) in bounds.items()], F.lit(0).cast("long"))
    moved = tagged.withColumns({
        "ts_ns": F.col("ts_ns") - start + number * F.lit(cells * opts.window_ns).cast("long"),
        "src_ip": F.concat(F.col("_class").cast("string"), F.lit("|"), F.col("src_ip"))}).drop("_class")
    calendar = build_calendar(moved, opts, 0)
    whole = window_stats(moved, opts.with_changes(flush_last=True), calendar, **window_args)
    if not opts.flush_last:
        open_ = (calendar.windows.groupBy(F.expr(f"cell div {cells}")).agg(F.max("cell").alias("cell")).select("cell"))
        whole = whole.join(open_, "cell", "left_anti")  # one cell per input
    rows = summarise(history_chunks(cut(whole), opts), opts)
    parted = F.split("src_ip", "[|]", 2)
    target = F.element_at(F.array(*[F.lit(t) for _, t in classes]), (parted[0].cast("int") + 1))
    return rows.select(parted[1].alias("src_ip"), "chunk_id", *FEATURES[1:], target.alias("target"))


def model_inputs(features: DataFrame, del_frag: bool = True, additional=()) -> DataFrame:
    """Drop identifiers (and fragment columns) before a model sees the rows."""
    drop = ["src_ip", "window_count", "window_span", *additional]
    return features.drop(*drop, *(FRAGMENT_FEATURES if del_frag else ()))


def strip_columns(dataset: DataFrame, keep_frag: bool = False) -> DataFrame:
    return model_inputs(dataset, del_frag=not keep_frag, additional=("target",))
