"""Exponentially damped statistics of streams.

A stream's weight, sum and sum of squares decay by 2**(-rate * gap) between its rows. With
time cut into spans of 256 half-lives, the decayed running sum at time t is an ordinary
running sum of v * 2**(rate*t - 256*span), scaled back. Inside a span exponents stay below
256, so nothing overflows; across spans only the span before matters, since older
rows have decayed below 2**-256 of a new one, far under double precision. So the
whole operator is additive: rows are summed inside blocks of a bounded number of rows, and
blocks and spans are chained through small tables.

``order`` is a unique integer row number that follows time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from floodlens.functions.blocks import (BLOCK_ROWS, asof_last, attach, previous, running_max,
                                        with_block)
from floodlens.session import cut, cut_last

SPAN = 256
#: Half-lives of the fastest rate in a block of ``block_prefixes``.
REACH = 128


# Default decay rates (per time unit), as many as vector parts.
RATES = (5.0, 3.0, 1.0, 0.1, 0.01)


def with_rates(df: DataFrame, rates=RATES) -> DataFrame:
    return df.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))


def arrival_times(df: DataFrame, keys: list[str], order: str, time: str = "t",
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For unsorted input: a late row causes no decay, so it acts at the newest time so far."""
    return running_max(df, keys, order, F.col(time), time, block_rows)


def damped_sums(spark: SparkSession, make: Callable[[], DataFrame], keys: list[str], order: str, exponent: Column,
                sums: dict[str, Column], block: str, only: Column) -> DataFrame:
    """Decayed running sums over ``keys`` at the rows named by ``only``; ``exponent`` is rate * time, from 0 on.

    ``make`` gives the rows with the column ``block``, numbers of blocks that follow ``order``. They are summed inside blocks where
    they lie, so only the rows asked for and one at the end of each block are stored; what was cut on the way goes.
    """
    groups = [*keys, "_span", "_blk"]

    def inside():
        base = (make().withColumnRenamed(block, "_blk").withColumn("_e", exponent)
                .withColumn("_span", F.floor(F.col("_e") / SPAN))
                .withColumn("_u", F.pow(F.lit(2.0), F.col("_e") - F.col("_span") * SPAN))
                .withColumns({f"_v_{n}": F.col("_u") * c for n, c in sums.items()}))
        group = Window.partitionBy(*groups).orderBy(order)
        upto = group.rowsBetween(Window.unboundedPreceding, 0)
        spent = {"_e", *[f"_v_{n}" for n in sums]}
        others = [c for c in base.columns if c not in spent]
        return base.select(*others, *[F.sum(f"_v_{n}").over(upto).alias(f"_t_{n}") for n in sums],
                           F.lead(F.lit(1)).over(group).isNull().alias("_end")).filter(only | F.col("_end"))
    rows = cut_last(spark, inside)
    state = carried_sums(rows.filter("_end").select(*groups, *[f"_t_{n}" for n in sums]), keys, list(sums))
    out = attach(rows.filter(only), state, groups).withColumns(
        {n: (F.col(f"_t_{n}") + F.col(f"_o_{n}")) / F.col("_u") for n in sums})
    return out.drop(*[f"_{p}_{n}" for n in sums for p in "to"], "_u", "_span", "_blk", "_end")


def carried_sums(totals: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """What the blocks and the span before leave to each block (``_o_<name>``), from the blocks' own sums ``_t_<name>``."""
    groups = [*keys, "_span", "_blk"]
    before = (Window.partitionBy(*keys, "_span").orderBy("_blk")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*groups, *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}")
                                       for n in names])
    carried = (totals.groupBy(*keys, "_span")
               .agg(*[(F.sum(f"_t_{n}") * 2.0 ** -SPAN).alias(f"_c_{n}") for n in names])
               .withColumn("_span", F.col("_span") + 1))
    state = attach(offsets, carried, [*keys, "_span"])
    zero = F.lit(0.0)
    return state.select(*groups, *[
        (F.coalesce(f"_o_{n}", zero) + F.coalesce(f"_c_{n}", zero)).alias(f"_o_{n}")
        for n in names])


def block_prefixes(df: DataFrame, keys: list[str], order: str, time: str, sums: dict[str, tuple],
                   rates=RATES, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Running damped moments of several columns at several rates, block by block.

    ``sums`` names a function of the rate's position and a degree each: for every power k up to the degree,
    the sums of value * 2**(rate*y) * y**k are formed, y being the time since the start of the block.
    Returns the rows with arrays ``<name><k>`` over the rates, running inside their block (``_blk``, ``_span``) that starts
    at ``_tau``; and one row per block with ``_tau``, its number ``_seq`` in the stream, the whole block's
    ``t_<name><k>`` and ``c_<name><k>``, what all blocks before it leave at its start, about its start.
    """
    rates = [float(r) for r in rates]
    fast = max(rates)
    base = (with_block(df, order, block_rows).withColumnRenamed("__block", "_blk")
            .withColumn("_span", F.floor(F.col(time) * fast / REACH))
            .withColumn("_tau", F.col("_span") * (REACH / fast)))
    groups = [*keys, "_blk", "_span"]
    y = F.col(time) - F.col("_tau")
    names = [(n, k) for n, (_, degree) in sums.items() for k in range(degree + 1)]
    grown = [F.pow(F.lit(2.0), y * r) for r in rates]
    values = {}
    for n, (value, degree) in sums.items():
        for i in range(len(rates)):
            term = value(i) * grown[i]
            for k in range(degree + 1):
                values[f"_v_{n}{k}_{i}"] = term
                term = term * y
    inner = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    def over_rates(of, prefix=""):
        return {f"{prefix}{n}{k}": F.array(*[of(f"_v_{n}{k}_{i}") for i in range(len(rates))]) for n, k in names}
    # rows are dealt before their terms are formed, so that those do not travel
    rows = base.repartition(*groups).withColumns(values).withColumns({c: F.sum(c).over(inner) for c in values})
    rows = rows.withColumns(over_rates(F.col)).drop(*values)
    totals = base.withColumns(values).groupBy(*groups).agg(F.first("_tau").alias("_tau"), *[
        F.sum(c).alias(c) for c in values])
    totals = totals.select(*groups, "_tau", *[c.alias(n) for n, c in over_rates(F.col, "t_").items()])
    return rows, _chained(totals, keys, names, rates)


def _shifted(moments: list[Column], by: Column) -> list[Column]:
    """Moments about a point that lies ``by`` earlier."""
    out = [moments[0]]
    if len(moments) > 1:
        out.append(moments[1] + by * moments[0])
    if len(moments) > 2:
        out.append(moments[2] + 2 * by * moments[1] + by * by * moments[0])
    return out


def _chained(totals: DataFrame, keys: list[str], names: list[tuple], rates: list[float]) -> DataFrame:
    """Adds ``_seq`` and the carried moments ``c_*`` of each block; see ``block_prefixes``.

    Blocks are summed about the start of spans of ``REACH`` half-lives. A block may end in the span after the one where it
    starts; of the spans before, the last two still count.
    """
    order = ["_blk", "_span"]
    powers = {n: [k for m, k in names if m == n] for n, _ in names}
    numbered = totals.withColumn("_seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    small = numbered.select(
        *keys, *order, "_tau", "_seq", F.posexplode(F.array(*[F.lit(r) for r in rates])).alias("_i", "_rate"),
        *[f"t_{n}{k}" for n, k in names])
    at = F.col("_rate") * F.col("_tau")
    small = (small.withColumn("_far", F.floor(at / REACH)).withColumn("_o", at - F.col("_far") * REACH)
             .withColumn("_lag", F.col("_o") / F.col("_rate")))
    small = small.withColumns({
        f"_a_{n}{k}": moment * F.pow(F.lit(2.0), F.col("_o")) for n, ks in powers.items()
        for k, moment in enumerate(_shifted([F.get(F.col(f"t_{n}{k}"), F.col("_i")) for k in ks], F.col("_lag")))})
    group = [*keys, "_i", "_far"]
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    small = small.withColumns({f"_e_{n}{k}": F.coalesce(F.sum(f"_a_{n}{k}").over(before), zero) for n, k in names})
    whole = small.groupBy(*group).agg(F.first("_rate").alias("_r"), *[F.sum(f"_a_{n}{k}").alias(f"_z_{n}{k}") for n, k in names])
    for n in (1, 2):
        back = F.lit(-float(n * REACH)) / F.col("_r")
        earlier = whole.select(*keys, "_i", (F.col("_far") + n).alias("_far"), *[
            (moment * 2.0 ** (-n * REACH)).alias(f"_z{n}_{name}{k}") for name, ks in powers.items()
            for k, moment in enumerate(_shifted([F.col(f"_z_{name}{k}") for k in ks], back))])
        small = attach(small, earlier, group)
    small = small.withColumns({f"_e_{n}{k}": F.col(f"_e_{n}{k}") + F.coalesce(f"_z1_{n}{k}", zero) + F.coalesce(f"_z2_{n}{k}", zero)
                               for n, k in names})
    carried = [(moment * F.pow(F.lit(2.0), -F.col("_o"))).alias(f"c_{n}{k}") for n, ks in powers.items()
               for k, moment in enumerate(_shifted([F.col(f"_e_{n}{k}") for k in ks], -F.col("_lag")))]
    packed = (small.select(*keys, *order, "_tau", "_seq", "_i", *[f"t_{n}{k}" for n, k in names], *carried)
              .groupBy(*keys, *order).agg(
        F.first("_tau").alias("_tau"), F.first("_seq").alias("_seq"), *[F.first(f"t_{n}{k}").alias(f"t_{n}{k}") for n, k in names],
        F.sort_array(F.collect_list(F.struct("_i", *[f"c_{n}{k}" for n, k in names]))).alias("_c")))
    return packed.withColumns({f"c_{n}{k}": F.col("_c")[f"c_{n}{k}"] for n, k in names}).drop("_c")


def damped_states(df: DataFrame, keys: list[str], value: str, rates=RATES, order: str = "frame_no",
                  time: str = "t", block_rows: int = BLOCK_ROWS, name: str = "st") -> DataFrame:
    """Adds ``name``: an array with the stream's rate, weight, mean and variance after each row, in order of ``rates``.

    The rows are stored first, since rows and blocks both read them.
    """
    df = cut(df)
    v = F.col(value).cast("double")
    sums = {"w": (lambda i: F.lit(1.0), 0), "s": (lambda i: v, 0), "q": (lambda i: v * v, 0)}
    rows, blocks = block_prefixes(df, keys, order, time, sums, rates, block_rows)
    groups = [*keys, "_blk", "_span"]
    rows = attach(rows, blocks.select(*groups, "c_w0", "c_s0", "c_q0"), groups)
    y = F.col(time) - F.col("_tau")

    def state(i, rate):
        fade = F.pow(F.lit(2.0), y * -float(rate))
        w, s, q = [(F.col(f"{n}0")[i] + F.col(f"c_{n}0")[i]) * fade for n in "wsq"]
        return F.struct(F.lit(float(rate)).alias("rate"), w.alias("weight"), (s / w).alias("mean"),
                        F.abs(q / w - (s / w) * (s / w)).alias("var"))
    return (rows.withColumn(name, F.array(*[state(i, r) for i, r in enumerate(rates)]))
            .drop("_blk", "_span", "_tau", *[f"{p}{n}0" for p in ("", "c_") for n in "wsq"]))


def by_rate(states: DataFrame, name: str = "st") -> DataFrame:
    """One row for each rate instead of the array."""
    return states.withColumn(name, F.explode(name)).select(*[c for c in states.columns if c != name], f"{name}.*")


def _moments(df: DataFrame) -> DataFrame:
    mean = F.col("_s") / F.col("_w")
    var = F.abs(F.col("_q") / F.col("_w") - mean * mean)
    return df.withColumns({"weight": F.col("_w"), "mean": mean, "var": var}).drop("_w", "_s", "_q")


def _aggregates(value: Column) -> dict[str, Column]:
    return {"_w": F.lit(1.0), "_s": value, "_q": value * value}


def damped_1d(df: DataFrame, keys: list[str], value: str, rates=RATES, order: str = "frame_no",
              time: str = "t", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Weight, mean and variance of the stream after each row, per rate (one row per rate)."""
    return by_rate(damped_states(df, keys, value, rates, order, time, block_rows))


def jitter(df: DataFrame, keys: list[str], order: str = "frame_no", time: str = "t",
           block_rows: int = BLOCK_ROWS, name: str = "gap") -> DataFrame:
    """Time since the previous row of the stream; 0 for the first and for late rows."""
    out = previous(df, keys, order, {"_before": F.col(time)}, block_rows)
    gap = F.greatest(F.lit(0.0), F.col(time) - F.col("_before"))
    return out.withColumn(name, F.when(F.col("_before").isNull(), 0.0).otherwise(gap)).drop("_before")


def damped_jitter(df: DataFrame, keys: list[str], rates=RATES,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    gaps = jitter(df, keys, block_rows=block_rows)
    return damped_1d(gaps, keys, "gap", rates, block_rows=block_rows)


def damped_state(df: DataFrame, keys: list[str], value: str, rates=RATES,
                 time: str = "t") -> DataFrame:
    """Final state per stream and rate: plain partial aggregation per span, no row ordering."""
    groups = [*keys, "rate"]
    e = F.col("rate") * F.col(time)
    rated = (with_rates(df, rates).withColumn("_span", F.floor(e / SPAN))
             .withColumn("_u", F.pow(F.lit(2.0), e - F.col("_span") * SPAN)))
    v = F.col(value).cast("double")
    spans = rated.groupBy(*groups, "_span").agg(
        F.max(time).alias("last_t"), F.max("_u").alias("_top"),
        *[F.sum(F.col("_u") * c).alias(n) for n, c in _aggregates(v).items()])
    by_span = Window.partitionBy(*groups).orderBy("_span")
    newest = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("_span")))
    near = F.lag("_span").over(by_span) == F.col("_span") - 1
    spans = spans.withColumns({
        f"_p{n}": F.when(near, F.lag(n).over(by_span) * 2.0 ** -SPAN).otherwise(0.0)
        for n in ("_w", "_s", "_q")}).withColumn("_new", newest).filter("_new = 1")
    spans = spans.withColumns({n: (F.col(n) + F.col(f"_p{n}")) / F.col("_top")
                               for n in ("_w", "_s", "_q")})
    return _moments(spans).select(*groups, "last_t", "weight", "mean", "var")


def evict(state: DataFrame, now, cutoff: float) -> DataFrame:
    """Streams whose weight, decayed to ``now``, is still above the cutoff."""
    gap = F.greatest(F.lit(0.0), F.lit(now) - F.col("last_t"))
    weight = F.col("weight") * F.pow(F.lit(2.0), -F.col("rate") * gap)
    return state.withColumn("weight", weight).filter(F.col("weight") > cutoff)


def combined_state(state: DataFrame, key: str, members: list[str]) -> DataFrame:
    """Radius and magnitude over several streams, per rate."""
    return state.filter(F.col(key).isin(*members)).groupBy("rate").agg(
        F.sqrt(F.sum("var")).alias("radius"),
        F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("magnitude"))


def both_states(states: DataFrame, key: str, peer: str, rates=RATES, order: str = "frame_no", block_rows: int = BLOCK_ROWS,
                squared_variance: bool = False, kept: tuple[str, ...] = ("weight", "mean", "var")) -> DataFrame:
    """Adds radius and magnitude of a stream and its peer to each state in ``st``, with one lookup for all rates.

    A peer without rows so far counts as 0. ``squared_variance`` is the other radius definition in use,
    the root of the summed squared variances. ``rates`` are those of ``st``; of a stream's own statistics those in ``kept``
    stay. The states are stored first, as plain columns: they are read as streams and as peers.
    """
    others = [c for c in states.columns if c != "st"]
    of = [(n, i) for i in range(len(rates)) for n in dict.fromkeys((*kept, "mean", "var"))]
    own = cut(states.select(*others, *[F.col("st")[i][n].alias(f"_{n}{i}") for n, i in of]))
    theirs = {f"_their_{n}{i}": f"_{n}{i}" for n, i in of if n in ("mean", "var")}
    right = own.select(F.col(key).alias("_peer"), order, *[F.col(c).alias(n) for n, c in theirs.items()])
    out = asof_last(own.withColumn("_peer", F.col(peer)), right, ["_peer"], order, list(theirs), block_rows=block_rows)

    def joined(i, rate):
        a, b, m, n = F.col(f"_var{i}"), F.coalesce(f"_their_var{i}", F.lit(0.0)), F.col(f"_mean{i}"), F.coalesce(f"_their_mean{i}", F.lit(0.0))
        spread = a * a + b * b if squared_variance else a + b
        return F.struct(F.lit(float(rate)).alias("rate"), *[F.col(f"_{c}{i}").alias(c) for c in kept],
                        F.sqrt(spread).alias("radius"), F.sqrt(m * m + n * n).alias("magnitude"))
    return out.select(*others, F.array(*[joined(i, r) for i, r in enumerate(rates)]).alias("st"))


def with_peer(own: DataFrame, key: str, peer: str, order: str = "frame_no",
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Latest mean and variance of the peer stream at each row (0 while it has none).

    Mean and variance are ratios, so they do not change while a stream only decays.
    """
    right = own.select(F.col(key).alias("_peer"), "rate", order,
                       F.col("mean").alias("peer_mean"), F.col("var").alias("peer_var"))
    left = own.withColumn("_peer", F.col(peer))
    out = asof_last(left, right, ["_peer", "rate"], order, ["peer_mean", "peer_var"],
                    block_rows=block_rows)
    return out.drop("_peer").fillna(0.0, ["peer_mean", "peer_var"])


def radius_magnitude(own: DataFrame, key: str, peer: str, squared_variance: bool = False,
                     **kw) -> DataFrame:
    """Radius and magnitude of a stream and its peer; ``squared_variance`` is the other
    radius definition in use, the root of the summed squared variances."""
    out = with_peer(own, key, peer, **kw)
    a, b = F.col("var"), F.col("peer_var")
    spread = a * a + b * b if squared_variance else a + b
    size = F.col("mean") * F.col("mean") + F.col("peer_mean") * F.col("peer_mean")
    return out.withColumns({"radius": F.sqrt(spread), "magnitude": F.sqrt(size)})


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def frame_endpoints(frames: DataFrame) -> DataFrame:
    """Source and destination of every frame: IPv4, else IPv6; ports, 'arp' or 'icmp'; else MACs."""
    v4 = _text("ip_src") != ""
    src = F.when(v4, _text("ip_src")).otherwise(_text("ipv6_src"))
    dst = F.when(v4, _text("ip_dst")).when(_text("ipv6_src") != "", _text("ipv6_dst")).otherwise("")
    sport = F.concat(_text("tcp_srcport"), _text("udp_srcport"))
    dport = F.concat(_text("tcp_dstport"), _text("udp_dstport"))
    low = F.col("_sport") == ""
    arp = low & (_text("arp_opcode") != "")
    icmp = low & ~arp & (_text("icmp_type") != "")
    bare = low & ~arp & ~icmp & (F.concat("_src", "_dst", "_dport") == "")
    return (frames.withColumns({"_src": src, "_dst": dst, "_sport": sport, "_dport": dport})
            .select("frame_no", "ts_ns", "frame_len",
                    F.col("eth_src").alias("src_mac"), F.col("eth_dst").alias("dst_mac"),
                    F.when(arp, _text("arp_src_ip")).when(bare, F.col("eth_src"))
                    .otherwise(F.col("_src")).alias("src"),
                    F.when(arp, _text("arp_dst_ip")).when(bare, F.col("eth_dst"))
                    .otherwise(F.col("_dst")).alias("dst"),
                    F.when(arp, "arp").when(icmp, "icmp").otherwise(F.col("_sport")).alias("src_proto"),
                    F.when(arp, "arp").when(icmp, "icmp").otherwise(F.col("_dport")).alias("dst_proto")))


def stream_keys(endpoints: DataFrame, unit_ns: int = 10 ** 9, origin_ns: int = 0) -> DataFrame:
    """Keys of the four stream families and the time in units since the origin.

    Parts of a key are kept apart by a separator, so different pairs never merge.
    """
    arp = F.col("src_proto") == "arp"

    def sep(*names):
        return F.concat_ws("|", *names)
    return endpoints.withColumns({
        "t": (F.col("ts_ns") - origin_ns).cast("double") / float(unit_ns),
        "mac_ip": sep("src_mac", "src"), "channel": sep("src", "dst"),
        "socket": F.when(arp, F.col("src_mac")).otherwise(sep("src", "src_proto")),
        "peer_socket": F.when(arp, F.col("dst_mac")).otherwise(sep("dst", "dst_proto"))})


def join_all(parts: list[DataFrame], on: list[str]) -> DataFrame:
    """Joins on all of ``on``. Rows are dealt by the first alone and the other numbers compared apart, so that they lie
    right for later steps by the first."""
    def joined(a, b):
        b = b.withColumnsRenamed({c: f"__{c}" for c in on})
        same = reduce(and_, [F.col(c) - F.col(f"__{c}") == 0 for c in on[1:]], F.col(on[0]) == F.col(f"__{on[0]}"))
        return a.join(b, same).drop(*[f"__{c}" for c in on])
    return reduce(joined, parts)
