"""Queries of the damped statistics and histograms (time in days)."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.operators import damped, damped_pairs, histogram
from floodlens.plans.oracle_parts import PARTS, part, rounded, sql
from floodlens.plans.registry import DAY_NS, query

RATES = (1.0, 0.1)
BINS = histogram.Bins(0.0, 50.0, 20)

part("endpoints", """SELECT frame_no, ts_ns, frame_len, eth_src AS src_mac, eth_dst AS dst_mac,
  CASE WHEN p = '' AND arp_opcode IS NOT NULL THEN arp_src_ip
       WHEN p = '' AND icmp_type IS NULL AND s = '' THEN eth_src ELSE s END AS src,
  CASE WHEN p = '' AND arp_opcode IS NOT NULL THEN arp_dst_ip
       WHEN p = '' AND icmp_type IS NULL AND s = '' THEN eth_dst ELSE d END AS dst,
  CASE WHEN p <> '' THEN p WHEN arp_opcode IS NOT NULL THEN 'arp'
       WHEN icmp_type IS NOT NULL THEN 'icmp' ELSE '' END AS src_proto,
  CASE WHEN p <> '' THEN q WHEN arp_opcode IS NOT NULL THEN 'arp'
       WHEN icmp_type IS NOT NULL THEN 'icmp' ELSE '' END AS dst_proto
  FROM (SELECT *, coalesce(ip_src, ipv6_src, '') AS s, coalesce(ip_dst, ipv6_dst, '') AS d,
          coalesce(tcp_srcport, udp_srcport, '') AS p, coalesce(tcp_dstport, udp_dstport, '') AS q
        FROM frames) f""")
part("streams", f"""SELECT *, frame_len / 1000.0 AS frame_kb, (ts_ns - (SELECT min(ts_ns) FROM packets)) / {DAY_NS}.0 AS t,
  concat(src_mac, '|', src) AS mac_ip, concat(src, '|', dst) AS channel,
  CASE WHEN src_proto = 'arp' THEN src_mac ELSE concat(src, '|', src_proto) END AS socket,
  CASE WHEN src_proto = 'arp' THEN dst_mac ELSE concat(dst, '|', dst_proto) END AS peer_socket
  FROM endpoints""")
part("rates", "SELECT unnest([1.0, 0.1]::DOUBLE[]) AS rate")


def _state_sql(key, value="frame_kb", source="streams"):
    """Decay recurrence written as a self join of the stream."""
    return f"""SELECT frame_no, k, rate, w AS weight, s / w AS mean, abs(q / w - (s / w) * (s / w)) AS var
  FROM (SELECT a.frame_no, a.{key} AS k, r.rate, sum(pow(2, -r.rate * (a.t - b.t))) AS w,
      sum(b.{value} * pow(2, -r.rate * (a.t - b.t))) AS s,
      sum(b.{value} * b.{value} * pow(2, -r.rate * (a.t - b.t))) AS q
    FROM {source} a JOIN {source} b ON a.{key} = b.{key} AND b.frame_no <= a.frame_no, rates r
    GROUP BY a.frame_no, a.{key}, r.rate) x"""


part("timed", f"""SELECT frame_no, src_ip, len_payload / 1000.0 AS payload_kb,
  (ts_ns - (SELECT min(ts_ns) FROM packets)) / {DAY_NS}.0 AS t FROM packets""")
part("host_state", _state_sql("src"))
part("gapped", """SELECT *, coalesce(t - lag(t) OVER (PARTITION BY channel ORDER BY frame_no), 0) AS gap
  FROM streams""")

THREE = f"{rounded('weight')}, {rounded('mean')}, {rounded('var')}"


def _streams(c):
    """Sizes in kilobytes: six compared digits then stay clear of rounding noise."""
    keyed = damped.stream_keys(damped.frame_endpoints(c.frames), DAY_NS, c.calendar.origin)
    return keyed.withColumn("frame_kb", F.col("frame_len") / 1000)


def _stream_query(name, key, value="frame_kb", source="streams"):
    @query(name, sql(f"SELECT frame_no, k AS {key}, rate, {THREE} "
                     f"FROM ({_state_sql(key, value, source)}) y"))
    def run(c):
        rows = _streams(c).select("frame_no", key, "t", "frame_kb")
        if value == "gap":
            out = damped.damped_jitter(rows, [key], RATES)
        else:
            out = damped.damped_1d(rows, [key], value, RATES)
        return out.select("frame_no", key, "rate", "weight", "mean", "var")
    return run


@query("frame_endpoints", sql("""SELECT frame_no, src_mac, dst_mac, src, dst, src_proto, dst_proto
  FROM endpoints"""))
def frame_endpoints(c):
    return damped.frame_endpoints(c.frames).drop("ts_ns", "frame_len")


@query("damped_1d", sql(
    f"SELECT frame_no, k AS src_ip, rate, {THREE} "
    f"FROM ({_state_sql('src_ip', 'payload_kb', 'timed')}) y"))
def damped_1d(c):
    rows = c.packets.select(
        "frame_no", "src_ip", (F.col("len_payload") / 1000).alias("payload_kb"),
        ((F.col("ts_ns") - c.calendar.origin) / float(DAY_NS)).alias("t"))
    return damped.damped_1d(rows, ["src_ip"], "payload_kb", RATES).drop("t", "payload_kb")


_stream_query("damped_mac_ip", "mac_ip")
_stream_query("damped_host", "src")
_stream_query("damped_host_port", "socket")
_stream_query("damped_jitter", "channel", "gap", "gapped")


# The peers of the views never send, so every sixteenth frame is turned round to give them traffic.
part("duplex", """SELECT frame_no, frame_kb, t,
  CASE WHEN frame_no % 16 <> 0 THEN src ELSE dst END AS src,
  CASE WHEN frame_no % 16 <> 0 THEN dst ELSE src END AS dst FROM streams""")
part("duplex_state", _state_sql("src", "frame_kb", "duplex"))


def _duplex(c):
    even = F.col("frame_no") % 16 != 0
    return _streams(c).select(
        "frame_no", "frame_kb", "t", F.when(even, F.col("src")).otherwise(F.col("dst")).alias("src"),
        F.when(even, F.col("dst")).otherwise(F.col("src")).alias("dst"))


@query("damped_radius_magnitude", sql(f"""SELECT d.frame_no, o.rate,
  {rounded('sqrt(o.var + coalesce(p.var, 0))', 'radius')},
  {rounded('sqrt(o.mean * o.mean + coalesce(p.mean * p.mean, 0))', 'magnitude')}
  FROM duplex d JOIN duplex_state o ON d.frame_no = o.frame_no
  ASOF LEFT JOIN duplex_state p ON p.k = d.dst AND p.rate = o.rate AND p.frame_no <= d.frame_no"""))
def damped_radius_magnitude(c):
    own = damped.damped_states(_duplex(c), ["src"], "frame_kb", RATES).select("frame_no", "src", "dst", "st")
    both = damped.both_states(own, "src", "dst", RATES, kept=()).select("frame_no", "st")
    return damped.by_rate(both).select("frame_no", "rate", "radius", "magnitude")


def _pairs_sql(name: str, frames: str, key: str, peer: str, value: str, rates: str, residual: str) -> str:
    """The pair statistics written out: every update of every pair, in the order of its steps.

    Registers the parts ``<name>_*`` and gives the select of frame_no, rate, cov and pcc. A pair meets each frame of both
    its streams; a frame between the two meets it twice, the first one once.
    """
    part(f"{name}_rows", f"SELECT frame_no AS f, t, {key} AS own, {peer} AS peer, CAST({value} AS DOUBLE) AS v FROM {frames}")
    part(f"{name}_rate", rates)
    part(f"{name}_state", f"""SELECT f, own, v, rate, s / w AS mean, abs(q / w - (s / w) * (s / w)) AS var FROM (
      SELECT a.f, a.own, a.v, r.rate, sum(pow(2, -r.rate * (a.t - b.t))) AS w, sum(b.v * pow(2, -r.rate * (a.t - b.t))) AS s,
        sum(b.v * b.v * pow(2, -r.rate * (a.t - b.t))) AS q
      FROM {name}_rows a JOIN {name}_rows b ON a.own = b.own AND b.f <= a.f CROSS JOIN {name}_rate r
      GROUP BY a.f, a.own, a.v, r.rate) x""")
    part(f"{name}_link", f"""SELECT least(own, peer) AS a, greatest(own, peer) AS b, min(f) AS link
      FROM {name}_rows WHERE own <> peer GROUP BY 1, 2""")
    part(f"{name}_step", f"""SELECT a, b, link, f, t, v, own, CASE WHEN own = a THEN b ELSE a END AS other, u, n,
        (peer = a OR peer = b) AND u = n AS shown FROM (
      SELECT l.*, r.f, r.t, r.v, r.own, r.peer, CASE WHEN (r.peer = l.a OR r.peer = l.b) AND r.f > l.link THEN 2 ELSE 1 END AS n
      FROM {name}_link l JOIN {name}_rows r ON (r.own = l.a OR r.own = l.b) AND r.f >= l.link) h, (VALUES (1), (2)) k(u)
      WHERE u <= n""")
    part(f"{name}_kept", f"""SELECT a, b, own, 2 * f + u AS step, t AS t3, v AS v3, lag(t) OVER w AS t2, lag(v) OVER w AS v2,
        lag(t, 2) OVER w AS t1, lag(v, 2) OVER w AS v1 FROM {name}_step
      WINDOW w AS (PARTITION BY a, b, own ORDER BY f, u)""")
    eps = "1e-20"
    three = (f"v1 * ((t - t2) / (t1 - t2 + {eps})) * ((t - t3) / (t1 - t3 + {eps})) + v2 * ((t - t1) / (t2 - t1 + {eps})) * "
             f"((t - t3) / (t2 - t3 + {eps})) + v3 * ((t - t1) / (t3 - t1 + {eps})) * ((t - t2) / (t3 - t2 + {eps}))")
    guess = (f"CASE WHEN t3 IS NULL THEN 0 WHEN t2 IS NULL THEN v3 WHEN t1 IS NULL THEN v2 * ((t - t3) / (t2 - t3 + {eps})) + "
             f"v3 * ((t - t2) / (t3 - t2 + {eps})) WHEN (t - t3) / ((t1 - t2) / 2 + 1e-10) > 10 THEN v3 ELSE {three} END")
    part(f"{name}_guess", f"""SELECT s.*, k.step AS seen, {guess} AS guess FROM {name}_step s
      ASOF LEFT JOIN {name}_kept k ON k.a = s.a AND k.b = s.b AND k.own = s.other AND k.step < 2 * s.f + s.u""")
    own, last = (f"(CASE WHEN abs({v} - {m}) <= 1e-12 * abs({v}) THEN 0 ELSE {v} - {m} END)" for v, m in (("g.v", "m.mean"), ("p.v", "p.mean")))
    theirs = "g.guess - coalesce(p.mean, 0)" if residual == "extrapolated" else f"CASE WHEN g.seen IS NULL THEN 0 ELSE {last} END"
    part(f"{name}_each", f"""SELECT g.a, g.b, g.f, g.t, g.u, g.shown, m.rate, m.var, coalesce(p.var, 0) AS other_var,
        {own} * ({theirs}) AS product
      FROM {name}_guess g JOIN {name}_state m ON m.f = g.f
      ASOF LEFT JOIN {name}_state p ON p.own = g.other AND p.rate = m.rate AND p.f <= g.f""")
    part(f"{name}_sums", f"""SELECT x.f AS frame_no, x.rate, any_value(x.var) AS var, any_value(x.other_var) AS other_var,
        sum(y.product * pow(2, -x.rate * (x.t - y.t))) / sum(pow(2, -x.rate * (x.t - y.t))) AS cov
      FROM {name}_each x JOIN {name}_each y ON y.a = x.a AND y.b = x.b AND y.rate = x.rate AND y.f <= x.f
      WHERE x.shown GROUP BY x.f, x.rate""")
    return f"""SELECT frame_no, rate, cov, CASE WHEN sqrt(var) * sqrt(other_var) <> 0
      THEN cov / (sqrt(var) * sqrt(other_var)) ELSE 0 END AS pcc FROM {name}_sums"""


def shown(name: str) -> str:
    """Values that differ by many orders of magnitude are compared by the logarithm of their size."""
    return f"round(sign({name}) * ln(1 + abs({name})), 4)"


def _log(*names: str):
    return {n: F.round(F.signum(n) * F.log1p(F.abs(n)), 4) for n in names}


def _pair_sql(name: str, residual: str) -> str:
    body = _pairs_sql(name, "duplex", "src", "dst", "frame_kb", "SELECT rate FROM rates", residual)
    part(f"{name}_out", body)
    return sql(f"""SELECT o.frame_no, d.src, d.dst, o.rate, {rounded(shown('o.cov'), 'cov')}
  FROM {name}_out o JOIN duplex d ON d.frame_no = o.frame_no""")


@query("damped_cov", _pair_sql("cov", "extrapolated"))
def damped_cov(c):
    """Supports that coincide, because a frame between two linked streams counts twice, make guesses very large."""
    return (damped_pairs.damped_cov(_duplex(c), "src", "dst", "frame_kb", RATES)
            .withColumns(_log("cov")).select("frame_no", "src", "dst", "rate", "cov"))


@query("damped_cov_last", _pair_sql("covl", "last"))
def damped_cov_last(c):
    return (damped_pairs.damped_cov(_duplex(c), "src", "dst", "frame_kb", RATES, residual="last")
            .withColumns(_log("cov")).select("frame_no", "src", "dst", "rate", "cov"))


def _vector_sql() -> str:
    """All statistics of all frames, rate by rate, from the parts of the four stream families."""
    names, joins = [], []
    rates = "SELECT unnest([%s]::DOUBLE[]) AS rate" % ", ".join(str(r) for r in damped.RATES)
    part("vrates", rates)
    for prefix, key, value, source in (("mi", "mac_ip", "frame_kb", "streams"), ("jit", "channel", "gap", "gapped")):
        part(f"v{prefix}", _state_sql(key, value, source).replace(", rates r", ", vrates r"))
    for prefix, key, peer in (("hh", "src", "dst"), ("hphp", "socket", "peer_socket")):
        part(f"v{prefix}_cov", _pairs_sql(f"v{prefix}", "streams", key, peer, "frame_kb", rates, "extrapolated"))
        part(f"v{prefix}_one", _state_sql(key, "frame_kb", "streams").replace(", rates r", ", vrates r"))
        part(f"v{prefix}_all", f"""SELECT o.frame_no, o.rate, o.weight, o.mean, o.var, sqrt(o.var + coalesce(p.var, 0)) AS radius,
            sqrt(o.mean * o.mean + coalesce(p.mean * p.mean, 0)) AS magnitude, c.cov
          FROM v{prefix}_one o JOIN streams s ON s.frame_no = o.frame_no JOIN v{prefix}_cov c ON c.frame_no = o.frame_no AND c.rate = o.rate
          ASOF LEFT JOIN v{prefix}_one p ON p.k = s.{peer} AND p.rate = o.rate AND p.frame_no <= o.frame_no""")
    tables = {"mi": "vmi", "hh": "vhh_all", "jit": "vjit", "hphp": "vhphp_all"}
    for prefix, columns in damped_pairs.VECTOR_PARTS:
        for rate in damped.RATES:
            for column in columns:
                if column != "pcc":
                    value = f"max({prefix}.{column}) FILTER ({prefix}.rate = {rate})"
                    names.append(rounded(shown(value), f'"{prefix}_{column}_{rate:g}"'))
    joins = " ".join(f"JOIN {table} {prefix} ON {prefix}.frame_no = mi.frame_no AND {prefix}.rate = mi.rate"
                     for prefix, table in tables.items() if prefix != "mi")
    return sql(f"SELECT mi.frame_no, {', '.join(names)} FROM {tables['mi']} mi {joins} GROUP BY mi.frame_no")


@query("frame_vectors", _vector_sql())
def frame_vectors(c):
    """Without the correlations, which divide by variances that may be nothing but rounding."""
    wide = damped_pairs.frame_vectors(_streams(c).withColumn("frame_len", F.col("frame_kb")))
    names = [n for n in wide.columns if n != "frame_no" and "_pcc_" not in n]
    return wide.select("frame_no", *[F.round(F.signum(f"`{n}`") * F.log1p(F.abs(f"`{n}`")), 4).alias(n) for n in names])


_FINAL = """SELECT k AS src, rate, weight, mean, var, last_t FROM (
  SELECT h.*, s.t AS last_t, row_number() OVER (PARTITION BY h.k, h.rate ORDER BY h.frame_no DESC) AS r
  FROM host_state h JOIN streams s ON h.frame_no = s.frame_no) x WHERE r = 1"""


def _host_state(c):
    return damped.damped_state(_streams(c), ["src"], "frame_kb", RATES)


@query("damped_state", sql(f"SELECT src, rate, {THREE}, {rounded('last_t')} FROM ({_FINAL}) y"))
def damped_state(c):
    return _host_state(c)


@query("damped_nd", sql(f"""SELECT rate, {rounded('sqrt(sum(var))', 'radius')},
  {rounded('sqrt(sum(mean * mean))', 'magnitude')} FROM ({_FINAL}) y
  WHERE src IN ('10.0.0.1', '10.0.0.2', '10.0.0.3') GROUP BY rate"""))
def damped_nd(c):
    return damped.combined_state(_host_state(c), "src", ["10.0.0.1", "10.0.0.2", "10.0.0.3"])


@query("damped_evict", sql(f"""SELECT src, rate, {rounded('weight * pow(2, -rate * (31 - last_t))', 'weight')}
  FROM ({_FINAL}) y WHERE weight * pow(2, -rate * (31 - last_t)) > 0.2"""))
def damped_evict(c):
    return damped.evict(_host_state(c), 31.0, 0.2).select("src", "rate", "weight")


# --- histograms ----------------------------------------------------------------------

part("timed_scores", f"""SELECT s.*, (p.ts_ns - (SELECT min(ts_ns) FROM packets)) / {DAY_NS}.0 AS t
  FROM scores s JOIN packets p ON s.row_no = p.frame_no""")
part("hist", """SELECT bin, max(t) AS last_t, sum(pow(2, -0.1 * (top - t))) AS weight FROM (
  SELECT *, max(t) OVER (PARTITION BY bin) AS top FROM (
    SELECT *, CAST(floor(score / 2.5) AS BIGINT) AS bin FROM timed_scores) b
  WHERE bin BETWEEN 0 AND 19) x GROUP BY bin""")


def _timed(c):
    t = ((F.col("ts_ns") - c.calendar.origin) / float(DAY_NS)).alias("t")
    times = c.packets.select(F.col("frame_no").alias("row_no"), t)
    return c.scores.join(times, "row_no")


def _hist(c):
    return histogram.decayed_histogram(_timed(c), "score", "t", BINS, 0.1)


@query("decayed_histogram", sql(f"SELECT bin, {rounded('weight')}, {rounded('last_t')} FROM hist"))
def decayed_histogram(c):
    return _hist(c)


@query("learned_bins", sql(f"""SELECT {rounded('2 * min(score) - max(score)', 'lower')},
  {rounded('2 * max(score) - min(score)', 'upper')}, 300 AS used FROM scores WHERE row_no < 299"""))
def learned_bins(c):
    """Range of the first rows of the scores, the learning period."""
    bins, used = histogram.learn_bins(c.scores, "score", "row_no", 300, 20)
    return c.spark.createDataFrame([(bins.lower, bins.upper, used)], "lower double, upper double, used int")


@query("histogram_decayed_to", sql(f"""SELECT bin, {rounded(
    'weight * pow(2, -0.1 * greatest(0, 40 - last_t))', 'weight')} FROM hist"""))
def histogram_decayed_to(c):
    return histogram.decay_to(_hist(c), 40.0, 0.1).select("bin", "weight")


@query("histogram_freq", sql(f"SELECT bin, {rounded('weight / sum(weight) OVER ()', 'freq')} FROM hist"))
def histogram_freq(c):
    return histogram.histogram_freq(_hist(c)).select("bin", "freq")


@query("histogram_score", sql(f"""SELECT s.row_no, {rounded(
    'CASE WHEN m.w IS NULL OR m.w = 0 THEN 1e9 ELSE ln((SELECT max(weight) FROM hist) / m.w) END', 'score')}
  FROM scores s LEFT JOIN (
    SELECT g.b, avg(coalesce(h.weight, 0)) AS w FROM
      (SELECT c.range AS b, n.range AS bin FROM range(-1, 21) c, range(0, 20) n
       WHERE abs(c.range - n.range) <= 1) g LEFT JOIN hist h ON h.bin = g.bin GROUP BY g.b) m
  ON m.b = floor(s.score / 2.5)"""))
def histogram_score(c):
    """Neighbourhoods of three bins; infinite scores are shown as 1e9."""
    scored = histogram.histogram_score(
        c.scores.select("row_no", F.col("score").alias("value")), "value", _hist(c), BINS, win=1)
    return scored.select("row_no", F.least("score", F.lit(1e9)).alias("score"))
