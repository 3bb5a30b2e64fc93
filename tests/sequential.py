"""Row-at-a-time models written from the specification; the operators must agree with them."""

import math
import random
import statistics

import numpy as np

COLUMNS = ("frame_no", "ts_ns", "src_ip", "dst_ip", "proto_l4", "src_port", "dst_port",
           "len_headers", "len_payload", "fragmented")
SCHEMA = ("frame_no long, ts_ns long, src_ip string, dst_ip string, proto_l4 int, src_port int, "
          "dst_port int, len_headers long, len_payload long, fragmented boolean")


def random_packets(seed, n=300, sources=4, window=1000, edges=0.3, gaps=0.1):
    """Time-sorted packets with gaps, ties and many packets exactly on window edges."""
    rng, t, out, start = random.Random(seed), 5_000, [], 5_000
    for i in range(n):
        if i:
            roll = rng.random()
            if roll < edges:
                t = start + math.ceil((t - start + 1) / window) * window
            elif roll < edges + gaps:
                t += rng.randrange(1, 8) * window + rng.randrange(0, 3) * 17
            elif roll > 0.9:
                pass
            else:
                t += rng.randrange(1, window // 4)
        proto = rng.choice([6, 6, 17, 1, 132])
        out.append((i, t, f"10.0.0.{rng.randrange(sources)}", f"192.168.0.{rng.randrange(3)}", proto,
                    0 if proto == 1 else rng.randrange(1024, 1030), 0 if proto == 1 else 80,
                    rng.choice([28, 40]), rng.randrange(0, 500), rng.random() < 0.1))
    return out


def run_windows(packets, window):
    """Closed windows in order: list of (cell start, packets of the window)."""
    origin = start = None
    done, current = [], []
    for p in packets:
        t = p[1]
        if start is None:
            origin = start = t
        elif t - start > window:
            done.append(((start - origin) // window, current))
            start += (t - start) // window * window
            current = []
        current.append(p)
    return origin, done, ((start - origin) // window, current)


def entropy(ports):
    n = len(ports)
    if n == 1:
        return 0.0
    freq = [ports.count(p) / n for p in set(ports)]
    return -sum(f * math.log2(f) for f in freq) / math.log2(n)


def window_row(packets):
    gaps = [0] + [b[1] - a[1] for a, b in zip(packets, packets[1:])]
    sizes = [p[7] + p[8] for p in packets]
    n = len(packets)
    std = (lambda v: statistics.stdev(v) if n > 1 else 0.0)
    return dict(
        pkts_total=n, bytes_total=sum(sizes), tstamp_start=packets[0][1], tstamp_end=packets[-1][1],
        pkt_arrivals_avg=sum(gaps) / n, pkt_arrivals_std=std(gaps), pkt_size_min=min(sizes),
        pkt_size_max=max(sizes), pkt_size_avg=sum(sizes) / n, pkt_size_std=std(sizes),
        tcp_pkt_count=sum(p[4] == 6 for p in packets), udp_pkt_count=sum(p[4] == 17 for p in packets),
        icmp_pkt_count=sum(p[4] == 1 for p in packets), port_src_unique=len({p[5] for p in packets}),
        port_src_entropy=entropy([p[5] for p in packets]),
        conn_pkts_avg=n / len({(p[5], p[3], p[6]) for p in packets}),
        pkts_frag_count=sum(p[9] for p in packets),
        hdrs_payload_ratio_avg=sum(p[7] / s for p, s in zip(packets, sizes) if s) / max(
            1, sum(s > 0 for s in sizes)))


def window_table(packets, window, least):
    _, done, _ = run_windows(packets, window)
    out = {}
    for number, (_, rows) in enumerate(done):
        for ip in {p[2] for p in rows}:
            mine = [p for p in rows if p[2] == ip]
            if len(mine) >= least:
                out[ip, number] = window_row(mine)
    return out


def chunks(history, h, timeout):
    """history: (id, start, end) in order -> list of runs of ids."""
    held, out = [], []
    for item in history:
        held.append(item)
        if len(held) < h:
            continue
        if timeout is None or item[2] - held[0][1] < timeout:
            out.append([i for i, _, _ in held])
            held = []
        else:
            held.pop(0)
    return out


def replay(packets, window, least, h, timeout, score, threshold):
    """Packet-at-a-time simulation of scoring and deny list."""
    origin = start = None
    number, current, history = 0, {}, {}
    loss, denied, stats, decisions, losses = {}, set(), {}, [], []
    for p in packets:
        ip, t = p[2], p[1]
        stats.setdefault(ip, dict(after=0, pos=0, neg=0, allowed=0, denied=0))
        stats[ip]["denied" if ip in denied else "allowed"] += 1
        decisions.append(ip in denied)
        if start is None:
            origin = start = t
        elif t - start > window:
            start += (t - start) // window * window
            for src, rows in current.items():
                if len(rows) < least:
                    continue
                held = history.setdefault(src, [])
                held.append(rows)
                if len(held) < h:
                    continue
                if held[-1][-1][1] - held[0][0][1] < timeout:
                    value = score([window_row(r) for r in history.pop(src)])
                    loss[src] = value
                    if value >= threshold:
                        denied.add(src)
                        stats[src]["pos"] += 1
                        if stats[src]["after"] == 0:
                            stats[src]["after"] = round((t - origin) / 1e9)
                    else:
                        stats[src]["neg"] += 1
                else:
                    held.pop(0)
            number, current = number + 1, {}
        current.setdefault(ip, []).append(p)
        losses.append(loss.get(ip, 0.0))
    return decisions, losses, stats


class Stream:
    def __init__(self):
        self.w, self.s, self.q, self.t, self.pairs = 1e-20, 0.0, 0.0, None, []

    def add(self, t, v, rate):
        if self.t is not None and t > self.t:
            f = 2 ** (-rate * (t - self.t))
            self.w, self.s, self.q = self.w * f, self.s * f, self.q * f
        self.t = t if self.t is None else max(t, self.t)
        self.w, self.s, self.q = self.w + 1, self.s + v, self.q + v * v

    @property
    def mean(self):
        return self.s / self.w

    @property
    def var(self):
        return abs(self.q / self.w - self.mean ** 2)


class Pair:
    def __init__(self, t):
        self.cf, self.w, self.t = 0.0, 1e-20, t
        self.points = ([], [])
        self.res = [0.0, 0.0]

    def guess(self, side, t):
        pts = self.points[side][-3:]
        if not pts:
            return 0.0
        if len(pts) == 1:
            return pts[-1][1]
        if len(pts) == 3 and (t - pts[-1][0]) / ((pts[0][0] - pts[1][0]) / 2 + 1e-10) > 10:
            return pts[-1][1]
        total = 0.0
        for i, (ti, vi) in enumerate(pts):
            y = 1.0
            for j, (tj, _) in enumerate(pts):
                if i != j:
                    y *= (t - tj) / (ti - tj + 1e-20)
            total += vi * y
        return total

    def update(self, side, t, v, me, peer, rate, residual):
        if t > self.t:
            f = 2 ** (-rate * (t - self.t))
            self.cf, self.w, self.t = self.cf * f, self.w * f, t
        mine = v - me.mean
        if residual == "last":
            self.cf += mine * self.res[1 - side]
            self.res[side] = mine
        else:
            self.points[side].append((t, v))
            self.cf += mine * (self.guess(1 - side, t) - peer.mean)
        self.w += 1


def pair_statistics(rows, rate, residual="extrapolated", double=True):
    """rows: (frame, src, dst, t, v) -> frame -> (mean, var, radius, magnitude, cov, pcc)."""
    streams, pairs, out = {}, {}, {}
    for f, a, b, t, v in rows:
        for s in (a, b):
            streams.setdefault(s, Stream())
        key = tuple(sorted((a, b)))
        me, peer = streams[a], streams[b]
        me.add(t, v, rate)
        for k, pair in pairs.items():
            if a in k and (double or k != key):
                other = k[1] if k[0] == a else k[0]
                pair.update(k.index(a), t, v, me, streams[other], rate, residual)
        pair = pairs.setdefault(key, Pair(t))
        pair.update(key.index(a), t, v, me, peer, rate, residual)
        cov, scale = pair.cf / pair.w, math.sqrt(me.var) * math.sqrt(peer.var)
        out[f] = (me.mean, me.var, math.sqrt(me.var + peer.var),
                  math.sqrt(me.mean ** 2 + peer.mean ** 2), cov, cov / scale if scale else 0.0)
    return out


def close(a, b, rel=1e-7, eps=1e-7):
    return (a is None and b is None) or np.isclose(a, b, rtol=rel, atol=eps)
