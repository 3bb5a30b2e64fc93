"""Window history of each source: readiness, greedy chunks, suffixes.

Input is a window table keyed ``(src_ip, window_id)``. Histories are cut into blocks of
``history_block`` window ids, so one group never holds more than that many windows even if
a source is active forever.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from floodlens.functions.blocks import running_sums
from floodlens.options import WindowOptions

_SRC = "src_ip"
_BLK = "_blk"


def history_rank(windows: DataFrame, opts: WindowOptions) -> DataFrame:
    """Add ``rank`` (1-based position of the window in the source's history)."""
    return running_sums(windows, [_SRC], "window_id", {"rank": F.lit(1)}, opts.history_block)


def _blocks(windows: DataFrame, opts: WindowOptions) -> DataFrame:
    """One row per (source, block): its windows in order, plus the h-1 windows before it.

    Every block holds at least one window, so the last h-1 blocks surely contain the
    h-1 preceding windows.
    """
    h = opts.history_min
    item = F.struct(F.col("window_id").alias("id"), F.col("tstamp_start").alias("s"),
                    F.col("tstamp_end").alias("e"))
    blocks = (windows.select(_SRC, "window_id", "tstamp_start", "tstamp_end")
              .withColumn(_BLK, F.expr(f"window_id div {opts.history_block}"))
              .groupBy(_SRC, _BLK).agg(F.sort_array(F.collect_list(item)).alias("ws")))
    ready = F.transform(F.sequence(F.lit(1), F.size("ws")), lambda i: _is_ready(i, opts))
    newest = f"slice({{0}}, greatest(1, size({{0}}) - {h - 2}), {h - 1})"
    tails = blocks.select(_SRC, _BLK, F.expr(newest.format("ws")).alias("tail"))
    back = Window.partitionBy(_SRC).orderBy(_BLK).rowsBetween(-(h - 1), -1)
    before = (tails.select(_SRC, _BLK, F.flatten(F.collect_list("tail").over(back)).alias("prev"))
              .withColumn("prev", F.expr(newest.format("prev"))))
    return (blocks.join(before, [_SRC, _BLK])
            .withColumn("seq", F.concat("prev", "ws"))
            .withColumn("ok", ready))


def _is_ready(i: Column, opts: WindowOptions) -> Column:
    at = F.size("prev") + i
    full = at >= opts.history_min
    if opts.timeout_ns is None:
        return full
    first = F.try_element_at(F.col("seq"), F.greatest(at - opts.history_min + 1, F.lit(1)))
    last = F.try_element_at(F.col("seq"), at)
    return full & (last["e"] - first["s"] < opts.timeout_ns)


def history_ready(windows: DataFrame, opts: WindowOptions) -> DataFrame:
    """Per window: do the last ``history_min`` windows of the source lie within the timeout?"""
    pairs = F.arrays_zip(F.col("ws.id").alias("id"), F.col("ok").alias("ok"))
    return (_blocks(windows, opts).select(_SRC, F.explode(pairs).alias("p"))
            .select(_SRC, F.col("p")["id"].alias("window_id"), F.col("p")["ok"].alias("ready")))


def ready_sources(windows: DataFrame, opts: WindowOptions) -> DataFrame:
    return history_ready(windows, opts).filter("ready").select(_SRC).distinct()


def _advance(h: int):
    """History length and emitted chunks after one more window.

    A full history is emitted and cleared when it is ready; otherwise its oldest window goes.
    """
    def step(acc, ok):
        full = acc["s"] + 1 >= h
        return F.struct(
            F.when(~full, acc["s"] + 1).when(ok, F.lit(0)).otherwise(F.lit(h - 1)).alias("s"),
            (acc["c"] + F.when(full & ok, F.lit(1)).otherwise(F.lit(0))).alias("c"))
    return step


def history_chunks(windows: DataFrame, opts: WindowOptions) -> DataFrame:
    """Assign windows to non-overlapping runs of ``history_min``: adds ``chunk_id``.

    The rule is sequential, but its state is only the history length (0..h-1). Each block
    is turned into a map from entry state to exit state; the maps of a source are chained (one
    small row per block), and every block is then replayed from its true entry state.
    """
    if opts.history_timeout is None:
        return _chunks_by_rank(windows, opts)
    h = opts.history_min
    blocks = _blocks(windows, opts)
    started = blocks.join(_entry_states(blocks, h), [_SRC, _BLK])
    ends = F.expr("cast(array() as array<struct<c:int,at:int>>)")
    step = _advance(h)

    def replay(acc, ok):
        nxt = step(acc, ok)
        done = nxt["c"] > acc["c"]
        at = acc["at"] + 1
        return F.struct(nxt["s"].alias("s"), nxt["c"].alias("c"), at.alias("at"),
                        F.when(done, F.array_append(acc["out"], F.struct(
                            acc["c"].alias("c"), at.alias("at"))))
                        .otherwise(acc["out"]).alias("out"))

    start = F.struct(F.col("_s").alias("s"), F.col("_c").alias("c"),
                     F.size("prev").alias("at"), ends.alias("out"))
    runs = started.select(_SRC, "seq", F.explode(F.aggregate("ok", start, replay,
                                                            lambda acc: acc["out"])).alias("r"))
    members = runs.select(
        _SRC, F.col("r")["c"].cast("long").alias("chunk_id"),
        F.explode(F.slice(F.col("seq.id"), F.col("r")["at"] - h + 1, h)).alias("window_id"))
    return windows.join(members, [_SRC, "window_id"])


def _entry_states(blocks: DataFrame, h: int) -> DataFrame:
    """History length and chunk count at the start of every block of a source."""
    zero = F.lit(0)
    exits = F.array(*[
        F.aggregate("ok", F.struct(F.lit(s).alias("s"), zero.alias("c")), _advance(h))
        for s in range(h)])
    maps = blocks.select(_SRC, _BLK, exits.alias("exits"))
    chained = maps.groupBy(_SRC).agg(
        F.sort_array(F.collect_list(F.struct(_BLK, "exits"))).alias("m"))
    typed = F.expr("cast(array() as array<struct<b:bigint,s:int,c:int>>)")

    def chain(acc, block):
        hit = F.element_at(block["exits"], acc["s"] + 1)
        return F.struct(hit["s"].alias("s"), (acc["c"] + hit["c"]).alias("c"),
                        F.array_append(acc["out"], F.struct(
                            block[_BLK].alias("b"), acc["s"].alias("s"),
                            acc["c"].alias("c"))).alias("out"))

    return (chained.select(_SRC, F.explode(F.aggregate(
        "m", F.struct(zero.alias("s"), zero.alias("c"), typed.alias("out")), chain,
        lambda acc: acc["out"])).alias("x"))
        .select(_SRC, F.col("x")["b"].alias(_BLK), F.col("x")["s"].alias("_s"),
                F.col("x")["c"].alias("_c")))


def _chunks_by_rank(windows: DataFrame, opts: WindowOptions) -> DataFrame:
    h = opts.history_min
    ranked = history_rank(windows, opts).withColumn("chunk_id", F.expr(f"(rank - 1) div {h}"))
    totals = windows.groupBy(_SRC).agg(F.count(F.lit(1)).alias("_n"))
    return (ranked.join(totals, _SRC).filter((F.col("chunk_id") + 1) * h <= F.col("_n"))
            .drop("_n", "rank"))


def last_rows(windows: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` windows per source (limited inside each task before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(_SRC).orderBy(F.desc("window_id")))
    return windows.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def valid_suffix(windows: DataFrame, now_ns: int, opts: WindowOptions) -> DataFrame:
    """Windows not expired at ``now_ns``, but at least the newest ``history_min``."""
    if opts.timeout_ns is None:
        return windows
    # starts ascend within a source, so the unexpired windows are a suffix
    fresh = F.lit(now_ns) - F.col("tstamp_start") < opts.timeout_ns
    return windows.filter(fresh).unionByName(last_rows(windows, opts.history_min).filter(~fresh))


def last_windows(windows: DataFrame, n: int, opts: WindowOptions) -> DataFrame:
    return last_rows(windows, max(n, opts.history_min))


def dump_windows(chunked: DataFrame) -> DataFrame:
    """Chunk rows as one ordered array per chunk, for sequence models (at most h windows)."""
    cols = [c for c in chunked.columns if c not in (_SRC, "chunk_id", "window_id")]
    return chunked.groupBy(_SRC, "chunk_id").agg(F.sort_array(F.collect_list(
        F.struct("window_id", *cols))).alias("windows"))


def expanding_history(windows: DataFrame, opts: WindowOptions, measures=None) -> DataFrame:
    """Keep-history variant: at every ready window, means over the history so far."""
    names = measures or ["pkts_total", "bytes_total", "pkt_size_avg"]
    sums = {"window_count": F.lit(1), **{f"_s_{n}": F.col(n) for n in names}}
    base = windows.select(_SRC, "window_id", "tstamp_end", *names)
    seen = running_sums(base, [_SRC], "window_id", sums, opts.history_block)
    ready = history_ready(windows, opts).filter("ready").select(_SRC, "window_id")
    return seen.join(ready, [_SRC, "window_id"]).select(
        _SRC, "window_id", "window_count",
        *[(F.col(f"_s_{n}") / F.col("window_count")).alias(f"{n}_mean") for n in names])
