"""Streams whose state is a table with one version per micro-batch.

A micro-batch is handled by batch operators, so one key's rows are spread over tasks; what earlier batches left is read
from the version of the batch before, and the batch writes its own version. A repeated batch overwrites its version and
gives the same. State is on shared storage, not in the memory of executors, and no row passes through Python.

Micro-batches must follow the order of arrival, ``frame_no``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from floodlens.functions.blocks import attach, running_max
from floodlens.operators.damped import block_prefixes
from floodlens.operators.features import summarise
from floodlens.operators.history import history_chunks, last_rows
from floodlens.operators.mitigation import decide
from floodlens.options import WindowOptions
from floodlens.schemas import WINDOW_STATS
from floodlens.streaming.run import begin
from floodlens.streaming.windows import finished

#: Frames of a micro-batch that one task orders.
BLOCK_ROWS = 1 << 16
_WINDOW = ["src_ip", "cell"]


class Versions:
    """A state table; version N is what micro-batch N left behind."""

    def __init__(self, path: str, schema):
        self.path, self.schema = path.rstrip("/"), schema

    def _folder(self, batch_id: int) -> str:
        return f"{self.path}/batch={batch_id}"

    def at(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self._folder(batch_id))

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return self.at(spark, batch_id - 1) if batch_id else spark.createDataFrame([], self.schema)

    def keep(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Write a version, drop the one that no repeated batch can ask for; the version, read back."""
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(self._folder(batch_id))
        jvm = spark.sparkContext._jvm
        old = jvm.org.apache.hadoop.fs.Path(self._folder(batch_id - 2))
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        return self.at(spark, batch_id)


def _empty(stream: DataFrame) -> DataFrame:
    return stream.sparkSession.createDataFrame([], stream.schema)


def in_order_of_arrival(packets: DataFrame, newest: int | None, opts: WindowOptions, origin_ns: int,
                        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``open_ns``, the newest time so far, and ``cell``, the grid number of the window open then.

    A late packet thus belongs to the window that is open when it comes. ``newest`` is the newest time of earlier batches.
    """
    rows = running_max(packets, [], "frame_no", F.col("ts_ns"), "open_ns", block_rows)
    rows = rows.withColumn("open_ns", F.greatest("open_ns", F.lit(newest).cast("long")))
    return rows.withColumn("cell", F.expr(f"(open_ns - {origin_ns}) div {opts.window_ns}"))


class OpenWindows:
    """Window statistics by order of arrival; late packets are counted, none is dropped.

    The state has one row per source of the open window: sums, extremes, the first and last packet, the sum of squared
    gaps in order of arrival, two sketches and at most ``samples_size`` sampled ports.
    """

    def __init__(self, packets: DataFrame, opts: WindowOptions, path: str, origin_ns: int = 0, seed: int = 7,
                 block_rows: int = BLOCK_ROWS):
        self.opts, self.origin, self.seed, self.block_rows = opts, origin_ns, seed, block_rows
        empty = in_order_of_arrival(_empty(packets), None, opts, origin_ns, block_rows)
        self.state = Versions(path, self._merged(self._blocks(empty)).schema)

    def _measures(self) -> dict[str, tuple]:
        """name -> (aggregate over the packets of a block, merge over blocks)."""
        size = F.col("len_headers") + F.col("len_payload")
        ratio = F.when(size != 0, F.col("len_headers") / size)
        conn = F.concat_ws("|", F.col("src_port").cast("string"), "dst_ip", F.col("dst_port").cast("string"))
        stamp = F.struct("frame_no", "ts_ns")
        own = F.expr(f"floor((ts_ns - {self.origin}) / {float(self.opts.window_ns)}D)")
        return {
            "pkts_total": (F.count(F.lit(1)), F.sum), "bytes_total": (F.sum(size), F.sum),
            "pkt_size_min": (F.min(size), F.min), "pkt_size_max": (F.max(size), F.max),
            "squares": (F.sum((size * size).cast("double")), F.sum),
            "tcp_pkt_count": (F.count_if(F.col("proto_l4") == 6), F.sum),
            "udp_pkt_count": (F.count_if(F.col("proto_l4") == 17), F.sum),
            "icmp_pkt_count": (F.count_if(F.col("proto_l4") == 1), F.sum),
            "pkts_frag_count": (F.count_if("fragmented"), F.sum), "ratio": (F.sum(ratio), F.sum),
            "ratio_n": (F.count(ratio), F.sum), "late": (F.count_if(own < F.col("cell")), F.sum),
            "tstamp_start": (F.min("ts_ns"), F.min), "tstamp_end": (F.max("ts_ns"), F.max),
            "open_ns": (F.max("open_ns"), F.max), "first": (F.min(stamp), F.min), "last": (F.max(stamp), F.max),
            "gap_sq": (F.sum(F.col("_gap") * F.col("_gap")), F.sum),
            "ports": (F.hll_sketch_agg(F.col("src_port").cast("long"), 9), F.hll_union_agg),
            "conns": (F.hll_sketch_agg(conn, 9), F.hll_union_agg),
        }

    def _blocks(self, rows: DataFrame) -> DataFrame:
        block = Window.partitionBy(*_WINDOW, "_blk")
        ticket = F.md5(F.concat(F.col("frame_no").cast("string"), F.lit(f":{self.seed}")))
        gap = F.col("ts_ns") - F.lag("ts_ns").over(block.orderBy("frame_no"))
        rows = (rows.withColumn("_blk", F.expr(f"frame_no div {self.block_rows}")).withColumn("_k", ticket)
                .withColumn("_gap", F.coalesce(gap, F.lit(0)).cast("double"))
                .withColumn("_rank", F.row_number().over(block.orderBy("_k", "frame_no"))))
        drawn = F.when(F.col("_rank") <= self.opts.samples_size, F.struct(F.col("_k").alias("k"), "src_port"))
        return rows.groupBy(*_WINDOW, "_blk").agg(*[a.alias(n) for n, (a, _) in self._measures().items()],
                                                  F.collect_list(drawn).alias("sample"))

    def _merged(self, blocks: DataFrame) -> DataFrame:
        gap = F.col("first.ts_ns") - F.lag("last.ts_ns").over(Window.partitionBy(*_WINDOW).orderBy("_blk"))
        blocks = blocks.withColumn("_gap", F.coalesce(gap, F.lit(0)).cast("double"))
        blocks = blocks.withColumn("gap_sq", F.col("gap_sq") + F.col("_gap") * F.col("_gap"))
        sample = F.slice(F.sort_array(F.flatten(F.collect_list("sample"))), 1, self.opts.samples_size)
        return blocks.groupBy(*_WINDOW).agg(*[m(n).alias(n) for n, (_, m) in self._measures().items()],
                                            sample.alias("sample"))

    def closed_by(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, int | None]:
        """The windows that the batch closes, with ``late``; and the number up to which all windows are closed."""
        spark, w = batch.sparkSession, self.opts.window_ns
        state = self.state.before(spark, batch_id)
        newest = state.agg(F.max("open_ns")).first()[0]
        blocks = self._blocks(in_order_of_arrival(batch, newest, self.opts, self.origin, self.block_rows))
        if newest is not None:
            still_open = state.filter(F.col("cell") >= (newest - self.origin) // w)
            blocks = blocks.unionByName(still_open.withColumn("_blk", F.lit(-1).cast("long")))
        # the version also holds what this batch closes: all is computed once
        table = self.state.keep(self._merged(blocks), batch_id)
        top = table.agg(F.max("cell")).first()[0]
        closed = finished(table.filter(F.col("cell") < F.lit(top)), F.col("cell"), extra=("late",),
                          span=F.col("last.ts_ns") - F.col("first.ts_ns"))
        return closed, None if top is None else top - 1


class OpenHistories:
    """Windows of a source gathered into runs of ``history_min``, across micro-batches.

    The state is the windows of a source after its last run, at most ``history_min - 1``. Those that are older than the
    timeout when the newest window ends can be in no run and go; ``late_ns`` says how late packets may come.
    A source's windows must come in order of their numbers.
    """

    def __init__(self, windows_schema, opts: WindowOptions, path: str, late_ns: int = 0):
        self.opts, self.late_ns = opts, late_ns
        kinds = {f.name: f.dataType.simpleString() for f in windows_schema.fields}
        self.names = ["src_ip", *WINDOW_STATS]
        self.state = Versions(path, ", ".join(f"{n} {kinds[n]}" for n in self.names) + ", chunk_id long")

    def open_before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        table = self.state.before(spark, batch_id)
        ended = table.filter("chunk_id IS NOT NULL").groupBy("src_ip").agg(F.max("chunk_id").alias("_ended"))
        left = last_rows(table.filter("chunk_id IS NULL"), self.opts.history_min - 1)
        left = left.join(ended, "src_ip", "left").filter(F.col("window_id") > F.coalesce("_ended", F.lit(-1 << 62)))
        timeout = self.opts.timeout_ns
        if timeout is not None:
            newest = table.agg(F.max("tstamp_end")).first()[0]
            left = left.filter(F.lit(newest) - F.col("tstamp_start") < timeout + self.late_ns)
        return left.select(*self.names)

    def chunks_of(self, closed: DataFrame, batch_id: int) -> DataFrame:
        """Windows of the runs that are complete with this batch; ``chunk_id`` is the number of a run's last window."""
        rows = closed.select(*self.names).unionByName(self.open_before(closed.sparkSession, batch_id))
        runs = history_chunks(rows.select("src_ip", "window_id", "tstamp_start", "tstamp_end"), self.opts)
        last = F.max("window_id").over(Window.partitionBy("src_ip", "chunk_id"))
        runs = runs.select("src_ip", "window_id", last.cast("long").alias("chunk_id"))
        table = self.state.keep(rows.join(runs, ["src_ip", "window_id"], "left").select(*self.names, "chunk_id"), batch_id)
        return table.filter("chunk_id IS NOT NULL")


class DampedState:
    """Damped weight, mean and variance after each row of a stream, at several rates.

    Earlier batches enter as one more row for each key, which brings the moments they left; a key's rows are summed in blocks.
    The state of a key goes once its weight has decayed below ``cutoff`` at every rate. A late row causes no decay.
    """

    def __init__(self, rows: DataFrame, key: str, value: str, rates, path: str, *, unit_ns: int = 10 ** 9,
                 origin_ns: int = 0, cutoff: float = 1e-9, block_rows: int = BLOCK_ROWS):
        self.key, self.value, self.rates, self.cutoff = key, value, [float(r) for r in rates], cutoff
        self.unit, self.origin, self.block_rows = unit_ns, origin_ns, block_rows
        kind = dict(rows.dtypes)[key]
        moments = ", ".join(f"{n} array<double>" for n in "wsq")
        self.state = Versions(path, f"{key} {kind}, frame_no long, t double, {moments}, is_last boolean, is_old boolean")

    def _rows(self, batch: DataFrame, batch_id: int) -> DataFrame:
        v, one = F.col(self.value).cast("double"), F.lit(1.0)
        time = (F.col("ts_ns") - self.origin) / F.lit(float(self.unit))
        fresh = batch.select(self.key, "frame_no", time.alias("t"), *[
            F.array(*[c] * len(self.rates)).alias(n) for n, c in (("w", one), ("s", v), ("q", v * v))])
        table = self.state.before(batch.sparkSession, batch_id)
        left = table.filter("is_last")
        if batch_id:
            newest = F.lit(table.agg(F.max("t")).first()[0])
            alive = [F.col("w")[i] * F.pow(F.lit(2.0), (F.col("t") - newest) * r) >= self.cutoff
                     for i, r in enumerate(self.rates)]
            left = left.filter(reduce(or_, alive))
        return (fresh.withColumn("is_old", F.lit(False))
                .unionByName(left.drop("is_last").withColumn("is_old", F.lit(True))))

    def after(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """One row per row of the batch and rate."""
        key = self.key
        rows = self._rows(batch, batch_id)
        rows = running_max(rows, [key], "frame_no", F.col("t"), "t", self.block_rows)
        sums = {n: (lambda i, n=n: F.col(n)[i], 0) for n in "wsq"}
        rows, blocks = block_prefixes(rows, [key], "frame_no", "t", sums, self.rates, self.block_rows)
        groups = [key, "_blk", "_span"]
        newest = Window.partitionBy(key).orderBy(F.desc("_blk"), F.desc("_span"))
        blocks = blocks.withColumn("_ends", F.row_number().over(newest) == 1)
        rows = attach(rows, blocks.select(*groups, "c_w0", "c_s0", "c_q0", "_ends"), groups)
        y = F.col("t") - F.col("_tau")

        def faded(n: str) -> Column:
            return F.array(*[(F.col(f"{n}0")[i] + F.col(f"c_{n}0")[i]) * F.pow(F.lit(2.0), y * -r)
                             for i, r in enumerate(self.rates)])
        in_block = Window.partitionBy(*groups).orderBy(F.desc("frame_no"))
        is_last = F.col("_ends") & (F.row_number().over(in_block) == 1)
        table = rows.select(key, "frame_no", "t", *[faded(n).alias(n) for n in "wsq"], is_last.alias("is_last"), "is_old")
        kept = self.state.keep(table, batch_id)
        mean = F.col("m.s") / F.col("m.w")
        return (kept.filter("NOT is_old")
                .select(key, "frame_no", F.explode(F.arrays_zip(
                    F.array(*[F.lit(r) for r in self.rates]).alias("rate"), "w", "s", "q")).alias("m"))
                .select(key, F.col("m.rate").alias("rate"), "frame_no", F.col("m.w").alias("weight"), mean.alias("mean"),
                        F.abs(F.col("m.q") / F.col("m.w") - mean * mean).alias("var")))


def run_steps(stream: DataFrame, step, path: str, checkpoint: str, partitions: int | None = None) -> None:
    """Handle what is available: ``step(batch, batch_id)`` gives the rows that a micro-batch adds to the table at ``path``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    begin(stream.writeStream.foreachBatch(write), checkpoint, stream.sparkSession, partitions).awaitTermination()


# ---------------------------------------------------------------- deny list by progress

_DENY = "src_ip string, denied_window long"
_DONE = "through long"


class DenyList:
    """Deny rows of the scoring stream, and how far it has come.

    A row of ``progress`` is written after its batch's deny rows: all windows up to ``through`` are scored. A packet of
    window w is judged once w - 1 is scored, with the rows known by then, so that the result does not depend on
    which of the two streams is faster.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        # empty parts, so that the tables exist from the start
        for name, row, schema in (("deny", [], _DENY), ("progress", [(-1,)], _DONE)):
            spark.createDataFrame(row, schema).coalesce(1).write.mode("ignore").parquet(f"{self.path}/{name}/batch=-1")

    def progress(self) -> tuple[int, int]:
        """The newest batch that is committed, and the window through which all are scored."""
        done = self.spark.read.schema(f"{_DONE}, batch int").parquet(f"{self.path}/progress")
        return tuple(done.agg(F.max("batch"), F.max("through")).first())

    def known(self, batch_id: int) -> DataFrame:
        rows = self.spark.read.schema(f"{_DENY}, batch int").parquet(f"{self.path}/deny")
        return (rows.filter(F.col("batch") <= batch_id).groupBy("src_ip")
                .agg(F.min("denied_window").alias("denied_window")))

    def commit(self, hits: DataFrame, through: int | None, batch_id: int) -> None:
        before, seen = self.progress()
        if before >= batch_id:
            return  # a repeated batch: others may be reading its rows
        hits.write.mode("overwrite").parquet(f"{self.path}/deny/batch={batch_id}")
        row = [(seen if through is None else through,)]
        (self.spark.createDataFrame(row, _DONE).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/progress/batch={batch_id}"))

    def judge(self, packets: DataFrame) -> DataFrame:
        """Adds ``denied`` to packets with ``cell``; null: not to be judged yet."""
        batch_id, through = self.progress()
        denied = F.coalesce(F.col("cell") >= F.col("denied_window"), F.lit(False))
        return (packets.join(self.known(batch_id), "src_ip", "left")
                .withColumn("denied", F.when(F.col("cell") <= through + 1, denied)).drop("denied_window"))


def start_scoring(packets: DataFrame, opts: WindowOptions, score, deny: DenyList, path: str, checkpoint: str,
                  origin_ns: int, late_ns: int = 0, partitions: int | None = None):
    """Starts the stream that scores runs of windows and fills the deny list; ``score`` adds ``loss`` to feature rows."""
    windows = OpenWindows(packets, opts, f"{path}/windows", origin_ns)
    schema = finished(windows.state.before(packets.sparkSession, 0), F.col("cell")).schema
    histories = OpenHistories(schema, opts, f"{path}/histories", late_ns)

    def step(batch: DataFrame, batch_id: int) -> None:
        closed, through = windows.closed_by(batch, batch_id)
        chunks = histories.chunks_of(closed.filter(F.col("pkts_total") >= opts.packets_min), batch_id)
        hits = decide(score(summarise(chunks, opts)), opts.threshold).filter("is_attack = 1")
        hits = hits.groupBy("src_ip").agg((F.min("last_window_id") + 1).alias("denied_window"))
        deny.commit(hits, through, batch_id)
    return begin(packets.writeStream.foreachBatch(step), checkpoint, packets.sparkSession, partitions)


class Marking:
    """Marks packets by the deny list; those of windows whose predecessor is not scored wait in the state."""

    def __init__(self, packets: DataFrame, opts: WindowOptions, deny: DenyList, path: str, origin_ns: int):
        self.packets, self.opts, self.deny, self.origin = packets, opts, deny, origin_ns
        self.out = f"{path}/out"
        self.state = Versions(f"{path}/waiting", "frame_no long, src_ip string, open_ns long, cell long, denied boolean")

    def start(self, checkpoint: str, partitions: int | None = None):
        def step(batch: DataFrame, batch_id: int) -> None:
            table = self.state.before(batch.sparkSession, batch_id)
            newest = table.agg(F.max("open_ns")).first()[0]
            fresh = in_order_of_arrival(batch.select("frame_no", "src_ip", "ts_ns"), newest, self.opts, self.origin)
            waiting = table.filter("denied IS NULL").drop("denied")
            both = fresh.select(*waiting.columns).unionByName(waiting)
            self._write(self.state.keep(self.deny.judge(both).select(*table.columns), batch_id), batch_id)
        return begin(self.packets.writeStream.foreachBatch(step), checkpoint, self.packets.sparkSession, partitions)

    def settle(self) -> None:
        """Judge what still waits when both streams have ended for good: no later run of windows can come."""
        spark = self.packets.sparkSession
        versions = spark.read.option("basePath", self.state.path).schema(
            f"{self.state.schema}, batch int").parquet(self.state.path)
        last = versions.agg(F.max("batch")).first()[0]
        waiting = self.state.at(spark, last).filter("denied IS NULL").drop("denied")
        known = self.deny.known(self.deny.progress()[0])
        denied = F.coalesce(F.col("cell") >= F.col("denied_window"), F.lit(False))
        self._write(waiting.join(known, "src_ip", "left").withColumn("denied", denied), -1)

    def _write(self, rows: DataFrame, batch_id: int) -> None:
        rows = rows.filter("denied IS NOT NULL").select("frame_no", "src_ip", "denied")
        rows.write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")
