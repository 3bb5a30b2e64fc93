"""Named queries over the given tables and the SQL that checks them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from floodlens.operators import features, mitigation, windows
from floodlens.options import WindowOptions
from floodlens.plans import views
from floodlens.session import cut

DAY_NS = 86_400_000_000_000
OPTIONS = WindowOptions(window_length=86_400, packets_min=2, history_min=6,
                        history_timeout=12 * 86_400, samples_size=40, threshold=230)
DIGITS = 6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_CONTEXTS: dict = {}


class Context:
    """Inputs of the queries on one data folder; shared parts are materialised once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.opts = spark, sf_dir, OPTIONS

    def table(self, name: str) -> DataFrame:
        return views.table(self.spark, self.sf_dir, name)

    @property
    def packets(self) -> DataFrame:
        return views.packets(self.spark, self.sf_dir)

    @property
    def frames(self) -> DataFrame:
        return views.frames(self.spark, self.sf_dir)

    @property
    def flows(self) -> DataFrame:
        return views.flows(self.spark, self.sf_dir)

    @property
    def scores(self) -> DataFrame:
        return views.scores(self.spark, self.sf_dir)

    @property
    def attackers(self) -> DataFrame:
        return views.attackers(self.spark, self.sf_dir)

    @cached_property
    def calendar(self) -> windows.Calendar:
        return windows.build_calendar(self.packets, self.opts)

    @cached_property
    def _last(self):
        return self.packets.agg(F.max("frame_no"), F.max("ts_ns")).first()

    @property
    def last_frame(self) -> int:
        return self._last[0]

    @property
    def last_ts(self) -> int:
        return self._last[1]

    @cached_property
    def windows(self) -> DataFrame:
        return cut(windows.window_stats(self.packets, self.opts, self.calendar))

    @property
    def closed(self) -> DataFrame:
        return windows.closed_windows(self.packets, self.opts, self.calendar)

    @cached_property
    def chunked(self) -> DataFrame:
        from floodlens.operators.history import history_chunks

        return cut(history_chunks(self.windows, self.opts))

    @cached_property
    def features(self) -> DataFrame:
        return cut(features.summarise(self.chunked, self.opts))

    @cached_property
    def predictions(self) -> DataFrame:
        scored = self.features.withColumn("loss", F.col("pkt_size_std_std"))
        return cut(mitigation.predictions(scored, self.calendar, self.opts.threshold))

    @cached_property
    def ip_stats(self) -> DataFrame:
        return cut(mitigation.label_sources(
            mitigation.ip_stats(self.packets, self.predictions), self.attackers))


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir)
    return _CONTEXTS.setdefault(key, Context(spark, sf_dir))


def forget() -> None:
    """Drop materialised intermediates, so that the next run starts from the tables."""
    _CONTEXTS.clear()


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles for comparison; nanosecond means become shares of a window first."""
    cols = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if field.dataType.simpleString() in ("double", "float"):
            if field.name.startswith("pkt_arrivals_"):
                col = F.round(col / float(DAY_NS), DIGITS + 3)
            else:
                col = F.round(col.cast("double"), DIGITS)
            col = F.when(col == 0, F.lit(0.0)).otherwise(col)
        cols.append(col.alias(field.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register ``fn(context) -> DataFrame`` with its oracle."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(context(spark, sf_dir)))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
