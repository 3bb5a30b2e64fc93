"""Dataset preparation: labelling, filtering, merging, remapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def label_packets(packets: DataFrame, attackers: DataFrame, name: str = "label") -> DataFrame:
    """1 for packets of listed sources, else 0 (also for packets without a source)."""
    marks = attackers.select(F.col("src_ip").alias("_key"), F.lit(1).alias("_hit")).distinct()
    # packets without a source match nothing; spread them instead of sending all to one task
    spread = "frame_no" if "frame_no" in packets.columns else packets.columns[0]
    nobody = F.concat(F.lit("none:"), F.pmod(F.xxhash64(spread), F.lit(4096)))
    return (packets.withColumn("_key", F.coalesce("src_ip", nobody)).join(marks, "_key", "left")
            .withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_hit", "_key"))


def ignore_ips(packets: DataFrame, ignored: DataFrame) -> DataFrame:
    return packets.join(ignored.select("src_ip"), "src_ip", "left_anti")


def ip_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("src_ip").intersect(b.select("src_ip"))


def distinct_ips(packets: DataFrame) -> DataFrame:
    return ip_only(packets).select("src_ip").distinct()


def ip_only(packets: DataFrame) -> DataFrame:
    return packets.filter(F.col("src_ip").isNotNull())


class CountMismatch(ValueError):
    """Two files that must pair up line by line differ in length."""


def external_timestamps(packets: DataFrame, stamps: DataFrame) -> DataFrame:
    """Replace ``ts_ns`` by the external time of the same frame number."""
    if packets.count() != stamps.count():
        raise CountMismatch("timestamps and frames differ in number")
    new = stamps.select("frame_no", F.col("ts_ns_ext").alias("_ts"))
    return packets.join(new, "frame_no").withColumn("ts_ns", F.col("_ts")).drop("_ts")


def split_packets(packets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Keep packets of chosen sources, with the ``subset`` they belong to."""
    return packets.join(chosen.select("src_ip", "subset"), "src_ip")


def merge_captures(captures: list[DataFrame]) -> DataFrame:
    """Time-ordered union (range-partitioned sort); ties keep the order of the inputs."""
    tagged = [c.withColumn("source_no", F.lit(i)) for i, c in enumerate(captures)]
    merged = reduce(lambda a, b: a.unionByName(b), tagged)
    return merged.orderBy("ts_ns", "source_no", "frame_no")


def merge_classes(classes: list[tuple[DataFrame, int]]) -> DataFrame:
    parts = [df.withColumn("target", F.lit(target)) for df, target in classes]
    return reduce(lambda a, b: a.unionByName(b), parts)


def reorder(packets: DataFrame) -> DataFrame:
    return packets.orderBy("ts_ns", "frame_no")


def hosts(sources=(), destinations=(), exclude=False) -> Column:
    """Predicate on source or destination hosts."""
    cond = F.lit(False)
    if sources:
        cond = cond | F.col("src_ip").isin(*sources)
    if destinations:
        cond = cond | F.col("dst_ip").isin(*destinations)
    return ~cond if exclude else cond


def ipv4_number(name: str) -> Column:
    """Dotted IPv4 text as a number; null for anything else."""
    octets = F.split(F.col(name), r"\.")
    is_v4 = F.col(name).rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    value = sum((octets[i].cast("long") * (256 ** (3 - i)) for i in range(1, 4)),
                octets[0].cast("long") * 256 ** 3)
    return F.when(is_v4, value)


def in_network(name: str, cidr: str) -> Column:
    address, bits = cidr.split("/")
    size = 2 ** (32 - int(bits))
    base = sum(int(o) * 256 ** (3 - i) for i, o in enumerate(address.split(".")))
    number = ipv4_number(name)
    return F.coalesce(number.between(base - base % size, base - base % size + size - 1),
                      F.lit(False))


def time_slice(packets: DataFrame, start_ns: int | None = None,
               end_ns: int | None = None) -> DataFrame:
    """Packets with start <= time < end."""
    if start_ns is not None:
        packets = packets.filter(F.col("ts_ns") >= start_ns)
    if end_ns is not None:
        packets = packets.filter(F.col("ts_ns") < end_ns)
    return packets


def time_split(packets: DataFrame, at_ns: int) -> DataFrame:
    return packets.withColumn("part", F.when(F.col("ts_ns") < at_ns, 0).otherwise(1))


def time_shift(packets: DataFrame, offset_ns: int) -> DataFrame:
    return packets.withColumn("ts_ns", F.col("ts_ns") + F.lit(offset_ns).cast("long"))


def align_offset(moving: DataFrame, fixed: DataFrame) -> int:
    """Offset that makes ``moving`` begin when ``fixed`` begins (two scalars)."""
    first = [d.agg(F.min("ts_ns")).first()[0] for d in (fixed, moving)]
    return 0 if None in first else first[0] - first[1]


def ip_remap(packets: DataFrame, prefix: str, new_prefix: str, name: str = "src_ip") -> DataFrame:
    """Replace an octet prefix (``10.0.0``, or a whole host) and keep the host part."""
    col = F.col(name)
    if prefix.count(".") == 3:
        moved, hit = F.lit(new_prefix), col == prefix
    else:
        hit = col.startswith(prefix + ".")
        moved = F.concat(F.lit(new_prefix), F.substring(col, len(prefix) + 1, 1_000))
    return packets.withColumn(name, F.when(hit, moved).otherwise(col))
