"""Packet capture files as tables of header fields, whatever the size of the files.

``capture_index`` walks over the record headers of each file once and notes where stretches of some megabytes begin, and
what a reader must know there. ``read_captures`` stores that index and decodes its stretches in as many tasks as there are;
the headers of all frames of a stretch are taken from its bytes at once. Compressed files have no places to begin at, so each
is one stretch. The data source ``captures`` reads file by file.

Only header fields are decoded here; lengths and flags are derived by Spark expressions in
``packets``. Supported: .pcap, .pcap.gz, .pcapng.
"""

from __future__ import annotations

import gzip
import ipaddress
import json
import struct
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from floodlens.session import cut

SUFFIXES = (".pcap", ".pcap.gz", ".pcapng")
FILE_FRAMES = 1 << 32  # frame numbers reserved per file
BATCH = 8_192
#: Bytes of a stretch of a capture file.
STRETCH = 32 << 20
INDEX = "file string, file_no long, first long, begin long, finish long, state string"

HEADERS = (
    "file string, frame_no long, ts_ns long, ip_version int, src_ip string, dst_ip string, "
    "ihl int, ip_len int, l3_len int, frag_offset int, ip_flags int, v6_plen int, "
    "v6_fragment boolean, l4 int, l4_len int, src_port int, dst_port int, data_offset int, "
    "udp_len int, icmp6_type int, corrupt boolean")
RAW = ", raw binary"


class CaptureError(ValueError):
    """Not a capture file, or an unknown extension."""


# Fixed values of the file formats, link layers and protocols.
PCAP_MAGIC = {0xA1B2C3D4: 1_000, 0xA1B23C4D: 1}  # magic -> nanoseconds per fraction unit
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
BYTE_ORDER = 0x1A2B3C4D
ETHERNET, NULL_LOOPBACK, COOKED, RAW_LINKS = 1, 0, 113, (12, 14, 101, 228, 229)
VLAN_TAGS = (0x8100, 0x88A8)
IPV4, IPV6 = 0x0800, 0x86DD
ICMP, TCP, UDP, ICMP6, SCTP = 1, 6, 17, 58, 132
V6_OPTIONS, V6_FRAGMENT, V6_AUTH = (0, 43, 60), 44, 51
L4_MINIMUM = {ICMP: 8, TCP: 20, UDP: 8, ICMP6: 8, SCTP: 12}


def local_name(path: str) -> str:
    return path[len("file:"):].replace("//", "/", 1) if path.startswith("file:") else path


def filesystem(path: str):
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), local_name(path)


def list_captures(path: str) -> list[str]:
    from pyarrow import fs

    system, root = filesystem(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.Directory:
        depth = len(PurePosixPath(root).parts)
        names = [i.path for i in system.get_file_info(fs.FileSelector(root, recursive=True))
                 if i.type == fs.FileType.File
                 and not any(part.startswith((".", "_")) for part in PurePosixPath(i.path).parts[depth:])]
    else:
        names = [root]
    for name in names:
        if not name.endswith(SUFFIXES):
            raise CaptureError(f"{name}: expected one of {', '.join(SUFFIXES)}")
    return sorted(names)


def _read(handle, size: int) -> bytes:
    data = handle.read(size)
    return data if len(data) == size else b""


def _pcap_frames(handle, head: bytes):
    for order in "<>":
        unit = PCAP_MAGIC.get(struct.unpack(order + "I", head)[0])
        if unit:
            break
    else:
        raise CaptureError("unknown capture format")
    rest = _read(handle, 20)
    if not rest:
        return
    link = struct.unpack(order + "I", rest[16:])[0] & 0xFFFF
    while record := _read(handle, 16):
        seconds, fraction, size, _ = struct.unpack(order + "4I", record)
        data = handle.read(size)
        yield seconds * 10 ** 9 + fraction * unit, link, data


def _ng_options(body: bytes, order: str):
    at = 0
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "2H", body, at)
        if code == 0:
            return
        yield code, body[at + 4:at + 4 + size]
        at += 4 + size + (-size) % 4


def _pcapng_frames(handle, head: bytes):
    order, links, kind = "<", [], head
    while kind:
        size_bytes = _read(handle, 4)
        if not size_bytes:
            return
        if struct.unpack("<I", kind)[0] == SECTION:
            magic = _read(handle, 4)
            order = "<" if magic == struct.pack("<I", BYTE_ORDER) else ">"
            links = []
            handle.read(struct.unpack(order + "I", size_bytes)[0] - 12)
        else:
            block = struct.unpack(order + "I", kind)[0]
            body = handle.read(struct.unpack(order + "I", size_bytes)[0] - 12)
            handle.read(4)
            if block == INTERFACE:
                per_second = 10 ** 6
                for code, value in _ng_options(body[8:], order):
                    if code == 9 and value:
                        per_second = 2 ** (value[0] & 127) if value[0] & 128 else 10 ** value[0]
                links.append((struct.unpack_from(order + "H", body)[0], per_second))
            elif block == ENHANCED:
                number, high, low, size = struct.unpack_from(order + "4I", body)
                link, per_second = links[number]
                yield ((high << 32) | low) * 10 ** 9 // per_second, link, body[20:20 + size]
            elif block == SIMPLE:
                yield 0, links[0][0], body[4:]
        kind = _read(handle, 4)


def read_frames(path: str):
    """Yield ``(ts_ns, link type, bytes)`` of one capture file."""
    system, name = filesystem(path)
    with system.open_input_stream(name, compression=None) as raw:
        handle = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw
        head = _read(handle, 4)
        if not head:
            return
        is_ng = struct.unpack("<I", head)[0] == SECTION
        yield from (_pcapng_frames if is_ng else _pcap_frames)(handle, head)


def _network_layer(link: int, data: bytes):
    """Offset and type of the network layer."""
    if link in RAW_LINKS:
        return 0, {4: IPV4, 6: IPV6}.get(data[0] >> 4) if data else None
    if link == NULL_LOOPBACK:
        return 4, {4: IPV4, 6: IPV6}.get(data[4] >> 4) if len(data) > 4 else None
    at = {ETHERNET: 12, COOKED: 14}.get(link)
    if at is None or len(data) < at + 2:
        return 0, None
    kind = int.from_bytes(data[at:at + 2], "big")
    while kind in VLAN_TAGS and len(data) >= at + 6:
        at += 4
        kind = int.from_bytes(data[at:at + 2], "big")
    return at + 2, kind


def decode_headers(link: int, data: bytes) -> dict:
    """Header fields of one frame; empty when it is not IP."""
    at, kind = _network_layer(link, data)
    if kind not in (IPV4, IPV6):
        return {}
    ip = data[at:]
    out = {"ip_version": 4 if kind == IPV4 else 6, "l3_len": len(ip), "corrupt": False}
    try:
        if kind == IPV4:
            if len(ip) < 20:
                return {**out, "corrupt": True}
            flags = int.from_bytes(ip[6:8], "big")
            out.update(ihl=ip[0] & 15, ip_len=int.from_bytes(ip[2:4], "big"), ip_flags=flags >> 13,
                       frag_offset=flags & 0x1FFF, src_ip=str(ipaddress.IPv4Address(ip[12:16])),
                       dst_ip=str(ipaddress.IPv4Address(ip[16:20])))
            proto, start = ip[9], out["ihl"] * 4
            first = out["frag_offset"] == 0
        else:
            if len(ip) < 40:
                return {**out, "corrupt": True}
            out.update(v6_plen=int.from_bytes(ip[4:6], "big"), v6_fragment=False,
                       src_ip=str(ipaddress.IPv6Address(ip[8:24])),
                       dst_ip=str(ipaddress.IPv6Address(ip[24:40])))
            proto, start, first = ip[6], 40, True
            while proto in V6_OPTIONS or proto in (V6_FRAGMENT, V6_AUTH):
                step = (ip[start + 1] + 1) * 8
                if proto == V6_FRAGMENT:
                    out["v6_fragment"], step = True, 8
                    first = int.from_bytes(ip[start + 2:start + 4], "big") >> 3 == 0
                elif proto == V6_AUTH:
                    step = (ip[start + 1] + 2) * 4
                proto, start = ip[start], start + step
        part = ip[start:]
        if first and proto in L4_MINIMUM:
            if len(part) < L4_MINIMUM[proto]:
                return {**out, "corrupt": True}
            out.update(l4=proto, l4_len=len(part))
            if proto in (TCP, UDP, SCTP):
                out.update(src_port=int.from_bytes(part[:2], "big"),
                           dst_port=int.from_bytes(part[2:4], "big"))
            if proto == TCP:
                out["data_offset"] = part[12] >> 4
            elif proto == UDP:
                out["udp_len"] = int.from_bytes(part[4:6], "big")
            elif proto == ICMP6:
                out["icmp6_type"] = part[0]
    except IndexError:
        out["corrupt"] = True
    return out


def decode_frames(data: np.ndarray, start: np.ndarray, size: np.ndarray, link: np.ndarray) -> dict[str, pa.Array]:
    """Header columns of frames that lie in one buffer, as ``decode_headers`` gives them one by one.

    IPv4 over Ethernet, tagged or not, or bare, is read from the buffer for all frames at once; the others take the plain way.
    """
    n = len(start)
    data = np.concatenate([data, np.zeros(128, np.uint8)])  # what is read beyond the end is masked below

    def byte(at):
        return data[np.minimum(at, len(data) - 1)].astype(np.int64)

    def word(at):
        return byte(at) << 8 | byte(at + 1)
    raw = np.isin(link, RAW_LINKS)
    at = np.where(raw, 0, 14)
    kind = np.where(raw, np.where(byte(start) >> 4 == 4, IPV4, 0), word(start + 12))
    tagged = ~raw & np.isin(kind, VLAN_TAGS) & (size >= 18)
    at, kind = np.where(tagged, 18, at), np.where(tagged, word(start + 16), kind)
    plain = (raw | (link == ETHERNET)) & (kind == IPV4) & (size >= np.maximum(at, 1))
    ip, length = start + at, size - at
    ok = plain & (length >= 20)
    v = {"ip_version": np.full(n, 4), "l3_len": length, "ihl": byte(ip) & 15, "ip_len": word(ip + 2),
         "ip_flags": byte(ip + 6) >> 5, "frag_offset": word(ip + 6) & 0x1FFF}
    known = {"ip_version": plain, "l3_len": plain, **{c: ok for c in ("ihl", "ip_len", "ip_flags", "frag_offset")}}
    proto = byte(ip + 9)
    head = v["ihl"] * 4
    rest = np.maximum(0, length - head)
    least = np.zeros(256, np.int64)
    least[list(L4_MINIMUM)] = list(L4_MINIMUM.values())
    least = least[proto]
    carried = ok & (v["frag_offset"] == 0) & (least > 0)
    whole = carried & (rest >= least)
    l4 = ip + head
    ports = whole & np.isin(proto, (TCP, UDP, SCTP))
    v |= {"l4": proto, "l4_len": rest, "src_port": word(l4), "dst_port": word(l4 + 2), "data_offset": byte(l4 + 12) >> 4,
          "udp_len": word(l4 + 4), "icmp6_type": byte(l4), "v6_plen": proto}
    known |= {"l4": whole, "l4_len": whole, "src_port": ports, "dst_port": ports, "data_offset": whole & (proto == TCP),
              "udp_len": whole & (proto == UDP), "icmp6_type": whole & (proto == ICMP6), "v6_plen": np.zeros(n, bool)}
    v, known = ({c: x.copy() for c, x in d.items()} for d in (v, known))  # the plain way below writes into single columns
    flags = {"corrupt": np.where(plain, (length < 20) | (carried & ~whole), False), "v6_fragment": np.zeros(n, bool)}
    set_flags = {"corrupt": plain.copy(), "v6_fragment": np.zeros(n, bool)}
    names = {}
    for column, place in (("src_ip", 12), ("dst_ip", 16)):
        found, which = np.unique(word(ip + place) << 16 | word(ip + place + 2), return_inverse=True)
        texts = np.array([str(ipaddress.IPv4Address(int(x))) for x in found], object)
        names[column] = np.where(ok, texts[which] if n else "", None)
    for i in np.nonzero(~plain)[0].tolist():
        for name, value in decode_headers(int(link[i]), data[start[i]:start[i] + size[i]].tobytes()).items():
            if name in names:
                names[name][i] = value
            elif name in flags:
                flags[name][i], set_flags[name][i] = value, True
            else:
                v[name][i], known[name][i] = value, True
    return ({c: pa.array(x, pa.string()) for c, x in names.items()}
            | {c: pa.array(x.astype(np.int32), mask=~known[c]) for c, x in v.items()}
            | {c: pa.array(x.astype(bool), mask=~set_flags[c]) for c, x in flags.items()})


def _pcap_state(data: bytes) -> dict:
    for order in "<>":
        unit = PCAP_MAGIC.get(struct.unpack(order + "I", data[:4])[0])
        if unit:
            return {"order": order, "unit": unit, "link": struct.unpack(order + "I", data[20:24])[0] & 0xFFFF}
    raise CaptureError("unknown capture format")


def _records(data, at: int, state: dict, cut_off: bool = False):
    """(offset behind the record, time, link, start, size) from a buffer; start is -1 for what is no frame.

    Stops before a record that the buffer does not hold as a whole; with ``cut_off`` a frame that the file breaks off in
    is given as far as it goes. ``state`` follows the blocks.
    """
    end = len(data)
    if "unit" in state:
        head = struct.Struct(state["order"] + "4I")
        while at + 16 <= end:
            seconds, fraction, size, _ = head.unpack_from(data, at)
            if at + 16 + size > end:
                if not cut_off:
                    return
                size = end - at - 16
            yield at + 16 + size, seconds * 10 ** 9 + fraction * state["unit"], state["link"], at + 16, size
            at += 16 + size
        return
    while at + 12 <= end:
        if struct.unpack_from("<I", data, at)[0] == SECTION:
            state["order"] = "<" if data[at + 8:at + 12] == struct.pack("<I", BYTE_ORDER) else ">"
            state["links"] = []
        order = state["order"]
        block, size = struct.unpack_from(order + "2I", data, at)
        if size < 12 or at + size > end:
            return
        body = at + 8
        if block == INTERFACE:
            per_second = 10 ** 6
            for code, value in _ng_options(bytes(data[body + 8:at + size - 4]), order):
                if code == 9 and value:
                    per_second = 2 ** (value[0] & 127) if value[0] & 128 else 10 ** value[0]
            state["links"].append((struct.unpack_from(order + "H", data, body)[0], per_second))
            yield at + size, 0, 0, -1, 0
        elif block == ENHANCED:
            number, high, low, kept, _ = struct.unpack_from(order + "5I", data, body)
            link, per_second = state["links"][number]
            yield at + size, ((high << 32) | low) * 10 ** 9 // per_second, link, body + 20, min(kept, size - 32)
        elif block == SIMPLE:
            full = struct.unpack_from(order + "I", data, body)[0]
            yield at + size, 0, state["links"][0][0], body + 4, min(full, size - 16)
        else:
            yield at + size, 0, 0, -1, 0
        at += size


def _index_file(path: str, stretch: int):
    """(first frame, begin, finish, state) of each stretch of a file."""
    system, name = filesystem(path)
    if name.endswith(".gz"):
        yield 0, -1, -1, ""
        return
    with system.open_input_file(name) as source:
        total = source.size()
        head = source.read(24)
        if len(head) < 4:
            return
        if struct.unpack("<I", head[:4])[0] == SECTION:
            state, at = {"order": "<", "links": []}, 0
        elif len(head) < 24:
            _pcap_state(head.ljust(24, b"\0"))
            return
        else:
            state, at = _pcap_state(head), 24
        begin, first, frames, known = at, 0, 0, json.dumps(state)
        window = stretch
        while at < total:
            source.seek(at)
            data, moved = source.read(min(window, total - at)), 0
            for moved, _, _, start, _ in _records(data, 0, state):
                frames += start >= 0
                if at + moved - begin >= stretch:
                    yield first, begin, at + moved, known
                    begin, first, known = at + moved, frames, json.dumps(state)
            if not moved and len(data) == total - at:
                at = total  # the file breaks off within a record
                break
            window = stretch if moved else 2 * window  # a record longer than a stretch
            at += moved
        if at > begin:
            yield first, begin, at, known


def capture_index(spark: SparkSession, path: str, stretch: int = STRETCH) -> DataFrame:
    """Where the stretches of all capture files of a folder begin and end; one task walks over each file's headers."""
    names = list_captures(path)

    def walk(batches):
        for pdf in batches:
            for file, number in zip(pdf["file"], pdf["file_no"]):
                rows = list(_index_file(file, stretch))
                if rows:
                    yield pd.DataFrame([(file, number, *r) for r in rows], columns=["file", "file_no", "first", "begin", "finish", "state"])

    files = spark.createDataFrame(list(zip(names, range(len(names)))), "file string, file_no long")
    return files.repartition(max(1, len(names)), "file_no").mapInPandas(walk, INDEX)


def _decoded(file: str, number: int, first: int, data: bytes, records: list, schema: pa.Schema):
    """Batches of the header table of frames in one buffer."""
    flat = np.frombuffer(data, np.uint8)
    for k in range(0, len(records), BATCH):
        part = records[k:k + BATCH]
        start, size = (np.fromiter((r[c] for r in part), np.int64, len(part)) for c in (3, 4))
        columns = decode_frames(flat, start, size, np.fromiter((r[2] for r in part), np.int64, len(part)))
        columns |= {"file": pa.repeat(pa.scalar(file), len(part)),
                    "frame_no": pa.array(number * FILE_FRAMES + first + k + np.arange(len(part))),
                    "ts_ns": pa.array([r[1] for r in part], pa.int64())}
        if "raw" in schema.names:
            columns["raw"] = pa.array([data[r[3]:r[3] + r[4]] for r in part], pa.binary())
        yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def _read_stretch(file: str, number: int, first: int, begin: int, finish: int, state: str, schema: pa.Schema):
    if begin >= 0:
        system, name = filesystem(file)
        with system.open_input_file(name) as source:
            source.seek(begin)
            data = source.read(finish - begin)
        held = json.loads(state)
        yield from _decoded(file, number, first, data, [r for r in _records(data, 0, held, cut_off=True) if r[3] >= 0], schema)
        return
    waiting, held = [], 0
    for ts, link, frame in read_frames(file):
        waiting.append((ts, link, frame))
        if len(waiting) == BATCH:
            yield from _decoded(file, number, first + held, *_joined(waiting), schema)
            held, waiting = held + BATCH, []
    if waiting:
        yield from _decoded(file, number, first + held, *_joined(waiting), schema)


def _joined(frames: list) -> tuple[bytes, list]:
    records, at = [], 0
    for ts, link, frame in frames:
        records.append((0, ts, link, at, len(frame)))
        at += len(frame)
    return b"".join(f for _, _, f in frames), records


class _File(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.schema, self.path = schema, path

    def partitions(self):
        return [_File(i, p) for i, p in enumerate(list_captures(self.path))]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        for row in _index_file(partition.path, STRETCH):
            yield from _read_stretch(partition.path, partition.number, *row, schema)


class CaptureSource(DataSource):
    """``spark.read.format('captures').load(folder or file)``; option ``raw`` keeps the bytes."""

    @classmethod
    def name(cls):
        return "captures"

    def schema(self):
        return HEADERS + (RAW if str(self.options.get("raw", "")).lower() == "true" else "")

    def reader(self, schema):
        return _Reader(schema, self.options["path"])


def read_captures(spark: SparkSession, path: str, raw: bool = False, stretch: int = STRETCH) -> DataFrame:
    """Header table of all capture files of a folder; frame numbers follow the file names.

    With ``raw`` every row also carries its frame, e.g. for writing packet subsets. Files are read by stretches of about
    ``stretch`` bytes, dealt evenly over the tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    index = cut(capture_index(spark, path, stretch))
    ddl = HEADERS + (RAW if raw else "")
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_stretch(*(row[c] for c in ("file", "file_no", "first", "begin", "finish", "state")), schema)

    count = max(1, index.count())
    tasks = min(count, max(spark.sparkContext.defaultParallelism * 4, -(-count // 8)))
    return index.repartition(tasks, "file_no", "first").mapInArrow(read, ddl)
