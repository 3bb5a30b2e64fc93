"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id.

Suffix arrays over every byte of a corpus would be many times its size, so they are kept sparse. Every string of
``LENGTH`` bytes has an *anchor*, the smallest hash among its grams of ``GRAM`` bytes; equal strings have equal anchors.
Consecutive strings with the same anchor form a *run*, some fifteen bytes of starts on average.

1. Chunks of documents send, for each of their runs, hashes of its anchor and of its bytes, to the anchor's bucket.
   A run whose bytes occur in a smaller document is settled there as a whole. A run whose anchor occurs with
   no other bytes cannot repeat in part, and is settled too.
2. The remaining runs, edges of repeated passages in the main, go to their bucket as text, one copy of each. There the
   index family works: batches of runs, in order of their documents, get a suffix array (their suffixes of ``LENGTH``
   bytes, sorted); it is merge-scanned against the levels so far, where an equal suffix is a long match with an
   earlier document, becomes a level itself, and levels of about equal size are merged.
3. Chunks put together what came back for their runs.

Chunks and buckets have bounded sizes whatever the keys are: of an anchor with very many different runs (the edge of a
passage that a large part of all documents share) a chunk sends one entry, and its suffixes are then spread over all
buckets by their own hashes. Texts are shuffled once; all three passes over chunks read that shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from floodlens.llm.common import arrow_schema, thrifty

LENGTH = 50
GRAM = 20
WINDOW = LENGTH - GRAM + 1
#: A run has at most so many starts, so that its first and last string cover it; they also fit into a 64-bit mask.
RUN = 48
#: More different runs with one anchor in a chunk, or in a bucket, make the anchor common.
COMMON_IN_CHUNK, COMMON = 16, 256
STRETCH = 1 << 20
BATCH = 1 << 14
FULL, PART, SPREAD = 1, 2, 4


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Hashes of strings from hashes of their two parts, the second one ``shift`` places on."""
    n = min(len(a), len(b) - shift)
    return mix(a[:n] * np.uint64(0x9E3779B97F4A7C15) + b[shift:shift + n])


def string_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams and of all strings of ``LENGTH`` bytes, by doubling."""
    h = {1: mix(data.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))}
    for size in (1, 2, 4, 8, 16):
        h[2 * size] = _joined(h[size], h[size], size)
    grams = _joined(h[16], h[4], 16)
    return grams, _joined(_joined(h[32], h[16], 32), h[2], 48)


def sliding_min(v: np.ndarray, window: int) -> np.ndarray:
    size = 1
    while 2 * size <= window:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:len(v) - (window - size)], v[window - size:]) if size < window else v


class Runs:
    """Runs of a chunk. ``data`` is the concatenation of its documents, which must be in order of their ids."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray):
        self.data, self.offsets, self.ids = data, offsets, ids
        last = len(data) - LENGTH + 1
        self.strings = np.zeros(max(last, 0), np.uint64)
        begins, sizes, anchors = [], [], []
        doc_of = np.searchsorted(offsets, np.arange(0, max(last, 0), STRETCH), side="right") - 1
        for at, _ in zip(range(0, max(last, 0), STRETCH), doc_of):
            end = min(at + STRETCH, last)
            grams, strings = string_hashes(data[at:end + LENGTH - 1])
            self.strings[at:end] = strings
            anchor = sliding_min(grams, WINDOW)
            first = np.searchsorted(offsets, at, side="right")
            # documents that begin in this stretch; one that begins at its end belongs to the next
            cuts = offsets[first:np.searchsorted(offsets, end, side="left")]
            ok = np.ones(end - at, bool)
            for c in offsets[first:np.searchsorted(offsets, end + LENGTH, side="right")]:
                ok[max(0, c - LENGTH + 1 - at):max(0, c - at)] = False  # strings that would cross into it
            new = np.append(True, anchor[1:] != anchor[:-1])
            new[cuts - at] = True
            new[1:] |= ok[1:] & ~ok[:-1]
            start = np.nonzero(new & ok)[0]
            # a run ends where the next begins or where strings end
            stop = np.nonzero(np.append(ok[:-1] & (new[1:] | ~ok[1:]), ok[-1:]))[0] + 1
            size = stop - start
            many = -(-size // RUN)
            piece = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            begins.append(np.repeat(start, many) + piece * RUN + at)
            sizes.append(np.minimum(RUN, np.repeat(size, many) - piece * RUN))
            anchors.append(np.repeat(anchor[start], many))
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.begin, self.size, self.anchor = join(begins, np.int64), join(sizes, np.int64), join(anchors, np.uint64)
        self.doc = ids[np.searchsorted(offsets, self.begin, side="right") - 1]
        text = mix(self.strings[self.begin] * np.uint64(0xC2B2AE3D27D4EB4F) + self.strings[self.begin + self.size - 1]
                   + self.size.astype(np.uint64))
        #: 47 bits of the hash of a run's bytes; 0 stands for any of a common anchor's runs
        self.bytes = (text >> np.uint64(17)) + np.uint64(1)

    def enter(self, buckets: int) -> None:
        """One entry for each different run, in order of bucket and anchor, with its smallest document."""
        key = (self.anchor % np.uint64(buckets)) << np.uint64(32) | self.anchor >> np.uint64(32)
        order = np.lexsort((self.bytes, key))
        k, b, doc = key[order], self.bytes[order], self.doc[order]
        new_key = np.append(True, k[1:] != k[:-1])[:len(k)]
        new = new_key | np.append(True, b[1:] != b[:-1])[:len(k)]
        heads = np.nonzero(new_key)[0]
        different = np.add.reduceat(new.astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
        common = np.repeat(different > COMMON_IN_CHUNK, np.diff(np.append(heads, len(k))))
        entry = np.where(common, new_key, new)
        self.entry = np.empty(len(k), np.int64)
        self.entry[order] = np.cumsum(entry) - 1
        self.key, self.first = k[entry], order[entry]
        self.marks = np.where(common, np.uint64(0), b)[entry]
        self.low = doc[entry]  # the sort is stable and runs are in order of their documents
        self.edges = np.searchsorted(self.key >> np.uint64(32), np.arange(buckets + 1))


def packed(values: np.ndarray) -> bytes:
    """Bytes by place value, so that those that are mostly zero compress."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""


def unpacked(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


# ---------------------------------------------------------------- the index family

class SuffixLevels:
    """Suffix arrays whose sizes form a geometric series: each sorted, without repeats, with smallest documents."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, suffixes: np.ndarray) -> np.ndarray:
        """Smallest document of each of the sorted suffixes over all levels; the largest number where there is none."""
        low = np.full(len(suffixes), np.iinfo(np.int64).max)
        for keys, docs in self.levels:
            place = np.minimum(np.searchsorted(keys, suffixes), len(keys) - 1)
            hit = keys[place] == suffixes
            low[hit] = np.minimum(low[hit], docs[place[hit]])
        return low

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        self.levels.append((keys, docs))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            self.levels.append(unique_suffixes(np.concatenate([a, b]), np.concatenate([x, y]))[:2])


def unique_suffixes(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different suffixes, their smallest documents, and where each given suffix went."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.append(True, k[1:] != k[:-1])
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[new], np.minimum.reduceat(docs[order], np.nonzero(new)[0]), place


def matched_starts(text: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For runs given as concatenated text: a mask of the starts whose string is in a document with a smaller id."""
    masks = np.zeros(len(sizes), np.uint64)
    order = np.argsort(docs, kind="stable")
    begins = np.cumsum(sizes + LENGTH - 1) - (sizes + LENGTH - 1)
    windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH) if len(text) >= LENGTH else None
    levels, at = SuffixLevels(), 0
    total = np.cumsum(sizes[order])
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH)))
        batch = order[at:end]
        n = sizes[batch]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        suffixes = np.ascontiguousarray(windows[np.repeat(begins[batch], n) + step]).view(f"S{LENGTH}").ravel()
        doc = np.repeat(docs[batch], n)
        keys, low, place = unique_suffixes(suffixes, doc)
        earlier = np.minimum(levels.scan(keys), low)[place]
        hit = earlier < doc
        np.bitwise_or.at(masks, np.repeat(batch, n)[hit], np.uint64(1) << step[hit].astype(np.uint64))
        levels.add(keys, low)
        at = end
    return masks


# ---------------------------------------------------------------- passes over chunks and buckets

class _Chunk:
    """A chunk's documents in order of id and text, their runs, and what came back for them."""

    def __init__(self, rows: pa.Table, buckets: int):
        ids = rows["doc_id"].to_numpy()
        texts = [t or b"" for t in rows["text"].to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.order = order
        self.ids = ids[order].astype(np.int64)
        self.texts = [texts[i] for i in order]
        self.offsets = np.cumsum([0] + [len(t) for t in self.texts])
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.buckets = buckets
        self.runs = Runs(self.data, self.offsets[:-1], self.ids)
        self.runs.enter(buckets)
        self.codes = np.zeros(len(self.runs.key), np.uint8)

    def take_codes(self, replies: pa.Table) -> None:
        for bucket, kind, codes in zip(*(replies[c].to_pylist() for c in ("bucket", "kind", "reply"))):
            if kind == 0:
                self.codes[self.runs.edges[bucket]:self.runs.edges[bucket + 1]] = np.frombuffer(codes, np.uint8)

    def partial(self) -> np.ndarray:
        """Entries whose text is asked for."""
        return np.nonzero(self.codes == PART)[0]

    def spread(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts under common anchors; their different strings by bucket and hash (first start), and which is whose."""
        r = self.runs
        mine = np.nonzero(self.codes[r.entry] & SPREAD)[0]
        n = r.size[mine]
        starts = np.repeat(r.begin[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(starts, kind="stable")
        starts = starts[order]
        string = r.strings[starts]
        rank = np.stack([string % np.uint64(self.buckets), string]) if len(string) else np.zeros((2, 0), np.uint64)
        by = np.lexsort((rank[1], rank[0]))
        s = string[by]
        new = np.append(True, s[1:] != s[:-1])[:len(s)]
        which = np.empty(len(s), np.int64)
        which[by] = np.cumsum(new) - 1
        return starts, by[new], which, rank[0][by[new]].astype(np.int64)

    def doc_at(self, starts: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.offsets[:-1], starts, side="right") - 1]


ENTRIES = "bucket int, chunk bigint, anchor binary, marks binary, low binary"
REPLIES = "chunk bigint, bucket int, kind int, reply binary"
PIECES = "bucket int, chunk bigint, kind int, low binary, size binary, text binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _send_entries(buckets: int):
    schema = arrow_schema(ENTRIES)

    def work(rows: pa.Table) -> pa.Table:
        r, chunk = _Chunk(rows, buckets).runs, rows["chunk"][0].as_py()
        out = []
        for bucket in np.nonzero(np.diff(r.edges))[0].tolist():
            part = slice(r.edges[bucket], r.edges[bucket + 1])
            anchor = r.key[part].astype(np.uint32)
            out.append((bucket, chunk, packed(np.diff(anchor, prepend=np.uint32(0))), packed(r.marks[part]), packed(r.low[part])))
        return _table(out, schema)

    return work


def _settle_entries(rows: pa.Table, schema: pa.Schema) -> pa.Table:
    """Codes for the entries of every chunk in a bucket."""
    anchors = [np.cumsum(unpacked(a, np.uint32), dtype=np.uint32) for a in rows["anchor"].to_pylist()]
    sizes = [len(a) for a in anchors]
    anchor = np.concatenate(anchors)
    mark = np.concatenate([unpacked(m, np.uint64) for m in rows["marks"].to_pylist()])
    low = np.concatenate([unpacked(d, np.int64) for d in rows["low"].to_pylist()])
    order = np.lexsort((mark, anchor))
    a, m, d = anchor[order], mark[order], low[order]
    new_anchor = np.append(True, a[1:] != a[:-1])
    new = new_anchor | np.append(True, m[1:] != m[:-1])
    heads, starts = np.nonzero(new_anchor)[0], np.nonzero(new)[0]
    several = np.add.reduceat(new.astype(np.int64), heads)
    common = (m[heads] == 0) | (several > COMMON)  # a chunk's mark for a common anchor sorts first
    per_anchor = np.diff(np.append(heads, len(a)))
    smallest = np.repeat(np.minimum.reduceat(d, starts), np.diff(np.append(starts, len(a))))
    code = np.where(smallest < d, FULL, np.where(np.repeat(several > 1, per_anchor), PART, 0))
    code = np.where(np.repeat(common, per_anchor), SPREAD, code).astype(np.uint8)
    back = np.empty_like(code)
    back[order] = code
    parts = np.split(back, np.cumsum(sizes)[:-1])
    bucket = rows["bucket"][0].as_py()
    return _table([(chunk, bucket, 0, part.tobytes()) for chunk, part in zip(rows["chunk"].to_pylist(), parts) if part.any()], schema)


def _send_pieces(buckets: int):
    schema = arrow_schema(PIECES)

    def work(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows or not replies.num_rows:
            return schema.empty_table()
        c, chunk = _Chunk(rows, buckets), rows["chunk"][0].as_py()
        c.take_codes(replies)
        r, data, out = c.runs, c.data, []
        asked = c.partial()
        first = r.first[asked]
        begin, size = r.begin[first], r.size[first]
        texts = [data[b:b + n + LENGTH - 1].tobytes() for b, n in zip(begin.tolist(), size.tolist())]
        edges = np.searchsorted((r.key[asked] >> np.uint64(32)).astype(np.int64), np.arange(buckets + 1))
        for bucket in np.nonzero(np.diff(edges))[0].tolist():
            part = slice(edges[bucket], edges[bucket + 1])
            out.append((bucket, chunk, 1, packed(r.low[asked[part]]), size[part].astype(np.uint8).tobytes(), b"".join(texts[part])))
        starts, firsts, _, owner = c.spread()
        docs = c.doc_at(starts[firsts])
        edges = np.searchsorted(owner, np.arange(buckets + 1))
        for bucket in np.nonzero(np.diff(edges))[0].tolist():
            part = slice(edges[bucket], edges[bucket + 1])
            text = b"".join(data[s:s + LENGTH].tobytes() for s in starts[firsts[part]].tolist())
            out.append((bucket, chunk, 2, packed(docs[part]), bytes([1]) * (part.stop - part.start), text))
        return _table(out, schema)

    return work


def _match_pieces(rows: pa.Table, schema: pa.Schema) -> pa.Table:
    """Masks for the texts that chunks sent to a bucket."""
    sizes = [np.frombuffer(s, np.uint8).astype(np.int64) for s in rows["size"].to_pylist()]
    docs = np.concatenate([unpacked(d, np.int64) for d in rows["low"].to_pylist()])
    text = np.frombuffer(b"".join(rows["text"].to_pylist()), np.uint8)
    masks = np.split(matched_starts(text, np.concatenate(sizes), docs), np.cumsum([len(s) for s in sizes])[:-1])
    bucket = rows["bucket"][0].as_py()
    return _table([(chunk, bucket, kind, packed(m)) for chunk, kind, m in zip(rows["chunk"].to_pylist(), rows["kind"].to_pylist(), masks)
                   if m.any()], schema)


def _removed(c: _Chunk, replies: pa.Table) -> np.ndarray:
    """Which bytes of the chunk go."""
    c.take_codes(replies)
    r = c.runs
    asked = c.partial()
    masks = np.zeros(len(c.codes), np.uint64)
    edges = np.searchsorted((r.key[asked] >> np.uint64(32)).astype(np.int64), np.arange(c.buckets + 1))
    starts, firsts, which, owner = c.spread()
    spread_edges = np.searchsorted(owner, np.arange(c.buckets + 1))
    earlier = np.zeros(len(firsts), bool)
    for bucket, kind, reply in zip(*(replies[x].to_pylist() for x in ("bucket", "kind", "reply"))):
        if kind == 1:
            masks[asked[edges[bucket]:edges[bucket + 1]]] = unpacked(reply, np.uint64)
        elif kind == 2:
            earlier[spread_edges[bucket]:spread_edges[bucket + 1]] = unpacked(reply, np.uint64) > 0
    change = np.zeros(len(c.data) + 1, np.int32)
    code = c.codes[r.entry]
    # in its own chunk a run can also repeat one of a smaller document
    whole = ((code & SPREAD) == 0) & (((code & FULL) > 0) | (r.doc > r.low[r.entry]))
    np.add.at(change, r.begin[whole], 1)
    np.add.at(change, r.begin[whole] + r.size[whole] + LENGTH - 1, -1)
    part = np.nonzero(~whole & (masks[r.entry] > 0))[0]
    for bit in range(RUN):
        hit = part[(masks[r.entry[part]] >> np.uint64(bit) & np.uint64(1)) > 0]
        np.add.at(change, r.begin[hit] + bit, 1)
        np.add.at(change, r.begin[hit] + bit + LENGTH, -1)
    if len(starts):
        hit = starts[earlier[which] | (c.doc_at(starts) > c.doc_at(starts[firsts])[which])]
        np.add.at(change, hit, 1)
        np.add.at(change, hit + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def _results(buckets: int, carry: Sequence[str], schema: pa.Schema):
    def work(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        c = _Chunk(rows, buckets)
        gone = _removed(c, replies)
        out = []
        for k, (key, text) in enumerate(zip(c.ids.tolist(), c.texts)):
            lost = gone[c.offsets[k]:c.offsets[k + 1]]
            n = int(lost.sum())
            kept = c.data[c.offsets[k]:c.offsets[k + 1]][~lost].tobytes() if n else text
            spans = int(lost[:1].sum() + (lost[1:] & ~lost[:-1]).sum()) if n else 0
            out.append((key, len(text), n, spans, hashlib.sha256(kept).hexdigest(), kept))
        columns = [pa.array(x, f.type) for x, f in zip(zip(*out), schema)]
        columns += [rows[name].take(c.order).combine_chunks() for name in carry]
        return pa.table(columns, schema=schema)

    return work


def suffix_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: Sequence[str] = (),
                 chunk_bytes: int = 8 << 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of each document.

    Columns named in ``carry`` come along.

    Null texts are empty. Rows with equal ids count as one document when compared: they do not remove from each other. A
    row with a null id takes no part and is kept whole. Texts shorter than 50 bytes are kept. Other columns are ignored;
    an empty table gives no rows.
    """
    carry = [c for c in carry if c not in (id_column, text_column)]
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("text"),
                        *[F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)])
    extra = [f"carry_{k}" for k in range(len(carry))]
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(1, -(-total // chunk_bytes)), max(1, -(-total // bucket_bytes))
    dealt = named.where("doc_id IS NOT NULL").select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk"), "doc_id", "text", *extra)
    fields = StructType.fromDDL("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary").fields
    result = StructType(fields + [named.schema[c] for c in extra])

    answer = arrow_schema(REPLIES)
    entries = dealt.groupBy("chunk").applyInArrow(thrifty(_send_entries(buckets)), ENTRIES)
    codes = entries.groupBy("bucket").applyInArrow(thrifty(lambda rows: _settle_entries(rows, answer)), REPLIES)
    asked = dealt.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInArrow(thrifty(_send_pieces(buckets)), PIECES)
    masks = asked.groupBy("bucket").applyInArrow(thrifty(lambda rows: _match_pieces(rows, answer)), REPLIES)
    replies = codes.unionByName(masks)
    found = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        thrifty(_results(buckets, extra, to_arrow_schema(result))), result)
    none = F.lit(0).cast("long")
    loose = named.where("doc_id IS NULL").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept"), *extra)
    return (found.unionByName(loose).withColumnRenamed("doc_id", id_column)
            .withColumnsRenamed({f"carry_{k}": c for k, c in enumerate(carry)}))
