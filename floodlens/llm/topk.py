"""Exact inner-product search over a bit-sliced index.

Vectors are quantised to integers. A block of candidates holds, for each dimension, one bitmap per binary digit of its
values (a slice). The scores of a query against a whole block are a sum of slices, shifted by the digits of the
query's own components, that carry-save adders make out of bitmaps alone; the best rows are then picked from the
most significant slice of that sum downward. Blocks of queries meet blocks of candidates, which is the stated query
set against all rows; a query keeps ``k`` rows of each block, and those are ranked at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from floodlens.llm.common import arrow_schema

WORD = 64


class SlicedBlock:
    """Bit slices of a block of integer vectors, rows in order of their ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        values = values[order]
        self.rows, self.dims = values.shape
        self.low = values.min(axis=0)
        self.width = int((values.max(axis=0) - self.low).max()).bit_length()
        self.words = -(-self.rows // WORD)
        shifted = (values - self.low).T.astype(np.uint64)
        #: slices[d, j]: digit j of dimension d, one bit per row
        self.slices = np.stack([self._pack((shifted >> np.uint64(j)) & np.uint64(1)) for j in range(self.width)], axis=1) \
            if self.width else np.zeros((self.dims, 0, self.words), np.uint64)
        self.all = self._pack(np.ones((1, self.rows), np.uint64))[0]

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), self.words * WORD), np.uint8)
        wide[:, :self.rows] = bits
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def _members(self, bitmap: np.ndarray) -> np.ndarray:
        return np.nonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:self.rows])[0]

    def sum_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of (score - constant), least significant first, and the constant.

        A negative component multiplies the complement of the slices, so that only addition is needed.
        """
        constant = int(query @ self.low)
        size = np.abs(query)
        negative = query < 0
        constant += int(query[negative].sum()) * ((1 << self.width) - 1)
        columns: dict[int, list[np.ndarray]] = {}
        for digit in range(int(size.max(initial=0)).bit_length()):
            has = (size >> digit & 1).astype(bool)
            for part, flip in ((has & ~negative, False), (has & negative, True)):
                if part.any():
                    for j in range(self.width):
                        rows = self.slices[part, j]
                        columns.setdefault(digit + j, []).append(rows ^ self.all if flip else rows)
        out, weight = [], 0
        while columns and weight <= max(columns):
            rows = np.concatenate(columns[weight]) if weight in columns else np.zeros((0, self.words), np.uint64)
            while len(rows) > 1:
                full = len(rows) // 3
                if full:
                    a, b, c = rows[:full], rows[full:2 * full], rows[2 * full:3 * full]
                    half = a ^ b
                    carry, rest = (a & b) | (half & c), rows[3 * full:]
                    rows = np.concatenate([half ^ c, rest])
                else:
                    carry, rows = (rows[:1] & rows[1:]), rows[:1] ^ rows[1:]
                if carry.any():
                    columns.setdefault(weight + 1, []).append(carry)
            out.append(rows[0] if len(rows) else np.zeros(self.words, np.uint64))
            weight += 1
        return out, constant

    def top(self, query: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows, ties to smaller ids; ``without`` is left out."""
        slices, constant = self.sum_slices(query)
        sure, maybe = np.zeros(self.words, np.uint64), self.all.copy()
        if without is not None:
            own = np.zeros((1, self.rows), np.uint64)
            own[0, self.ids == without] = 1
            maybe &= ~self._pack(own)[0]
        count = lambda bitmap: int(np.bitwise_count(bitmap).sum())
        wanted = min(k, count(maybe))
        for piece in reversed(slices):
            ones = maybe & piece
            held = count(sure) + count(ones)
            if held > wanted:
                maybe = ones
            else:
                sure |= ones
                maybe &= ~piece
                if held == wanted:
                    maybe = np.zeros_like(maybe)
                    break
        chosen = self._members(sure)
        # rows still in question are equal in every slice: the smallest ids win, and ids are in order
        rest = self._members(maybe)[:wanted - len(chosen)]
        chosen = np.concatenate([chosen, rest])
        word, bit = chosen // WORD, (chosen % WORD).astype(np.uint64)
        scores = np.full(len(chosen), constant, np.int64)
        for j, piece in enumerate(slices):
            scores += (piece[word] >> bit & np.uint64(1)).astype(np.int64) << j
        return self.ids[chosen], scores


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(id, dims, values): floor(scale * component). Null vectors or ids and non-finite components drop the row."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return (vectors.where(F.col(id_column).isNotNull() & v.isNotNull() & finite)
            .select(F.col(id_column).cast("long").alias("id"), F.size(v).alias("dims"),
                    F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("values")))


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_column: str = "vec_id",
          vector_column: str = "embedding", block_rows: int = 16_384, query_rows: int = 1024) -> DataFrame:
    """The ``k`` best other rows of every query: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the table. Only vectors with equally many components meet; a row with the id of
    the query is not its candidate, and repeated ids are candidates as often as they occur, and one query
    (that of the smallest vector). Components must lie
    within ``±2^31/scale``. Empty vectors, and an empty table, give no rows. Other columns are ignored.

    Candidates are dealt into blocks of about ``block_rows`` rows by a hash of their ids, queries into blocks of about
    ``query_rows``, so that the work is spread evenly whatever the ids are.
    """
    flagged = vectors.withColumn("__query", F.coalesce(is_query, F.lit(False)))
    rows = quantised(flagged, id_column, vector_column, scale).where("dims > 0")
    asked = (quantised(flagged.where("__query"), id_column, vector_column, scale).where("dims > 0")
             .groupBy("id").agg(F.min(F.struct("dims", "values")).alias("v")).select("id", "v.dims", "v.values"))
    n = max(1, -(-rows.count() // block_rows))
    m = max(1, -(-asked.count() // query_rows))
    salt = F.xxhash64("id")
    # the smaller number of copies is made of the rows: each candidate goes to every block of queries
    left = rows.withColumn("block", F.pmod(salt, F.lit(n))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = asked.withColumn("part", F.pmod(salt, F.lit(m)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = right.withColumn("block", F.col("block").cast("long"))
    schema = arrow_schema("query_id bigint, vec_id bigint, score bigint")

    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return schema.empty_table()
        dims = candidates["dims"][0].as_py()
        matrix = lambda t: t["values"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
        block = SlicedBlock(candidates["id"].to_numpy(), matrix(candidates))
        asks, best, scores = [], [], []
        for own, query in zip(queries["id"].to_numpy(), matrix(queries)):
            found, value = block.top(query, k, own)
            asks.append(np.full(len(found), own))
            best.append(found)
            scores.append(value)
        return pa.table([np.concatenate(x) for x in (asks, best, scores)], schema=schema)

    met = left.groupBy("dims", "block", "part").cogroup(right.groupBy("dims", "block", "part")).applyInArrow(
        search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
