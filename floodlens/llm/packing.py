"""Best-fit packing of tokenised documents by exact-complement hashing.

1. Texts are tokenised where they lie and cut into pieces; pieces (not ids) are written once.
2. Lengths are counted: at most ``limit`` different ones, however many documents there are. From these counts the
   driver plans *patterns*, multisets of lengths that share a sequence, each with a multiplicity.
3. Each piece gets its rank among the pieces of its length (counts per block and length, summed over blocks), and
   the rank tells its pattern, its copy of the pattern and its place there. No group is gathered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from floodlens.llm.common import ANY, drop_kept, kept, map_texts, texts
from floodlens.session import cut

END_ID = 1
#: Units kept in a worker's cache before it is emptied.
CACHED_WORDS = 400_000


#: Texts whose split into units is known without the tokenizer: ASCII and precomposed Latin letters.
SIMPLE = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: The tokenizer's own split of lower-case text, for such texts. A fixed value of the vocabulary.
UNITS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Stands for the end id; no unit holds a blank.
END = " "


class WordEncoder:
    """Ids of whole texts, put together from those of their units through a cache.

    The tokenizer lowers case, drops white space and splits the rest into units before anything else, so that the ids of
    a text are those of its units in a row. Texts with other characters are split at spaces and line feeds only, over
    which it never joins either.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cached = cached
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {END: 0}
        self.first, self.size, self.ids = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([END_ID], np.uint32)

    @staticmethod
    def units(text: str) -> list[str]:
        if SIMPLE.fullmatch(text) and "<|" not in text:
            return UNITS.findall(text.lower())
        return [w for w in text.replace("\n", " ").split(" ") if w]

    def _encoded(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit. Units that are one word to the tokenizer are encoded many at a time."""
        alone = [u for u in units if u != u.lower() or "<|" in u or not (SIMPLE.fullmatch(u) and UNITS.fullmatch(u))]
        out = dict(zip(alone, (e.ids for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False))))
        words = [u for u in units if u not in out]
        groups = [words[i:i + 100] for i in range(0, len(words), 100)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = e.ids
            stops = (np.nonzero(self.ends_word[ids])[0] + 1).tolist()
            out.update(zip(group, (ids[a:b] for a, b in zip([0, *stops], stops))))
        return [out[u] for u in units]

    def _learn(self, units: list[str]) -> None:
        found = self._encoded(units)
        self.codes.update(zip(units, range(len(self.codes), len(self.codes) + len(units))))
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))])

    def encode(self, several: list[str]) -> list[np.ndarray]:
        """Ids of each text with the end id behind them."""
        if len(self.codes) > self.cached:
            self._clear()
        split = [self.units(t) for t in several]
        unknown = set(chain.from_iterable(split)).difference(self.codes)
        if unknown:
            self._learn(list(unknown))
        for units in split:
            units.append(END)
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        size = self.size[codes]
        end = np.cumsum(size)
        ids = self.ids[np.arange(end[-1] if len(end) else 0) + np.repeat(self.first[codes] - end + size, size)]
        stops = np.cumsum([len(u) for u in split]) - 1
        return np.split(ids, end[stops][:-1]) if several else []


#: The name under which a worker keeps its encoder.
ENCODER = "word encoder"


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder; a reused worker keeps its cache from task to task of packing."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
    return kept(f"{ENCODER} {path}", lambda: WordEncoder(path))


def token_pieces(docs: DataFrame, tokenizer: str | Callable[[], str], limit: int = 4096, id_column: str = "doc_id",
                 text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``limit`` tokens: id, piece, start, length, ids_crc32 and, on request, the ids."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def make():
        path = tokenizer() if callable(tokenizer) else tokenizer
        drop_kept(f"{ENCODER} {path}")
        encoder = word_encoder(path)

        def work(batch):
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts(batch, text_column))):
                ids = ids.astype("<u4")
                for number, start in enumerate(range(0, len(ids), limit)):
                    part = ids[start:start + limit]
                    rows.append((key, number, start, len(part), zlib.crc32(part.tobytes()))
                                + ((part.astype(np.int32),) if with_ids else ()))
            return list(zip(*rows)) if rows else [[]] * (6 if with_ids else 5)

        return work

    return map_texts(docs, [id_column, text_column], make, schema, keep=ANY)


def _complement(gap: int, left: np.ndarray, taken: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three lengths with the sum ``gap``, longest first, of which enough are left.

    ``left`` holds how many of each length are left, without those in ``taken``.
    """
    free = left - taken
    if free[gap] > 0:
        return (gap,)
    have = np.nonzero(free[:gap] > 0)[0]
    have = have[have > 0]
    if not len(have):
        return None

    def pair(total: int, spare: np.ndarray) -> tuple[int, int] | None:
        low = have[2 * have <= total]
        ok = (spare[low] > 0) & (spare[total - low] > (2 * low == total))
        hit = np.nonzero(ok)[0]
        return (total - int(low[hit[0]]), int(low[hit[0]])) if len(hit) else None

    if (two := pair(gap, free)) is not None:
        return two
    # all sums of two lengths at once: the product of the lengths' indicator with itself
    present = np.zeros(2 * gap)
    present[have] = 1
    sums = np.fft.irfft(np.fft.rfft(present) ** 2, 2 * gap)[:gap] > 0.5
    for c in have[::-1]:
        rest = gap - int(c)
        if rest > 0 and sums[rest]:
            spare = free.copy()
            spare[c] -= 1
            if (two := pair(rest, spare)) is not None:
                return tuple(sorted((int(c), *two), reverse=True))
    return None


def plan_patterns(counts: dict[int, int], limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """(multiplicity, lengths) of sequences that use every piece once.

    A sequence opens with the longest length left. Its gap is filled exactly by a single length, a pair or a triple if
    the counts allow it; else by the longest length that fits, the best fit, after which the rest of the gap is tried
    again. A pattern is repeated as often as the counts of its lengths allow.
    """
    left = np.zeros(limit + 1, np.int64)
    for length, number in counts.items():
        left[length] += number
    patterns = []
    while left.any():
        used = [int(np.nonzero(left)[0][-1])]
        taken = np.zeros_like(left)
        taken[used[0]] += 1
        gap = limit - used[0]
        while gap:
            more = _complement(gap, left, taken)
            if more is None:
                fits = np.nonzero((left - taken)[:gap + 1] > 0)[0]
                if not len(fits):
                    break
                more = (int(fits[-1]),)
            for length in more:
                taken[length] += 1
                used.append(length)
                gap -= length
        kinds = np.nonzero(taken)[0]
        times = int((left[kinds] // taken[kinds]).min())
        left -= times * taken
        patterns.append((times, tuple(sorted(used, reverse=True))))
    return patterns


def _slots(patterns: list[tuple[int, tuple[int, ...]]]) -> pd.DataFrame:
    """For each length, in order of rank: first rank, uses in the pattern, first sequence, first offset."""
    rows, first, rank = [], 0, {}
    for times, lengths in patterns:
        offset = 0
        for length in dict.fromkeys(lengths):
            uses = lengths.count(length)
            rows.append((length, rank.get(length, 0), uses, first, offset))
            rank[length] = rank.get(length, 0) + uses * times
            offset += uses * length
        first += times
    return pd.DataFrame(rows, columns=["length", "rank", "uses", "sequence", "offset"]).sort_values(["length", "rank"])


def place(pieces: DataFrame, limit: int = 4096, block: str = "block") -> DataFrame:
    """Add sequence_id and offset. ``pieces`` must be stored and carry a bounded ``block`` number of its rows."""
    per_block = pieces.groupBy(block, "length").count()
    counts = {r["length"]: r["n"] for r in per_block.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # ≤ limit rows
    slots = _slots(plan_patterns(counts, limit))
    starts = {int(k): tuple(v[c].to_numpy() for c in ("rank", "uses", "sequence", "offset")) for k, v in slots.groupby("length")}

    before = per_block.select(block, "length", (F.sum("count").over(
        Window.partitionBy("length").orderBy(block).rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"))
    inner = Window.partitionBy(block, "length").orderBy(*[c for c in pieces.columns if c in ("doc_id", "piece")])
    ranked = (pieces.withColumn("rank", F.row_number().over(inner) - 1)
              .join(before, [block, "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", block))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def locate(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size, where in length.groupby(length).indices.items():
            first, uses, base, at = starts[int(size)]
            r = rank.to_numpy()[where]
            slot = np.searchsorted(first, r, side="right") - 1
            r = r - first[slot]
            sequence[where] = base[slot] + r // uses[slot]
            offset[where] = at[slot] + r % uses[slot] * size
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return (ranked.withColumn("at", locate("length", "rank"))
            .select(*[c for c in pieces.columns if c != block], F.col("at.sequence_id").alias("sequence_id"),
                    F.col("at.offset").alias("offset")))


def best_fit_packing(docs: DataFrame, tokenizer: str | Callable[[], str], limit: int = 4096, id_column: str = "doc_id",
                     text_column: str = "text", with_ids: bool = False, rows_per_block: int = 1 << 16) -> DataFrame:
    """Pack all documents into sequences of at most ``limit`` tokens; one row per piece.

    Null texts are empty and give one piece, the end id. Rows with equal ids are packed apart; an empty table
    gives no rows; other columns are ignored. ``tokenizer`` is a path, or a function that gives it in the worker.
    """
    made = token_pieces(docs.select(F.col(id_column).alias("doc_id"), text_column), tokenizer, limit,
                        text_column=text_column, with_ids=with_ids)
    # monotonically increasing ids count rows inside a partition: a block is a bounded stretch of them
    numbered = made.withColumn("block", F.floor(F.monotonically_increasing_id() / rows_per_block))
    return place(cut(numbered), limit).withColumnRenamed("doc_id", id_column)
