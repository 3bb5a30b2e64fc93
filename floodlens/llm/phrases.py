"""Phrase collocations, mined by Toivonen's method.

1. Texts are stored once as segments: their words as codes into a small vocabulary per segment.
2. A sample of the segments proposes words and pairs of words that look frequent, at a lowered threshold.
3. One full pass counts, exactly, all words and every phrase whose parts are all proposed: what is proposed itself and
   its negative border, which is whatever else the texts hold of such phrases.
4. A frequent phrase that was not proposed is a failure of the border. It may have longer phrases that nobody counted, so
   the proposal grows by the failures and a further pass counts what has become countable, until no failure is left.
   A phrase is never more frequent than its parts, so nothing frequent can stay uncounted.

A proposal travels as a bitmap of hashes, of a fixed size whatever the corpus: a wrong positive only means that one more
phrase is counted. Most of a border is rare: a first count by 40-bit hashes, at least as high as that of any phrase behind it,
tells which phrases to count by their words, and only that count enters the result.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from floodlens.llm.common import arrow_schema, pieces
from floodlens.session import cut

#: The bytes that end a piece of text become full stops, and tabs spaces.
PLAIN = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"." * 9 + b" ")
STOP = b"."
#: Bytes of text in a segment, about.
SEGMENT = 1 << 20
#: Bits of a proposal's bitmap, as a power of two.
BITS = 27
#: Bits of a hash by which phrases are counted first.
KEY = 40
STEP = np.uint64(0x9E3779B97F4A7C15)
SEGMENTS = "lang string, vocabulary binary, codes binary, skip int, n bigint"


# --- segments -------------------------------------------------------------------------

def segments(data: bytes, most: int = SEGMENT):
    """(tokens, skip) of plain lower-case text; the first ``skip`` tokens repeat the end of the segment before."""
    at, carry = 0, []
    while at < len(data):
        end = min(len(data), at + most)
        if end < len(data):
            cut_at = max(data.rfind(b" ", at, end), data.rfind(STOP, at, end))
            if cut_at < 0:  # a word longer than a segment
                cut_at = min((i for i in (data.find(b" ", end), data.find(STOP, end)) if i >= 0), default=len(data) - 1)
            end = cut_at + 1
        tokens = carry + data[at:end].replace(STOP, b" . ").split()
        yield tokens, len(carry)
        carry = tokens[-2:]
        at = end


def pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def encode(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The corpus as segments of one language each; ``n`` counts their words. Code 0 ends a piece."""
    schema = arrow_schema(SEGMENTS)

    def rows(lang, parts):
        data = STOP.join(parts).lower().translate(PLAIN)
        for tokens, skip in segments(data):
            index = defaultdict(count().__next__)
            index[STOP]
            codes = np.fromiter(map(index.__getitem__, tokens), np.int32, len(tokens))
            yield {"lang": lang, "vocabulary": b" ".join(index), "codes": pack(codes), "skip": skip,
                   "n": int(np.count_nonzero(codes[skip:]))}

    def run(batches):
        waiting, held = defaultdict(list), defaultdict(int)

        def flush(langs):
            for lang in langs:
                for row in rows(lang, waiting.pop(lang)):
                    yield pa.RecordBatch.from_pylist([row], schema=schema)
                held.pop(lang)

        for batch in batches:
            for part in pieces(batch, "_t"):
                for lang, raw in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    if raw:
                        waiting[lang].append(raw)
                        held[lang] += len(raw)
                        if held[lang] >= SEGMENT:
                            yield from flush([lang])
                if sum(held.values()) > 8 * SEGMENT:
                    yield from flush(list(waiting))
        yield from flush(list(waiting))

    narrow = docs.select(F.coalesce(F.col(lang_column), F.lit("und")).alias("_l"), F.col(text_column).alias("_t"))
    return narrow.mapInArrow(run, SEGMENTS)


# --- proposals ------------------------------------------------------------------------

def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def keyed(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(64 - KEY)).astype(np.int64)


def places(hashes: np.ndarray) -> np.ndarray:
    return keyed(hashes) >> (KEY - BITS)


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits set at the places of hashes (key): 2^BITS bits, however many there are."""
    at = keys.select((F.shiftright("key", KEY - BITS) + 1).alias("p"))
    found = (at.groupBy(F.bitmap_bucket_number("p").alias("b"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect())
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for row in found:
        size = len(row["m"])
        out[(row["b"] - 1) * size:row["b"] * size] = np.frombuffer(bytes(row["m"]), np.uint8)
    return out


def hashed(phrases: DataFrame) -> DataFrame:
    """The hashes (key) of phrases (lang, phrase) of equally many words."""

    @F.pandas_udf(LongType())
    def key(lang: pd.Series, phrase: pd.Series) -> pd.Series:
        out = np.zeros(len(phrase), np.int64)
        for name in lang.unique():
            rows = np.nonzero((lang == name).to_numpy())[0]
            words = [p.encode().split(b" ") for p in phrase.iloc[rows]]
            hashes = word_hashes([w for ws in words for w in ws], name).reshape(len(rows), -1)
            whole = hashes[:, 0]
            for k in range(1, hashes.shape[1]):
                whole = whole * STEP + hashes[:, k]
            out[rows] = keyed(whole)
        return pd.Series(out)

    return phrases.select(key("lang", "phrase").alias("key"))


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = places(hashes)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def distinct(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of codes below ``size``, and how often each occurs."""
    bits = max(1, int(size).bit_length())
    if bits * len(columns) <= 63:
        key = columns[0]
        for c in columns[1:]:
            key = key << bits | c
        found, often = np.unique(key, return_counts=True)
        parts = [found >> bits * k & ((1 << bits) - 1) for k in range(len(columns) - 1, -1, -1)]
        return parts, often
    found, often = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    return list(found.T), often


def counted(stored: DataFrame, words: bool = False, single: tuple = (), pair: tuple = (), keep: np.ndarray | None = None,
            by_hash: bool = False) -> DataFrame:
    """(lang, size, phrase, f): exact counts over all segments; or (key, f), of all phrases of one hash together.

    ``words`` counts all words. ``single`` is (proposal, proposal before) of words: pairs are counted whose words are all in
    the first and not all in the second. ``pair`` is the same for pairs of words and triples. ``keep`` leaves out
    pairs and triples that are not in that bitmap.
    """
    context = stored.sparkSession.sparkContext
    packed = [[bits if bits is None else pack(bits) for bits in kind] for kind in (single, pair, (keep,))]
    sent = context.broadcast(packed)
    ddl = "key bigint, f bigint" if by_hash else "lang string, size int, phrase string, f bigint"
    schema = arrow_schema(ddl)

    def run(batches):
        single, pair, (keep,) = ([bits if bits is None else unpack(bits, np.uint8) for bits in kind] for kind in sent.value)
        for batch in batches:
            for k in range(batch.num_rows):
                lang, vocabulary, raw, skip = (column[k].as_py() for column in batch.columns)
                names = vocabulary.split(b" ")
                c = unpack(raw, np.int32).astype(np.int64)
                hashes = word_hashes(names, lang)
                texts = None if by_hash else pa.array(names, pa.binary()).cast(pa.string())

                def rows(parts, often):
                    n = len(often)
                    if by_hash:
                        whole = hashes[parts[0]]
                        for p in parts[1:]:
                            whole = whole * STEP + hashes[p]
                        return pa.RecordBatch.from_arrays([pa.array(keyed(whole)), pa.array(often, pa.int64())], schema=schema)
                    phrase = texts.take(pa.array(parts[0]))
                    for p in parts[1:]:
                        phrase = pc.binary_join_element_wise(phrase, texts.take(pa.array(p)), " ")
                    return pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(lang), n), pa.repeat(pa.scalar(len(parts), pa.int32()), n), phrase,
                         pa.array(often, pa.int64())], schema=schema)

                if words:
                    often = np.bincount(c[skip:], minlength=len(names))
                    often[0] = 0
                    there = np.nonzero(often)[0]
                    yield rows([there], often[there])
                if single:
                    now = has(single[0], hashes)
                    now[0] = False
                    begin = max(0, skip - 1)
                    a, b = c[begin:-1], c[begin + 1:]
                    ok = now[a] & now[b]
                    if single[1] is not None:
                        old = has(single[1], hashes)
                        ok &= ~(old[a] & old[b])
                    a, b = a[ok], b[ok]
                    if keep is not None:
                        ok = has(keep, hashes[a] * STEP + hashes[b])
                        a, b = a[ok], b[ok]
                    if len(a):
                        yield rows(*distinct([a, b], len(names)))
                if pair and len(c) > 2:
                    begin = max(0, skip - 2)
                    real = c > 0
                    whole = hashes[c[begin:-1]] * STEP + hashes[c[begin + 1:]]
                    both = real[begin:-1] & real[begin + 1:]
                    now = has(pair[0], whole) & both
                    ok = now[:-1] & now[1:]
                    if pair[1] is not None:
                        old = has(pair[1], whole) & both
                        ok &= ~(old[:-1] & old[1:])
                    at = np.nonzero(ok)[0] + begin
                    if keep is not None:
                        at = at[has(keep, whole[at - begin] * STEP + hashes[c[at + 2]])]
                    if len(at):
                        yield rows(*distinct([c[at], c[at + 1], c[at + 2]], len(names)))

    found = stored.select("lang", "vocabulary", "codes", "skip").mapInArrow(run, ddl)
    return found.groupBy(*[c for c in found.columns if c != "f"]).agg(F.sum("f").alias("f"))


def frequent_phrases(stored: DataFrame, support: int = 10, part: int = 4, lower: float = 0.8) -> DataFrame:
    """(lang, size, phrase, f) of every phrase of one to three words that occurs ``support`` times or more.

    One segment in ``part``, by a hash of its content, is the sample; its threshold is the ``lower`` part of what the
    support would be there, two at least. Sample and threshold change the number of passes, never the result.
    """
    sample = stored.where(F.pmod(F.xxhash64("codes"), F.lit(part)) == 0)
    least = F.col("f") >= max(2, int(support * lower / part))
    enough = F.col("f") >= support

    def count_all(words, single, pair):
        keep = bitmap(counted(stored, single=single, pair=pair, by_hash=True).where(enough))
        return cut(counted(stored, words, single, pair, keep).where(enough))

    single = bitmap(counted(sample, words=True, by_hash=True).where(least))
    pair = bitmap(counted(sample, single=(single, None), by_hash=True).where(least))
    known = count_all(True, (single, None), (pair, None))
    out = known
    while True:
        more_single = single | bitmap(hashed(known.where("size = 1")))
        more_pair = pair | bitmap(hashed(known.where("size = 2")))
        failed = [bool((a != b).any()) for a, b in ((more_single, single), (more_pair, pair))]
        if not any(failed):
            return out
        known = count_all(False, (more_single, single) if failed[0] else (), (more_pair, pair) if failed[1] else ())
        out = out.unionByName(known)
        single, pair = more_single, more_pair


# --- scores ---------------------------------------------------------------------------

def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more, by their lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("first"),
        F.array_join(F.slice(words, k + 1, F.col("size") - k), " ").alias("rest")))
    rows = (frequent.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(cuts).alias("cut"))
            .select("lang", "phrase", "size", "a", "cut.*"))
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    joined = rows.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumns(
        {"x": wide("a") * wide("a"), "y": wide("l") * wide("r")})
    # both factors of the quotient fit 38 digits while counts stay below 10^16
    score = F.expr("cast(1000000 as decimal(7,0)) * x div y")
    return (joined.withColumn("score", score).groupBy("lang", "phrase", "size", "a")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
            .select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score"))


def collocations(docs: DataFrame, support: int = 10, most: int = 2000, share: int = 50, id_salts: int = 16,
                 text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The ``most`` best phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lowered; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. ``a`` counts all occurrences of the
    phrase within pieces, ``n`` all words of the language. Each phrase is cut into two parts with counts ``l`` and ``r``
    and scores floor(10^6 a² / (l r)) at its worst cut, equal scores at the first; phrases with ``a`` below ``support`` are
    out, and so is one that lies within a longer phrase with at least ``share`` percent of its count. Ranks are by
    score, ``a`` and the bytes of the phrase.

    Null and empty texts hold no words; a null language is ``und``; repeated rows count each time; an empty table gives no
    rows. Other columns are ignored. Texts may have any length: long ones become several segments.
    """
    stored = cut(encode(docs, text_column, lang_column))
    totals = stored.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = cut(frequent_phrases(stored, support))
    words = F.split("phrase", " ")
    longer = (frequent.where("size = 3").select("lang", F.col("f").alias("longer"), F.explode(F.array(
        F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    left = (scored(frequent).join(longer, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))))
    # a language may hold most phrases: each of its shares is cut to ``most`` before they meet
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = left.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(id_salts)))
    few = (salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order)))
           .where(F.col("rank") <= most))
    return (few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
            .where(F.col("rank") <= most).join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
