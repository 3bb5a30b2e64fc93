"""Near-duplicates by bottom-k sketches of word shingles.

1. A document's set of 5-word shingles is hashed by one function; its ``k`` smallest values are the sketch. Equal sets
   form one class, and only the class goes on.
2. Inverted lists: retained values are counted over all classes. Two linked sets share most of their sketches, so a class
   with fewer than ``shared_values`` in lists of two or more cannot be linked to any other and is done.
3. The classes left are indexed in full: of their shingles that occur twice or more, the rarest come first, and only so
   many of them are listed as a linked pair must share one of. The place in that order bounds the overlap of a pair,
   which keeps the lists of a large family of loose copies from being paired off.
4. In each list the most central class is compared with the others; what links forms components. Then classes of
   different components that meet in a list are compared. A pair passes the estimate from the sketch of its union, and
   the overlap of the full sets decides.

Pairs inside a component need no further comparison, so the work does not follow the square of a group's size; no link
between different components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from floodlens.llm.common import map_texts, texts
from floodlens.llm.graph import components
from floodlens.session import cut

SHINGLE = 5
SKETCH = 64
#: The chance that linked sets share fewer values of their sketches than ``shared_values`` says.
MISS = 1e-6
#: Standard errors by which an estimate may fall short of the threshold.
SLACK = 5.0


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(several: Iterable[str]) -> list[np.ndarray]:
    """Ascending 63-bit hashes of the distinct shingles of each text.

    A-Z are lowered; words end at the six ASCII white spaces. Fewer words than a shingle form one shingle.
    """
    words = [t.encode().lower().split() for t in several]  # of bytes: only ASCII is lowered, and split at
    index: dict[bytes, int] = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for ws in words for w in ws), np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))[codes]
    step = np.uint64(0x9E3779B97F4A7C15)
    rolled = hashes[:max(0, len(hashes) - SHINGLE + 1)]
    for shift in range(1, SHINGLE):
        rolled = mix(rolled * step + hashes[shift:len(rolled) + shift])
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= SHINGLE:
            out.append(np.unique(rolled[at:at + n - SHINGLE + 1] >> np.uint64(1)).view(np.int64))
        elif n:
            whole = np.uint64(n)
            with np.errstate(over="ignore"):
                for h in hashes[at:at + n]:
                    whole = mix(whole * step + h)
            out.append(np.array([whole >> np.uint64(1)]).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at += n
    return out


def linked(left: Column, right: Column, percent: int = 85, k: int = SKETCH) -> Column:
    """Whether two ascending sets overlap enough: the sketch of their union filters, the full sets decide."""
    a, b = F.slice(left, 1, k), F.slice(right, 1, k)
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    share = percent / 100
    enough = math.floor(k * (share - SLACK * math.sqrt(share * (1 - share) / k)))
    likely = (F.size(union) < k) | (F.size(F.array_intersect(F.array_intersect(union, a), b)) >= enough)
    common = F.size(F.array_intersect(left, right))
    return likely & (common > 0) & (100 * common >= percent * (F.size(left) + F.size(right) - common))


def shared_values(percent: int, k: int = SKETCH) -> int:
    """The most of ``k`` retained values that linked sets have in common, but for a chance of ``MISS`` at the threshold."""
    share, below = percent / 100, 0.0
    for n in range(k + 1):
        below += math.comb(k, n) * share ** n * (1 - share) ** (k - n)
        if below > MISS:
            return n
    return k


def sketches(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, sign (a digest of the set; null if empty), sketch (32 bits of each retained value)."""

    def make():
        def work(batch):
            sets = shingle_sets(texts(batch, text_column))
            return [batch.column(0), [len(s) for s in sets],
                    [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    [(s[:SKETCH] & 0xFFFFFFFF).astype(np.uint32).view(np.int32) for s in sets]]

        return work

    return map_texts(docs, ["doc_id", text_column], make, "doc_id bigint, n_shingles bigint, sign binary, sketch array<int>", most=1 << 20)


def full_sets(docs: DataFrame, text_column: str = "text") -> DataFrame:
    def make():
        def work(batch):
            return [batch.column(0), shingle_sets(texts(batch, text_column))]

        return work

    return map_texts(docs, ["doc_id", text_column], make, "doc_id bigint, shingles array<bigint>", most=1 << 20)


def _rare_first(rows: DataFrame, least) -> DataFrame:
    """From (doc_id, n, v): of each document's values that others have too, the rarest first, as far as needed.

    ``least`` is the number of values, in terms of ``n``, that a linked document must share. Gives doc_id, n, m (shared
    values), list of (f, v). Documents that share fewer drop out.
    """
    often = rows.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    return (rows.join(often, "v").groupBy("doc_id").agg(F.first("n").alias("n"), F.collect_list(F.struct("f", "v")).alias("own"))
            .withColumn("m", F.size("own")).where(F.col("m") >= least)
            .select("doc_id", "n", "m", F.slice(F.array_sort("own"), 1, F.greatest(F.col("m") - least + 1, F.lit(0)).cast("int")).alias("own")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    wide = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b"))
    return wide.where(linked(F.col("left"), F.col("right"), percent)).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id that can be reached over links) and kept (its own component's id).

    Sets are linked if ``100 * intersection >= percent * union``. Texts that are null, empty or without words have no
    set and link to nothing. Rows with equal ids count as one document. Rows with a null id are kept, with a null
    component. Other columns are ignored; an empty table gives no rows.
    """
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    known = cut(sketches(named))
    filled = known.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # classes of equal sets; their smallest document stands for them
    classes = filled.groupBy("sign").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    own = filled.select("doc_id", "sign").distinct()
    classes = cut(classes)
    copies = own.join(classes.where("rep <> most").select("sign", "rep"), "sign").where("doc_id <> rep")

    values = classes.select(F.col("rep").alias("doc_id"), "n", F.explode("sketch").alias("v"))
    size = F.least(F.col("n"), F.lit(SKETCH))
    likely = _rare_first(values, F.ceil(size * shared_values(percent) / SKETCH)).select("doc_id")

    sets = cut(full_sets(named.join(likely.distinct(), "doc_id", "left_semi")).dropDuplicates(["doc_id"]))
    everything = sets.select("doc_id", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("v"))
    least = F.floor((F.col("n") * percent + 99) / 100)
    index = cut(_rare_first(everything, least)
                .select("doc_id", "n", "m", F.posexplode("own").alias("at", "own"))
                .select("doc_id", "n", "m", "at", F.col("own.v").alias("v")))

    def meets(a: str, b: str):
        """Sizes, and places of the common value, that allow enough overlap."""
        total = F.col(f"{a}.n") + F.col(f"{b}.n")
        bound = F.least(F.col(f"{a}.m") - F.col(f"{a}.at"), F.col(f"{b}.m") - F.col(f"{b}.at"))
        return bound * (100 + percent) >= total * percent

    center = index.groupBy("v").agg(F.max(F.struct((F.col("m") / F.col("n")).alias("share"), (-F.col("doc_id")).alias("low"), "n", "m", "at")).alias("c"))
    center = center.select("v", (-F.col("c.low")).alias("doc_id"), F.col("c.n").alias("n"), F.col("c.m").alias("m"), F.col("c.at").alias("at"))
    stars = (index.alias("x").join(center.alias("y"), F.col("x.v") == F.col("y.v")).where(F.col("x.doc_id") != F.col("y.doc_id"))
             .where(meets("x", "y")).groupBy(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).agg(F.count("*").alias("c"))
             .groupBy("a").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b")))
    first = cut(_verified(stars, sets, percent))
    group = components(first)
    placed = cut(index.join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                 .withColumn("component", F.coalesce("component", "doc_id")))
    mixed = placed.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("v")
    open_lists = placed.join(mixed, "v", "left_semi")
    across = (open_lists.alias("x").join(open_lists.alias("y"), F.col("x.v") == F.col("y.v"))
              .where(F.col("x.component") < F.col("y.component")).where(meets("x", "y"))
              .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct())
    second = cut(_verified(across, sets, percent))
    edges = first.unionByName(second).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = components(edges)
    return (known.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .withColumn("component_id", F.coalesce("component", "doc_id"))
            .select(F.col("doc_id").alias(id_column), "n_shingles", "component_id",
                    F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept")))
