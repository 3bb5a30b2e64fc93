"""Sampled SentencePiece segmentations: forward filtering, backward sampling.

The pieces of a vocabulary that match inside a text form a lattice. Each piece has a weight; a segmentation's
probability is proportional to the product of its pieces' weights, to the power ``theta``. Forward filtering sums the
weights of all ways to reach each position; going backward from the end, pieces are drawn with the probabilities
that those sums give, so that whole segmentations are exact samples. Draws come from a hash of the row's key and the
position, hence the same row always gets the same segmentation, wherever it is processed.

No piece goes on after a blank that follows another character, nor over a line feed, so the lattice of a text is the
chain of the lattices of its words. Those are filtered once per distinct word of a batch; filtering and sampling step
through all words of the batch at once.

Decoding is the concatenation of the pieces' bytes and gives the text back exactly: no prefix is added and nothing
is normalised; characters without a piece, and the vocabulary's own blank sign, are spelt in byte pieces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from floodlens.llm.common import map_texts, texts

BLANK = "▁"
WORDS = re.compile(r"\n| *[^ \n]+| +")
#: A byte piece weighs this share of the rarest piece.
BYTE_SHARE = 1e-3


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes: every input bit changes half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Pieces of a SentencePiece file as bytes, and as a trie over code points in sorted arrays."""

    def __init__(self, path: str, theta: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        plain = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                text = piece.replace(BLANK, " ")
                if "\n" in text or " " in text.lstrip(" "):
                    raise ValueError(f"piece {i} crosses words")
                self.bytes.append(text.encode())
                plain.append((i, text))
        # the file orders pieces by merge rank, not by probability: weights follow Zipf's law in that rank
        self.byte_weight = theta * (math.log(BYTE_SHARE) - math.log(len(plain) + 1))
        children: dict[tuple[int, int], int] = {}
        piece_of, weight = [-1], [0.0]
        for rank, (i, text) in enumerate(plain, 1):
            node = 0
            for ch in text:
                key = (node, ord(ch))
                if key not in children:
                    children[key] = len(piece_of)
                    piece_of.append(-1)
                    weight.append(0.0)
                node = children[key]
            piece_of[node], weight[node] = i, -theta * math.log(rank + 1)
        keys = np.array([node << 21 | ch for node, ch in children], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(children.values()), np.int64)[order]
        self.piece_of, self.weight = np.array(piece_of, np.int64), np.array(weight)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()

    def step(self, node: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which walks go on in the trie, and to which nodes."""
        key = node << 21 | chars
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = np.nonzero(self.keys[place] == key)[0]
        return ok, self.child[place[ok]]


class Lattices:
    """Filtered lattices of many words, flat.

    Position ``j`` of word ``w`` is node ``first[w] + j``. ``ends`` holds, for the edges sorted by the node where they
    end, the node number plus the cumulated probability; as that ascends over the whole table, one binary search
    draws an edge for any number of nodes.
    """

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        start = np.cumsum(sizes) - sizes
        self.first = start + np.arange(len(words))
        left = np.repeat(start + sizes, sizes) - np.arange(len(chars))  # characters up to the end of the word
        begins, codes, lengths, weights = [], [], [], []
        alive, node, depth = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        single = np.zeros(len(chars), bool)
        while len(alive):
            ok, node = vocabulary.step(node, chars[alive + depth])
            alive, depth = alive[ok], depth + 1
            piece = vocabulary.piece_of[node]
            hit = np.nonzero(piece >= 0)[0]
            begins.append(alive[hit])
            codes.append(piece[hit])
            weights.append(vocabulary.weight[node[hit]])
            lengths.append(np.full(len(hit), depth))
            if depth == 1:
                single[alive[hit]] = True
            more = left[alive] > depth
            alive, node = alive[more], node[more]
        # characters without a piece of their own are spelt in bytes: one edge, coded by -1 - character
        spelt = np.nonzero(~single)[0]
        begins.append(spelt)
        codes.append(-1 - chars[spelt])
        lengths.append(np.ones(len(spelt), np.int64))
        weights.append(vocabulary.byte_weight * (1 + (chars[spelt] > 0x7F) + (chars[spelt] > 0x7FF) + (chars[spelt] > 0xFFFF)))
        begin, length, weight = np.concatenate(begins), np.concatenate(lengths), np.concatenate(weights)
        order = np.argsort(begin + length + word[begin], kind="stable")
        begin, length, weight = begin[order], length[order], weight[order]
        self.code = np.concatenate(codes)[order]
        self.back = begin - start[word[begin]]                  # position in the word where the edge begins
        source = begin + word[begin]
        target = source + length
        new = np.append(True, target[1:] != target[:-1]) if len(target) else np.zeros(0, bool)
        heads = np.nonzero(new)[0]                              # first edge of each node
        reach = np.zeros(len(chars) + len(words))               # logarithm of the sum over all ways
        # positions of all words in step: edges into position j need only earlier positions
        position = (self.back + length)[heads]
        by_position = np.argsort(position, kind="stable")
        many = np.diff(np.append(heads, len(target)))
        at = 0
        for count in np.bincount(position)[1:] if len(position) else ():
            group = by_position[at:at + count]
            at += count
            size = many[group]
            offset = np.cumsum(size) - size
            edges = np.repeat(heads[group] - offset, size) + np.arange(size.sum())
            value = reach[source[edges]] + weight[edges]
            most = np.maximum.reduceat(value, offset)
            total = np.add.reduceat(np.exp(value - np.repeat(most, size)), offset)
            reach[target[heads[group]]] = most + np.log(total)
        chance = np.exp(reach[source] + weight - reach[target])
        summed = np.cumsum(chance)
        within = summed - np.repeat((summed - chance)[heads], many)
        self.ends = target + np.minimum(within, 1.0)
        self.ends[np.append(heads[1:], len(target)) - 1] = target[heads] + 1.0


def sample(vocabulary: Vocabulary, several: list[str], seeds: np.ndarray) -> list[np.ndarray]:
    """Ids of one sampled segmentation of each text."""
    words = [WORDS.findall(t) for t in several]
    index: dict[str, int] = {}
    chain = np.fromiter((index.setdefault(x, len(index)) for w in words for x in w), np.int64)
    if not len(chain):
        return [np.zeros(0, np.int32) for _ in several]
    lattices = Lattices(vocabulary, list(index))
    counts = np.array([len(w) for w in words])
    base = lattices.first[chain]
    at = np.fromiter(map(len, index), np.int64, len(index))[chain]
    owner = np.repeat(np.arange(len(words)), counts)
    sizes = np.bincount(owner, at, len(words)).astype(np.int64)
    begin = np.cumsum(at) - at - np.repeat(np.cumsum(sizes) - sizes, counts)  # position of the word in its text
    seed = seeds.astype(np.uint64)[owner]
    live, steps = np.arange(len(chain)), []
    while len(live):
        position = (begin[live] + at[live]).astype(np.uint64)
        u = (mix(seed[live] + position * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0 ** -53
        edge = np.searchsorted(lattices.ends, base[live] + at[live] + u, side="right")
        steps.append((live, edge))
        at[live] = lattices.back[edge]
        live = live[at[live] > 0]
    # a word's pieces were drawn from its end: restore the order, then spell byte edges out
    word = np.concatenate([w for w, _ in steps])
    drawn = np.bincount(word, minlength=len(chain))
    turn = np.repeat(np.arange(len(steps)), [len(w) for w, _ in steps])
    codes = np.empty(len(word), np.int64)
    codes[np.cumsum(drawn)[word] - 1 - turn] = lattices.code[np.concatenate([e for _, e in steps])]
    text = np.repeat(owner, drawn)
    spelt = np.nonzero(codes < 0)[0]
    if len(spelt):
        raw = [chr(-1 - c).encode() for c in codes[spelt].tolist()]
        many = np.ones(len(codes), np.int64)
        many[spelt] = [len(r) for r in raw]
        first = np.cumsum(many) - many
        codes, text = np.repeat(codes, many), np.repeat(text, many)
        for place, r in zip(first[spelt].tolist(), raw):
            codes[place:place + len(r)] = [vocabulary.byte_ids[b] for b in r]
    return np.split(codes.astype(np.int32), np.cumsum(np.bincount(text, minlength=len(words)))[:-1])


_LOADED: dict = {}


def load(path: str, theta: float = 1.0) -> Vocabulary:
    """The worker's vocabulary; reused workers keep it."""
    if (path, theta) not in _LOADED:
        _LOADED[path, theta] = Vocabulary(path, theta)
    return _LOADED[path, theta]


def sample_pieces(docs: DataFrame, model: str | Callable[[], str], theta: float = 1.0, draw: int = 0,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One sampled segmentation per row: id, n_pieces, ids, lossless (decoding gave the text back).

    ``draw`` numbers independent samples of the same row. Null texts are empty and have no pieces; rows with equal keys
    and texts get equal samples; a null key is a key like others; other columns are ignored. Of a very long text the
    words are treated like those of any other; a single very long word takes memory in proportion to its length.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    keyed = docs.select(id_column, F.xxhash64(id_column, F.lit(draw)).alias("__seed"), text_column)

    def make():
        vocabulary = load(model() if callable(model) else model, theta)

        def work(batch):
            several = texts(batch, text_column)
            found = sample(vocabulary, several, batch.column(1).to_numpy(zero_copy_only=False))
            lengths = [len(f) for f in found]
            offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
            values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32())
            lossless = [vocabulary.decode(f.tolist()) == t for f, t in zip(found, several)]
            return [batch.column(0), lengths, pa.ListArray.from_arrays(offsets, values), lossless]

        return work

    return map_texts(keyed, [id_column, "__seed", text_column], make,
                     f"{id_column} {kind}, n_pieces bigint, ids array<int>, lossless boolean")


def decode_pieces(rows: DataFrame, model: str | Callable[[], str], id_column: str = "doc_id") -> DataFrame:
    """Texts from ids, the inverse of ``sample_pieces``; null ids give a null text."""
    kind = rows.schema[id_column].dataType.simpleString()
    narrow = rows.select(id_column, "ids")

    def run(batches):
        vocabulary = load(model() if callable(model) else model)
        for batch in batches:
            found = [None if ids is None else vocabulary.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[id_column, "text"])

    return narrow.mapInArrow(run, f"{id_column} {kind}, text string")
