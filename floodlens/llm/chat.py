"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, encoded once with character offsets, and the tokens to learn from are found by
binary search between the sorted spans of assistant turns and the sorted token spans.

Template: ``<|turn|>role<|says|>text<|done|>`` for each turn, without anything between turns. The three marks are
tokens of their own, so that no token reaches across an edge of a text. Marks of this and of other common templates
inside a text or role are broken up by a backslash behind their first character, backslashes are doubled; that can be
undone exactly.

A very long conversation is rendered in blocks of turns, in parallel; its digests are taken by one task that streams
over the blocks in order and never holds more than a batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from floodlens.llm.common import arrow_schema

TURN, SAYS, DONE = MARKS = "<|turn|>", "<|says|>", "<|done|>"
#: Control strings of this and other templates and vocabularies.
CONTROL = re.compile(r"<\|(?=\w+\|>)|<(?=/?s>)|\[(?=/?INST\])|<(?=</?SYS>>)|<(?=unk>|pad>)|<(?=(?:start|end)_of_turn>)")
LEARNT_ROLE = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Undo ``escape``: a backslash goes, what follows it stays."""
    return re.sub(r"\\(.?)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


class Rendered(NamedTuple):
    text: str
    roles: list[str]
    spans: np.ndarray  # start and end of each turn's (escaped) text, in order


def render(turns: list[tuple[str, str]]) -> Rendered:
    parts, roles, spans, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        roles.append(role)
        parts += [head, body, DONE]
        at = spans[-1][1] + len(DONE)
    return Rendered("".join(parts), roles, np.array(spans, np.int64).reshape(-1, 2))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from the output alone."""
    turns = []
    for part in formatted.split(DONE)[:-1]:
        role, _, text = part.removeprefix(TURN).partition(SAYS)
        turns.append((unescape(role), unescape(text)))
    return turns


def loss_mask(tokens: np.ndarray, spans: np.ndarray, learnt: np.ndarray) -> np.ndarray:
    """For each token span, whether it lies in the text of a learnt turn.

    Both lists are sorted; for every token a binary search finds the only turn that can hold it.
    """
    if not len(spans):
        return np.zeros(len(tokens), bool)
    turn = np.searchsorted(spans[:, 0], tokens[:, 0], side="right") - 1
    inside = (turn >= 0) & (tokens[:, 1] <= spans[turn, 1]) & (tokens[:, 1] > tokens[:, 0])
    return inside & learnt[turn]


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Sorted token spans as maximal runs; tokens may share a character that takes several of them."""
    if not len(spans):
        return []
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.append(True, spans[1:, 0] > reach[:-1])
    last = np.append(first[1:], True)
    return list(zip(spans[first, 0].tolist(), reach[last].tolist()))


class Encoder:
    """A byte-level tokenizer with the marks as tokens and offsets that keep white space."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens([AddedToken(m, normalized=False) for m in MARKS])
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return found.ids, np.array(found.offsets, np.int64).reshape(-1, 2)


def format_chat(turns: DataFrame, tokenizer: str | Callable[[], str], block_turns: int = 256) -> DataFrame:
    """Formatted blocks: conv_id, block, text, ids, mask, loss_spans (pairs of code points within ``text``).

    Turns are ordered by ``turn`` (null first), ties by role and text, so that the result does not depend on the order
    of rows; repeated rows are repeated turns. Null roles and texts count as empty, other columns are ignored, a null
    conv_id is a conversation of its own. Blocks hold the turns of a stretch of ``block_turns`` turn numbers.
    """
    schema = "conv_id bigint, block bigint, text string, ids array<int>, mask array<boolean>, loss_spans array<bigint>"
    target = arrow_schema(schema)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))).cast("long"))
    cache: dict = {}

    def work(group: pa.Table) -> pa.Table:
        encoder = cache.get("encoder")
        if encoder is None:
            encoder = cache["encoder"] = Encoder(tokenizer() if callable(tokenizer) else tokenizer)
        order = sorted(zip(group["turn"].to_pylist(), group["role"].to_pylist(), group["text"].to_pylist()),
                       key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        made = render([r[1:] for r in order])
        ids, tokens = encoder.encode(made.text)
        mask = loss_mask(tokens, made.spans, np.array([r == LEARNT_ROLE for r in made.roles]))
        spans = np.array(merged(tokens[mask]), np.int64).ravel()
        return pa.table([pa.array([v], f.type) for v, f in zip(
            (group["conv_id"][0].as_py(), group["block"][0].as_py(), made.text, ids, mask, spans), target)], schema=target)

    return rows.groupBy("conv_id", "block").applyInArrow(work, schema)


def read_back(blocks: DataFrame) -> DataFrame:
    """Digests of what the formatted blocks and masks of each conversation say; one row per conv_id.

    Blocks of a conversation are streamed in order, so memory does not grow with its length.
    """
    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint")
    target = arrow_schema(schema)
    ordered = (blocks.select("conv_id", "block", "text", "loss_spans").repartition("conv_id")
               .sortWithinPartitions("conv_id", "block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, state = [], object(), None

        def close():
            if state is not None:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_spans"))):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for begin, end in zip(spans[::2], spans[1::2]):
                    said = unescape(text[begin:end])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), target)], schema=target)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), target)], schema=target)

    return ordered.mapInArrow(run, schema)
