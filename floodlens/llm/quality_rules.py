"""Line-first quality rules.

Every line of a text is judged on its own by the rules below; lines that fail are removed, and a
document that loses too much of its text, or that fails the base counts, is rejected. One pass over
the rows, no shuffle: a document is one row, so nothing depends on how rows are distributed.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from floodlens.llm.common import map_texts, texts

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Phrases of page furniture, in the languages of the corpora.
BOILERPLATE = re.compile(
    r"\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)"
    r"|accept (?:all )?cookies|enable javascript|sign up|log ?in to|subscribe to|click here|read more|share this"
    r"|back to top|lorem ipsum|licensed under|released under the|permission is hereby granted|without warrant"
    r"|copyright (?:\(c\)|©|\d{4})|tous droits réservés|mentions légales|alle rechte vorbehalten"
    r"|datenschutzerklärung|impressum|todos los derechos reservados|política de privacidad)")
#: One of these is in every lower-case text that the pattern above matches.
STEMS = ("rights", "terms of", "polic", "cookie", "javascript", "sign up", "log in", "login", "subscribe", "click here",
         "read more", "share this", "back to", "lorem", "licensed", "released under", "hereby", "warrant", "copyright",
         "droits", "mentions l", "rechte", "datenschutz", "impressum", "derechos", "privacidad")
SEPARATORS = frozenset("|»›><•·/-–")
ENDS = ".!?…:;。！？"
SENTENCE = re.compile(r"(?<=[.!?…:;。！？])\s+")
LOWER = bytes(range(97, 123))


@dataclass(frozen=True)
class Rules:
    """Thresholds. Shares are of words of the line, or of code points in words of the text."""

    min_words: int = 50
    repeat_share: float = 0.5       # of words, in repeated windows of three
    separator_share: float = 0.25   # of a line's words
    symbol_share: float = 0.1       # of a line's characters
    shout_share: float = 0.7        # of a line's letters
    phrase_words: int = 20          # so short a line fails for one phrase of page furniture
    phrase_share: float = 0.25      # of a sentence's words, in such phrases; most words of a longer line are in such sentences
    unended_words: int = 30         # so long a line without a sentence end is a listing
    keep_share: float = 0.5         # less text left rejects the document


def is_boilerplate(line: str, rules: Rules = Rules()) -> bool:
    """Whether a line is mainly page furniture: short with a phrase of it, or made up of sentences that are."""
    line = line.lower()
    if not BOILERPLATE.search(line):
        return False
    size = len(line.split())
    if size <= rules.phrase_words:
        return True
    furniture = 0
    for sentence in SENTENCE.split(line):
        phrases, words = sum(len(m[0].split()) for m in BOILERPLATE.finditer(sentence)), len(sentence.split())
        if phrases and phrases >= rules.phrase_share * words:
            furniture += words
    return 2 * furniture > size


def line_fails(line: str, rules: Rules = Rules(), furniture: bool = True) -> str | None:
    """The rule that removes a line, or None. Lines without a word pass.

    ``furniture=False`` says that the text holds none of ``STEMS``. The cheap test before each rule only
    leaves out lines that the rule could not fail.
    """
    size = len(line)
    if furniture and is_boilerplate(line, rules):
        return "boilerplate"
    if sum(map(line.count, SEPARATORS)):
        words = line.split()
        if len(words) >= 4 and sum(w in SEPARATORS for w in words) > rules.separator_share * len(words):
            return "navigation"
    if sum(map(line.count, SYMBOLS)) > rules.symbol_share * size:
        return "symbols"
    raw = line.encode()
    if len(raw) - len(raw.translate(None, LOWER)) <= (1 - rules.shout_share) * size:
        letters = sum(map(str.isalpha, line))
        if letters and sum(map(str.isupper, line)) > rules.shout_share * letters and len(line.split()) >= 4:
            return "shouting"
    if not any(end in line for end in ENDS) and len(line.split()) >= rules.unended_words:
        return "punctuation"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    pairs = codes[:-1] * len(ids) + codes[1:]
    if len(ids) > 1 << 20:  # three codes no longer fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(ids) + codes[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:len(windows) + shift] |= twice
    return int(covered.sum())


def judge(text: str, rules: Rules = Rules()) -> tuple:
    """Counts, verdict and cleaned text of one document."""
    words = text.encode().split()  # of bytes: splits at the six ASCII white spaces only
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, WHITE))
    n_symbols = sum(map(text.count, SYMBOLS))
    repeats = repeated_words(words)
    failed = n_words < rules.min_words or repeats > rules.repeat_share * n_words
    low = text.lower()
    furniture = any(stem in low for stem in STEMS)
    seen, lines, duplicates, lost = set(), [], 0, 0
    for line in text.split("\n"):
        size = len(line) - sum(map(line.count, WHITE))
        if size == 0:
            lines.append(line)
            continue
        again = line in seen
        seen.add(line)
        duplicates += again
        if again or line_fails(line, rules, furniture):
            lost += size
        else:
            lines.append(line)
    kept = not failed and word_chars - lost >= rules.keep_share * word_chars
    return n_words, word_chars, n_symbols, duplicates, repeats, failed, kept, lost, "\n".join(lines)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_column: str = "doc_id",
                  text_column: str = "text", with_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``kept``, ``lost_chars`` and, on request, ``clean_text``.

    Columns named in ``carry`` come along.

    Null texts count as empty; texts without words fail. Rows with equal ids are judged apart, a null id stays
    null. Other columns are ignored. An empty table gives an empty result.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kind = docs.schema[id_column].dataType.simpleString()
    schema = (f"{id_column} {kind}, " + ", ".join(f"{n} bigint" for n in names)
              + ", base_failed boolean, kept boolean, lost_chars bigint" + ", clean_text string" * with_text)

    def make():
        def work(batch):
            found = [judge(t, rules)[:9 if with_text else 8] for t in texts(batch, text_column)]
            return [batch.column(0), *zip(*found)]

        return work

    return map_texts(docs, [id_column, text_column], make, schema, carry)
