"""Personal data: fixed patterns, and a character tagger for what is written around them.

The patterns decide on well-formed e-mail addresses, IP addresses, card and phone numbers. The tagger (see ``tagger``)
adds spans written differently, such as ``name [at] host [dot] org`` or a phone number without its plus sign. A tagged
span counts if, written out plainly, it satisfies its kind, and touches no pattern's span.

All of these kinds hold a digit, an at sign or a bracketed word for it. Text further than ``MARGIN`` from any of those
cannot be part of such a span and is not given to the network.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from floodlens.llm.common import map_texts, texts
from floodlens.llm.tagger import Tagger, char_codes

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot begin inside a run of digits whose head it could take along; that keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[({<] ?(?:at|dot) ?[\])}>]")
MARGIN = 48

Span = tuple[str, int, int]


def digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(number: list[int]) -> bool:
    twice = sum(2 * d - 9 * (d > 4) for d in number[-2::-2])
    return (sum(number[-1::-2]) + twice) % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from their at signs: the local part is all that stands before, up to the last match."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        match = DOMAIN.match(text, at + 1) if begin < at else None
        if match:
            found.append(("email", begin, match.end()))
            free = match.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind, then start."""
    found = emails(text) if "@" in text else []
    for m in IP.finditer(text):
        # long parts have leading zeros or are too large
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        number = digits(m[0]) if m.end() - m.start() >= 16 else []
        if 16 <= len(number) <= 19 and luhn(number):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(digits(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def plainly(kind: str, said: str) -> bool:
    """Whether a tagged span, with its brackets and blanks undone, is a span of its kind."""
    if kind == "email":
        said = re.sub(r" ?[\[({<] ?at ?[\])}>] ?| @ ?|@ ", "@", said)
        said = re.sub(r" ?[\[({<] ?dot ?[\])}>] ?", ".", said)
        return emails(said) == [("email", 0, len(said))]
    number = digits(said)
    if kind == "ip":
        said = re.sub(r" ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| \. ", ".", said)
        match = IP.fullmatch(said)
        return bool(match) and base_spans(said)[:1] == [("ip", 0, len(said))]
    if kind == "card":
        return bool(re.fullmatch(r"[0-9]{4}(?:[ ./_–-]{1,3}[0-9]{4}){3}", said)) and luhn(number)
    return bool(re.fullmatch(r"(?:00[ -]?)?(?:[0-9]{1,3}[ -])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", said)) and 8 <= len(number) <= 15


# ---------------------------------------------------------------- training examples

def _variants(rng: random.Random, word) -> tuple[str | None, str]:
    """A kind (None: nothing personal) and one way to write an example of it."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    choice = rng.random()
    if choice < 0.3:
        user, host = f"{word()}{rng.choice(['', '.', '_'])}{rng.choice([n(2), word()])}", f"{word()}{rng.choice(['', n(1)])}"
        top = rng.choice(["com", "org", "net", "de", "fr", "es", "example.com"])
        at = rng.choice(["@"] * 4 + ["[at]", " [at] ", "(at)", " (at) ", " @ "])
        dot = "." if at == "@" or rng.random() < 0.4 else rng.choice(["[dot]", " [dot] ", "(dot)", " (dot) "])
        return "email", f"{user}{at}{host}{dot}{top.replace('.', dot)}"
    if choice < 0.45:
        dot = rng.choice(["."] * 3 + ["[.]", " . ", "(.)", "[dot]", " [dot] "])
        return "ip", dot.join(str(rng.randrange(256)) for _ in range(4))
    if choice < 0.6:
        while not luhn(digits(card := n(16))):
            pass
        return "card", rng.choice(["", " ", "-", ".", "/", "_"]).join(card[i:i + 4] for i in range(0, 16, 4))
    if choice < 0.78:
        area, rest = n(3), (n(3), n(4))
        head = rng.choice(["+" + n(1) + " ", "+" + n(2) + " ", "", "00" + n(2) + " ", n(1) + "-"])
        return "phone", head + rng.choice([f"({area}) {rest[0]}-{rest[1]}", f"{area}-{rest[0]}-{rest[1]}", f"{area} {rest[0]} {rest[1]}", f"{area}.{rest[0]}.{rest[1]}"])
    hexa = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 32, 40])))
    return None, rng.choice([
        hexa, f'token = "{hexa}"', n(rng.randrange(1, 9)), f"{n(2)}.{n(2)}", f"v{n(1)}.{n(1)}.{n(2)}", f"20{n(2)}-0{n(1)}-1{n(1)}",
        f"1{n(1)}:{n(2)}", f"${n(2)},{n(3)}.{n(2)}", f"{word()}[{n(1)}]", f"({word()})", f"@{word()}", f"{n(3)} {word()} {n(4)}", f"{word()} at {word()}",
        f"{n(1)}.{n(1)}.{n(1)}", f"ISBN {n(3)}-{n(1)}-{n(5)}-{n(3)}-{n(1)}"])


def training_windows(contexts: list[str], window: int, examples: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of text with labelled spans: the pattern spans of the contexts, and examples put between their words."""
    rng = random.Random(seed)
    words = [w for c in contexts for w in c.split()] or ["the", "of", "and", "to", "in", "is", "that", "for"]
    plain = [re.sub(r"\W", "", w).lower() for w in words]
    plain = [w for w in plain if w.isascii() and w.isalpha()] or ["name", "host", "mail"]
    pieces: list[tuple[str, list[Span]]] = []
    for text in contexts:
        found = base_spans(text)
        for kind, begin, end in found:
            start = max(0, begin - rng.randrange(8, window // 2))
            stop = start + 2 * window
            pieces.append((text[start:stop], [(k, b - start, e - start) for k, b, e in found if b >= start and e <= stop]))
    rng.shuffle(pieces)
    pieces = pieces[:examples // 4]
    while len(pieces) < examples:
        kind, said = _variants(rng, lambda: rng.choice(plain))
        head = " ".join(rng.choices(words, k=rng.randrange(0, 9)))
        head += rng.choice([" ", " ", ": ", " <", ", "]) if head else ""
        tail = rng.choice([" ", ". ", ", ", "> ", ".\n", " | "]) + " ".join(rng.choices(words, k=8))
        pieces.append((head + said + tail, [(kind, len(head), len(head) + len(said))] if kind else []))
    codes = np.full((len(pieces), window), char_codes(" ")[0], np.int64)
    gold = np.zeros((len(pieces), window), np.int64)
    for row, (text, spans) in enumerate(pieces):
        shift = max(0, len(text) - window) and rng.randrange(0, max(1, min(len(text) - window, spans[0][1] if spans else 1) + 1))
        part = char_codes(text)[shift:shift + window]
        codes[row, :len(part)] = part
        for kind, begin, end in spans:
            tag, begin, end = 1 + 2 * KINDS.index(kind), begin - shift, end - shift
            if begin < window and end > 0:
                gold[row, max(0, begin):min(window, end)] = tag + 1
                if begin >= 0:
                    gold[row, begin] = tag
    return codes, gold


def train_tagger(docs: DataFrame, text_column: str = "text", sample_rows: int = 300, sample_chars: int = 2000,
                 examples: int = 4000, steps: int = 400) -> Tagger:
    """A tagger trained on windows around the pattern spans of at most ``sample_rows`` texts and on generated examples.

    The sample is the rows with the smallest hashes; ``sample_chars`` bounds what of each text reaches the driver. It
    only provides training windows: every whole text is searched.
    """
    rows = docs.where(F.col(text_column).isNotNull())
    # hashes are even over 64 bits: a bound leaves a few times the sample, so that tasks send little to the driver
    bound = min((1 << 63) - 1, -(1 << 63) + 4 * sample_rows * (1 << 64) // max(1, rows.count()))
    sample = (rows.select(F.xxhash64(text_column).alias("h"), F.substring(text_column, 1, sample_chars).alias("t"))
              .where(F.col("h") <= bound).orderBy("h", "t").limit(sample_rows).collect())
    tagger = Tagger(1 + 2 * len(KINDS))
    codes, gold = training_windows([r["t"] for r in sample], tagger.window, examples)
    tagger.fit(codes, gold, steps)
    return tagger


# ---------------------------------------------------------------- detection

def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text that the network reads: ``MARGIN`` around every trigger, merged where they meet."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        begin, end = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and begin <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]


def tagged_spans(path: np.ndarray) -> list[Span]:
    """Runs of one kind in a path of tags."""
    kind = (path + 1) // 2
    cut = np.nonzero((kind[1:] != kind[:-1]) | ((path[1:] % 2 == 1) & (path[1:] > 0)))[0] + 1
    edges = [0, *cut.tolist(), len(path)]
    return [(KINDS[kind[b] - 1], b, e) for b, e in zip(edges, edges[1:]) if kind[b]]


def find_spans(several: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text."""
    parts = [(k, b, e) for k, t in enumerate(several) for b, e in stretches(t)]
    codes: dict[int, np.ndarray] = {k: char_codes(several[k]) for k in {p[0] for p in parts}}
    paths = tagger.tag([codes[k][b:e] for k, b, e in parts])
    base = [base_spans(t) for t in several]
    added: list[list[Span]] = [[] for _ in several]
    for (k, begin, _), path in zip(parts, paths):
        for kind, b, e in tagged_spans(path):
            said = several[k][begin + b:begin + e]
            b += begin + len(said) - len(said.lstrip(" \n.,:;<>|\"'"))
            e = begin + e - (len(said) - len(said.rstrip(" \n.,:;<>|\"'")))
            if b < e and all(e <= x or y <= b for _, x, y in base[k]) and plainly(kind, several[k][b:e]):
                added[k].append((kind, b, e))
    return list(zip(base, added))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def personal_data(docs: DataFrame, tagger: Tagger, id_column: str = "doc_id", text_column: str = "text",
                  masked: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: counts and digest of the pattern spans, all spans, and the number of added ones.

    Null and empty texts have no spans; a text is searched as a whole however long it is. Rows with equal ids are
    searched apart, a null id stays null, other columns are ignored. ``masked`` adds the text with every span replaced
    by its kind in angle brackets. Columns named in ``carry`` come along.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = (f"{id_column} {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
              + ", base_sha256 string, spans string, n_added bigint" + ", masked_text string" * masked)
    frozen = docs.sparkSession.sparkContext.broadcast(pickle.dumps(tagger))  # a few thousand weights

    def make():
        own = pickle.loads(frozen.value)

        def work(batch):
            several = texts(batch, text_column)
            rows = []
            for text, (base, added) in zip(several, find_spans(several, own)):
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                row = [*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added), len(added)]
                rows.append(row + [mask(text, base + added)] * masked)
            return [batch.column(0), *zip(*rows)]

        return work

    return map_texts(docs, [id_column, text_column], make, schema, carry)


def mask(text: str, spans: list[Span]) -> str:
    """Replace spans by ``<KIND>``; overlapping ones together, by the kind of the first."""
    out, at = [], 0
    for kind, begin, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= at:
            out += [text[at:begin], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]
