import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodlens.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support=10, most=2000, share=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i:i + size])] += 1
    found = []
    for (lang, words), a in f.items():
        if len(words) < 2 or a < support:
            continue
        if any(len(w) == 3 and (w[:2] == words or w[1:] == words) and 100 * b >= share * a
               for (la, w), b in f.items() if la == lang and b >= support and len(words) == 2):
            continue
        score, k, le, r = min((1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k,
                               f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        found.append((lang, -score, -a, " ".join(words).encode(), le, r))
    out = []
    for lang in sorted({x[0] for x in found}):
        for rank, (_, s, a, p, le, r) in enumerate(sorted(x for x in found if x[0] == lang)[:most], 1):
            out.append((lang, rank, p.decode(), -a, le, r, n[lang], -s))
    return out


def corpus(seed=1, n=150):
    rng = np.random.default_rng(seed)
    names = ["The", "of", "é", "a", "New", "York", "City", "x-1", "Über", "z\x00q", "\U0001f642", "end"]
    p = 1 / np.arange(1, len(names) + 1)
    rows = []
    for i in range(n):
        words = rng.choice(names, rng.integers(0, 60), p=p / p.sum())
        gaps = rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", "\x0b"], len(words))
        rows.append((["en", "de", None][i % 3], "".join(w + g for w, g in zip(words, gaps)) + " new york city" * (i % 2)))
    rows += [("en", None), ("en", ""), ("fr", " \n\t"), (None, None), ("en", "one"), ("de", rows[1][1]), ("de", rows[1][1])]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame([(i, t, la, 1, 2, 3) for i, (la, t) in enumerate(rows)],
                                              "doc_id bigint, text string, lang string, n bigint, rank int, score int").repartition(3)


def listed(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("most", [2000, 7])
def test_against_counting(table, most):
    rows = corpus()
    got = listed(phrases.collocations(table(rows), most=most))
    assert got == sorted(brute(rows, most=most)) and len(got) > 10


def test_long_texts_in_many_segments(table, monkeypatch):
    monkeypatch.setattr(phrases, "segments", lambda data, cut=phrases.segments: cut(data, 37))
    rows = corpus(2, 60) + [("en", "word " * 500 + "w" * 900 + " the end" * 40)]
    assert listed(phrases.collocations(table(rows))) == sorted(brute(rows))


def test_nothing(table):
    assert phrases.collocations(table(corpus()).where("false")).count() == 0
    assert phrases.collocations(table([("en", None), (None, "")])).count() == 0


def test_failures_of_the_border_are_found(table, monkeypatch):
    """A sample that proposes nothing leaves everything to the expansions; the counts stay."""
    rows = corpus(3)
    stored = phrases.encode(table(rows)).persist()
    want = {(r.lang, r.phrase): r.f for r in phrases.frequent_phrases(stored, 10, part=1).collect()}
    passes = []
    plain = phrases.counted
    monkeypatch.setattr(phrases, "counted", lambda *a, **k: passes.append(1) or plain(*a, **k))
    got = {(r.lang, r.phrase): r.f for r in phrases.frequent_phrases(stored.where(F.lit(True)), 10, part=10 ** 6).collect()}
    assert got == want and len(passes) == 8  # two of the sample; then words, pairs and triples, each by hash first
    # a proposal that lets everything through changes nothing either
    full = np.full(1 << (phrases.BITS - 3), 255, np.uint8)
    every = phrases.counted(stored, True, (full, None), (full, None)).where("f >= 10")
    assert {(r.lang, r.phrase): r.f for r in every.collect()} == want
    stored.unpersist()


def test_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000
    rows = [("en", 1, "x", big), ("en", 1, "y", big + 7), ("en", 2, "x y", big - 3)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, f bigint")).first()
    assert got.score == 1000000 * (big - 3) ** 2 // (big * (big + 7))


def test_distinct_of_many_codes():
    rng = np.random.default_rng(5)
    columns = [rng.integers(0, 9, 200) for _ in range(3)]
    small, often = phrases.distinct(columns, 9)
    large, again = phrases.distinct(columns, 1 << 40)
    assert (np.array(small) == np.array(large)).all() and (often == again).all() and often.sum() == 200
