import hashlib
import random

import numpy as np
import pytest

from floodlens.llm import suffix_dedup as sd


def brute(rows):
    """doc_id, text -> removed flags, by definition."""
    first = {}
    for key, text in rows:
        for i in range(len(text) - 49):
            s = text[i:i + 50]
            first[s] = min(first.get(s, key), key)
    out = []
    for key, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - 49):
            if first[text[i:i + 50]] < key:
                gone[i:i + 50] = b"\1" * 50
        out.append((key, text, bytes(gone)))
    return out


def check(frame, rows, **sizes):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in
                 sd.suffix_dedup(frame, **sizes).where("doc_id IS NOT NULL").collect())
    want = []
    for key, text, gone in brute(rows):
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((key, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    assert got == sorted(want)


@pytest.mark.parametrize("chunk,bucket", [(8 << 20, 16 << 20), (20_000, 40_000)])
def test_documents(docs, chunk, bucket):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect() if r.doc_id is not None]
    check(docs, rows, chunk_bytes=chunk, bucket_bytes=bucket)


def test_passages(spark, monkeypatch):
    """A passage that many documents share has many different edges; small limits make anchors common."""
    monkeypatch.setattr(sd, "COMMON", 4)
    monkeypatch.setattr(sd, "COMMON_IN_CHUNK", 2)
    rng = random.Random(5)
    letters = "abcdefgh "
    word = lambda n: "".join(rng.choices(letters, k=n))
    passage, other = word(140), word(55)
    rows = [(i, (word(rng.randrange(0, 90)) + passage[rng.randrange(0, 30):rng.randrange(90, 140)] + word(60) + other * (i % 2)).encode())
            for i in range(60)]
    rows += [(i, b"ab" * rng.randrange(20, 90)) for i in range(100, 110)]
    frame = spark.createDataFrame([(k, t.decode()) for k, t in rows], "doc_id int, text string")
    check(frame, rows, chunk_bytes=1500, bucket_bytes=3000)
    check(frame, rows)


def test_levels_merge_geometrically():
    rng = np.random.default_rng(0)
    levels, seen = sd.SuffixLevels(), {}
    for batch in range(20):
        keys = np.array([f"{x:050d}" for x in rng.integers(0, 400, 64)], "S50")
        docs = np.full(len(keys), batch)
        unique, low, _ = sd.unique_suffixes(keys, docs)
        found = levels.scan(unique)
        for k, f in zip(unique, found):
            assert f == seen.get(k, np.iinfo(np.int64).max)
        levels.add(unique, low)
        for k in unique:
            seen.setdefault(k, batch)
    sizes = [len(k) for k, _ in levels.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 6
    assert sum(sizes) >= len(seen)


def test_edges(spark, docs, no_docs):
    assert sd.suffix_dedup(no_docs).count() == 0
    assert sd.suffix_dedup(docs, carry=("lang", "chunk", "block")).select("lang", "chunk", "block").distinct().count() == 1
    nulls = sd.suffix_dedup(docs).where("doc_id IS NULL").collect()
    assert len(nulls) == 2 and all(r.n_removed == 0 for r in nulls)


def test_documents_that_begin_at_an_end(spark, monkeypatch):
    """Documents may begin where the last string of a chunk, or a stretch, ends."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n)).encode()
    passage = word(100)
    for tail in ([49], [20, 29], [48, 1]):
        rows = [(k, t) for k, t in enumerate([passage, *(word(n) for n in tail)])]
        check(spark.createDataFrame([(k, t.decode()) for k, t in rows], "doc_id int, text string"), rows)
    monkeypatch.setattr(sd, "STRETCH", 64)
    for sizes in ([64] * 6, [128, 64, 0, 64, 49], [100, 28, 0, 0, 192, 64, 49]):
        rows = [(k, (passage + word(n))[:n] if k % 2 else word(n)) for k, n in enumerate(sizes)]
        data = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
        ids = np.arange(len(rows))
        offsets = np.cumsum([0] + sizes)[:-1]
        runs = sd.Runs(data, offsets, ids)
        starts = sorted(s for b, n in zip(runs.begin.tolist(), runs.size.tolist()) for s in range(b, b + n))
        assert starts == [o + i for o, n in zip(offsets.tolist(), sizes) for i in range(n - sd.LENGTH + 1)]
        assert all(runs.doc == np.searchsorted(offsets, runs.begin, side="right") - 1)
