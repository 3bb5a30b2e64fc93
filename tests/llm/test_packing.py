import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from floodlens.llm.packing import WordEncoder, best_fit_packing, plan_patterns

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids(tokenizer, docs):
    several = [r.text or "" for r in docs.collect()] + ["<|startoftext|> a<|endoftext|>b I'LL don't !'s 'S É́ x²½ ٣", "'ve'll''re\x85a\tb\x1c"]
    for text, ids in zip(several, WordEncoder(PATH).encode(several)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("limit", [4096, 16])
def test_pieces_and_places(tokenizer, docs, limit):
    got = best_fit_packing(docs, PATH, limit).collect()
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        want += [(r.doc_id, p, s, len(ids[s:s + limit]), zlib.crc32(np.array(ids[s:s + limit], "<u4").tobytes()))
                 for p, s in enumerate(range(0, len(ids), limit))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    total = sum(r.length for r in got)
    assert len(by) <= total // limit + 2


def best_fit(lengths, limit):
    """Sequences that plain best-fit decreasing needs."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(limit - x)
    return len(gaps)


def test_plan():
    rng = random.Random(2)
    for limit in (10, 64, 1000):
        lengths = [rng.randrange(1, limit + 1) for _ in range(2000)]
        counts = {x: lengths.count(x) for x in set(lengths)}
        plan = plan_patterns(counts, limit)
        used = {}
        for times, pattern in plan:
            assert sum(pattern) <= limit
            for x in pattern:
                used[x] = used.get(x, 0) + times
        assert used == counts
        assert sum(t for t, _ in plan) <= best_fit(lengths, limit)
    assert plan_patterns({}, 8) == []
    # one, two and three lengths fill a gap exactly
    assert plan_patterns({6: 1, 2: 1}, 8) == [(1, (6, 2))]
    assert plan_patterns({5: 2, 1: 2, 2: 2}, 8) == [(2, (5, 2, 1))]
    assert plan_patterns({4: 1, 2: 1, 1: 2}, 8) == [(1, (4, 2, 1, 1))]


def test_empty(no_docs):
    assert best_fit_packing(no_docs, PATH).count() == 0
