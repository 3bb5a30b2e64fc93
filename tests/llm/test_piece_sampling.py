import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from floodlens.llm.piece_sampling import Vocabulary, decode_pieces, sample, sample_pieces

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


def segmentations(vocabulary, text):
    """Every segmentation of a text into pieces with its weight."""
    weights = {}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    plain = [i for i in range(32000) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    for rank, i in enumerate(plain, 1):
        weights[vocabulary.bytes[i].decode()] = (i, 1 / (rank + 1))

    def ways(rest):
        if not rest:
            yield (), 1.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in weights:
                i, w = weights[rest[:n]]
                for more, v in ways(rest[n:]):
                    yield (i, *more), w * v

    return dict(ways(text))


def test_distribution(vocabulary):
    """Frequencies of sampled segmentations against the product of weights, by a chi-square bound."""
    for text in ("the tion", "eren"):
        exact = segmentations(vocabulary, text)
        total, n = sum(exact.values()), 20_000
        seen = Counter(tuple(ids.tolist()) for ids in sample(vocabulary, [text] * n, np.arange(n).astype(np.uint64)))
        assert set(seen) <= set(exact)
        large = {k: v / total * n for k, v in exact.items() if v / total * n > 20}
        chi = sum((seen[k] - v) ** 2 / v for k, v in large.items())
        assert len(large) > 1 and chi < len(large) + 5 * math.sqrt(2 * len(large))


def test_documents(spark, docs, no_docs):
    got = sample_pieces(docs, PATH).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count() and all(r.lossless and r.n_pieces == len(r.ids) for r in got)
    again = {(r.doc_id, tuple(r.ids)) for r in sample_pieces(docs.repartition(2), PATH).collect()}
    assert again == {(r.doc_id, tuple(r.ids)) for r in got}
    other = {(r.doc_id, tuple(r.ids)) for r in sample_pieces(docs, PATH, draw=1).collect()}
    assert other != again
    back = decode_pieces(sample_pieces(docs.where("doc_id IS NOT NULL"), PATH), PATH).collect()
    assert all(r.text == (texts[r.doc_id] or "") for r in back)
    assert sample_pieces(no_docs, PATH).count() == 0


def test_long_words(vocabulary):
    text = "漢" * 3000 + "x" * 3000 + " ▁▁\n\n  "
    assert vocabulary.decode(sample(vocabulary, [text, ""], np.array([1, 2], np.uint64))[0].tolist()) == text
