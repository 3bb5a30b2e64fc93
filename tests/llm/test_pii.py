import hashlib
import re

import numpy as np
import pytest

from floodlens.llm.pii import KINDS, base_spans, find_spans, luhn, mask, personal_data, train_tagger, training_windows
from floodlens.llm.tagger import Tagger

#: The base patterns as they are defined, without any of the shortcuts.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = ["", "mail a.b@c-d.org, x@y and @z.com a@b.com_x@c.org a@b@c.de q@-.-", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.4 1.2.3 00000.0.0.0",
         "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 1111 1111 12345678901234567890", "+1 (415) 555-2671 +49 30 123456 +1 +12 34 ++1234567 8- +123 (4) 5",
         "é@b.com ü.a@b.com\n+4 9\t3", "7" * 500 + ".1.1.1", "a" * 300 + "@b.c", "a@b.c." + "d." * 200, "5105105105105100 5105105105105100"]


def brute(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text):
            numbers = [int(c) for c in m[0] if c.isdigit()]
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) \
                    or (kind == "card" and 16 <= len(numbers) <= 19 and luhn(numbers)) or (kind == "phone" and 8 <= len(numbers) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_patterns():
    rng = np.random.default_rng(0)
    fuzz = ["".join(rng.choice(list("01239+.-@ ()ab%_\n"), rng.integers(5, 60))) for _ in range(3000)]
    for text in TEXTS + fuzz:
        assert base_spans(text) == brute(text), text
    assert luhn([int(c) for c in "4111111111111111"]) and not luhn([int(c) for c in "4111111111111112"])


def test_long_runs_stay_linear():
    for text in ("9" * 300_000, "9." * 150_000, "a@" * 100_000, "+1" + " " * 200_000, "9 " * 150_000):
        base_spans(text)


def test_gradients():
    """Gradients of the network and the CRF against differences."""
    rng = np.random.default_rng(0)
    tagger = Tagger(5, hidden=4, embedding=3, window=9)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    codes, gold = rng.integers(0, 30, (3, 9)), rng.integers(0, 5, (3, 9))
    _, grad = tagger.gradients(codes, gold)
    for name, values in tagger.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in values.shape)
            old, sides = values[at], []
            for step in (1e-3, -1e-3):
                values[at] = old + step
                sides.append(tagger.gradients(codes, gold)[0])
            values[at] = old
            assert abs((sides[0] - sides[1]) / 2e-3 - grad[name][at]) < 1e-3


def test_best_path_is_the_best():
    rng = np.random.default_rng(1)
    tagger = Tagger(3, window=4)
    tagger.p["move"], tagger.p["begin"] = rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    scores = rng.normal(0, 1, (6, 5, 3))
    lengths = np.array([5, 4, 3, 2, 1, 5])
    for row, path in enumerate(tagger.best_paths(scores, lengths)):
        n = lengths[row]
        value = lambda p: tagger.p["begin"][p[0]] + sum(scores[row, t, p[t]] for t in range(n)) + sum(tagger.p["move"][a, b] for a, b in zip(p, p[1:]))
        assert abs(max(value(p) for p in __import__("itertools").product(range(3), repeat=int(n))) - value(path[:n].tolist())) < 1e-9


@pytest.fixture(scope="module")
def tagger(spark):
    return train_tagger(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_held_out_accuracy(spark, tagger):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 9000").collect()]
    codes, gold = training_windows([t[:2000] for t in texts[:200]], tagger.window, 1500, seed=99)
    path = np.array(tagger.tag(list(codes)))
    assert (path == gold).mean() > 0.98 and (path == gold)[gold > 0].mean() > 0.95
    # other spellings are found, clean text is left alone
    found = find_spans(["Write to john.smith [at] example [dot] org now, or call (415) 555-2671 please.", "Nothing here, 12 of 300 at 10:45."], tagger)
    assert [s[0] for s in found[0][1]] == ["email", "phone"] and found[1] == ([], [])
    clean = [t for t in texts if not any(c.isdigit() or c == "@" for c in t)]
    assert len(clean) > 100 and all(f == ([], []) for f in find_spans(clean, tagger))


def test_documents(spark, docs, no_docs, tagger):
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(900 + i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string"))
    got = personal_data(frame, tagger, masked=True).join(frame, "doc_id").collect()
    for r in got:
        base = brute(r.text or "")
        written = ",".join(f"{k}:{b}:{e}" for k, b, e in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(written.split(",")) - {""} <= set(r.spans.split(","))
        assert len(r.spans.split(",")) - (r.spans == "") == len(base) + r.n_added
    assert personal_data(docs, tagger).count() == docs.count() and personal_data(no_docs, tagger).count() == 0
    assert mask("a x@y.de b", [("email", 2, 8)]) == "a <EMAIL> b"
    assert train_tagger(no_docs, steps=2, examples=50) is not None
