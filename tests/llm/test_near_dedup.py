import math
import random

from floodlens.llm.graph import components
from floodlens.llm.near_dedup import linked, near_duplicates, shared_values, shingle_sets


def word_sets(text):
    words = text.encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows, percent=85):
    """doc_id -> (set size, component)."""
    parent = {k: k for k, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    sets = [(k, word_sets(t)) for k, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {k: (len(s), find(k)) for k, s in sets}


def check(frame, rows):
    want = brute(rows)
    got = near_duplicates(frame).where("doc_id IS NOT NULL").collect()
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r
    assert len(got) == len(rows)
    return want


def test_documents(docs):
    check(docs, [(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None])
    nulls = near_duplicates(docs).where("doc_id IS NULL").collect()
    assert len(nulls) == 2 and all(r.component_id is None and r.kept for r in nulls)


def test_family(spark):
    """Loose copies of one text: many pairs lie on either side of the threshold."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(5000 + i, " ".join(base[:50] + [f"u{i}v{j}" for j in range(60)])) for i in range(40)]  # share a passage only
    want = check(spark.createDataFrame(rows, "doc_id int, text string"), rows)
    assert 10 < len({c for _, c in want.values()}) < 150


def test_threshold(spark):
    sets = shingle_sets([" ".join(f"w{i}" for i in range(n)) for n in (104, 89, 88)])
    assert [len(s) for s in sets] == [100, 85, 84]
    rows = spark.createDataFrame([(sets[0].tolist(), s.tolist()) for s in sets] + [([], [])], "a array<long>, b array<long>")
    assert [r[0] for r in rows.select(linked(rows.a, rows.b)).collect()] == [True, True, False, False]
    assert shingle_sets(["", "A b", "a B", "É"])[1].tolist() == shingle_sets(["a b"])[0].tolist()


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_empty(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_shared_values():
    """Sets at the threshold share fewer retained values with a chance below one in a million."""
    assert [shared_values(p) for p in (80, 85, 100)] == [34, 39, 64]
    for percent in (50, 80, 85, 95):
        p, n = percent / 100, shared_values(percent)
        chance = [sum(math.comb(64, i) * p ** i * (1 - p) ** (64 - i) for i in range(m)) for m in (n, n + 1)]
        assert chance[0] <= 1e-6 < chance[1]
