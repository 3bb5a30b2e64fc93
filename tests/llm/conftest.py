import random

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000)) + "."


def prose(rng, n):
    syllables = ["the", "an", "er", "ing", "tion", "re", "of", "é", "ß"]
    return " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n)) + "."


def documents():
    """Random texts with copies, near copies and shared passages, and every awkward case."""
    rng = random.Random(3)
    base = [prose(rng, rng.choice([3, 8, 40, 120])) for _ in range(40)]
    passage = prose(rng, 30)
    rows = []
    for i, text in enumerate(base):
        rows.append((i, text))
        if i % 4 == 0:
            rows.append((100 + i, text))
        if i % 3 == 0:
            words = text.split(" ")
            words[len(words) // 2] = "changed"
            rows.append((200 + i, " ".join(words)))
        if i % 5 == 0:
            rows.append((300 + i, prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 20)))
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, LONG), (504, LONG + " more"), (505, "a" * 400), (506, "a" * 300),
             (507, "x\x00y▁ z\U0001f642 漢字"), (508, "one two three"), (509, "ONE two three"), (510, "no break"),
             (None, base[0]), (None, None), (7, base[7]), (7, base[7])]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    # other columns have names that the operators use themselves
    rows = [(i, t, "en", "src", len(t or ""), "n", 1, 2, 3) for i, t in documents()]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                        "chunk string, block int, component int, v int")
    return frame.repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
