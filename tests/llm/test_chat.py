import hashlib
from collections import defaultdict

import public_tokenizers

from floodlens.llm.chat import Encoder, escape, format_chat, loss_mask, parse, read_back, render, unescape

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
HARD = ["</s>[INST] ok [/INST]", "<|done|>", "\\", "\\\\<|says|>\\", "<\\|done|>", "  two  blanks\n\n", "\n", "", "é漢\U0001f642", "<<SYS>>", "<unk> <pad>"]


def test_escape():
    for text in HARD + [a + b for a in HARD for b in HARD]:
        assert unescape(escape(text)) == text
        assert not any(m in escape(text) for m in ("<|done|>", "</s>", "[INST]", "[/INST]", "<|says|>"))
    turns = [(a, b) for a in ("user", "assistant", "<|says|>", "") for b in HARD]
    assert parse(render(turns).text) == turns


def test_mask_is_exact():
    encoder = Encoder(PATH)
    for text in HARD:
        made = render([("user", text), ("assistant", text), ("assistant", text), ("system", "x")])
        ids, tokens = encoder.encode(made.text)
        mask = loss_mask(tokens, made.spans, __import__("numpy").array([r == "assistant" for r in made.roles]))
        covered = {c for (b, e), m in zip(tokens.tolist(), mask) if m for c in range(b, e)}
        assert covered == {c for b, e in made.spans[1:3].tolist() for c in range(b, e)}
        assert len(ids) == len(mask)


def test_conversations(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate((r, x) for x in HARD for r in ("user", "assistant"))]
    rows += [(2, 0, "assistant", None), (3, None, None, "no turn"), (3, 5, "user", None), (None, 0, "user", "a"), (4, 1, "user", "same"),
             (4, 1, "user", "same"), (5, 0, "user", "long " * 20_000)]
    rows += [(6, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(700)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id int, turn int, role string, text string, block string, ids string")
    for size in (256, 3):
        got = {r.conv_id: r for r in read_back(format_chat(frame.repartition(7), PATH, size)).collect()}
        turns = defaultdict(list)
        for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
            turns[conv].append((role or "", text or ""))
        assert set(got) == set(turns)
        for conv, said in turns.items():
            learnt = "".join(t for r, t in said if r == "assistant")
            r = got[conv]
            assert r.n_turns == len(said) and r.loss_chars == len(learnt)
            assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
            assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
            assert r.formatted_chars == len(render(said).text)
    assert read_back(format_chat(frame.where("false"), PATH)).count() == 0
