import re
from collections import Counter

from floodlens.llm.quality_rules import line_fails, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(repeated), len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def test_counts(docs):
    got = quality_rules(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(got) > 80
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text or "")
        assert not (r.base_failed and r.kept)
    assert quality_rules(docs).count() == docs.count()


def test_lines():
    good = "The quick brown fox jumps over the lazy dog."
    assert line_fails(good) is None and line_fails("") is None and line_fails("É à la carte") is None
    assert line_fails("Home | News | About | Contact | Help") == "navigation"
    assert line_fails("All Rights Reserved.") == "boilerplate"
    assert line_fails("one### two*** three$$$ four") == "symbols"
    assert line_fails("THIS IS VERY LOUD INDEED") == "shouting"
    assert line_fails("word " * 40) == "punctuation"
    assert line_fails("We share one thing.") is None


def test_losing_text(spark):
    # words of their own, so that no three of them come again
    clean = "\n".join(" ".join(f"word{i}x{k}" for k in range(8)).capitalize() + "." for i in range(12))
    junk = "\n".join(f"Home {i} | News {i} | Help {i} | More {i}" for i in range(40))
    rows = [(1, clean), (2, clean + "\n" + junk), (3, junk), (4, clean + "\nAll rights reserved."), (5, "\n".join(["A line that is said again and again here."] * 40))]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id int, text string"), with_text=True).collect()}
    assert [got[i].kept for i in range(1, 6)] == [True, False, False, True, False]
    assert got[4].clean_text == clean and got[1].lost_chars == 0


def test_empty(no_docs):
    assert quality_rules(no_docs).count() == 0


PHRASES = ("all rights reserved", "terms of use", "privacy policy", "cookie settings", "accept all cookies", "enable javascript", "sign up", "log in to",
           "subscribe to", "click here", "read more", "share this", "back to top", "lorem ipsum", "licensed under", "released under the",
           "permission is hereby granted", "without warrant", "copyright 2020", "tous droits réservés", "mentions légales", "alle rechte vorbehalten",
           "datenschutzerklärung", "impressum", "todos los derechos reservados", "política de privacidad")


def test_phrases_in_long_lines(spark):
    """A phrase within clean prose fails no line, however it is placed; lines made of furniture fail at any length."""
    prose = [" ".join(f"w{i}o{k}" for k in range(14)).capitalize() + "." for i in range(30)]
    texts = []
    for phrase in PHRASES:
        assert line_fails(phrase.capitalize() + ".") == "boilerplate"
        texts.append(" ".join(prose[:15] + [f"There one could {phrase} at any time."] + prose[15:]))
        texts.append(" ".join(prose[:15] + [phrase.capitalize() + "."] + prose[15:]))
        texts.append(f"{phrase} " + " ".join(f"word{i}" for i in range(300)) + ".")
        texts.append(" ".join(prose[:3]) + "\n" + " ".join(prose[3:5] + [f"Whoever wants to {phrase} may do so."] + prose[5:7]))
    got = quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), with_text=True).collect()
    assert len(got) == len(texts) and [r for r in got if not r.kept or r.lost_chars or r.clean_text != texts[r.doc_id]] == []
    assert line_fails(" ".join(p.capitalize() + " now." for p in PHRASES)) == "boilerplate"
