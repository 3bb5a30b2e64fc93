import random

import corpus_pipeline
from floodlens.llm.pii import base_spans
from floodlens.llm.quality_rules import judge
from .test_near_dedup import brute as near_groups
from .test_suffix_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage against what its operator's brute force says about the stage's own input."""
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = source, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        result = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = {r.doc_id: r for r in docs.collect()}, result.collect()
        if name != "packing":
            assert result.columns == source.columns and result.dtypes == source.dtypes
            assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source) for r in after)
        now = {r.doc_id: r for r in after}
        if name == "quality_rules":
            assert set(now) == {i for i, r in before.items() if judge(r.text)[6]} and all(now[i].text == before[i].text for i in now)
        elif name == "near_dedup":
            groups = near_groups([(i, r.text) for i, r in before.items()], corpus_pipeline.NEAR)
            assert set(now) == {i for i, (_, c) in groups.items() if c == i} and len(now) < len(before)
        elif name == "suffix_dedup":
            want = {k: bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")
                    for k, t, gone in brute(sorted((i, r.text.encode()) for i, r in before.items()))}
            assert {i: r.text for i, r in now.items()} == want
        elif name == "personal_data":
            assert set(now) == set(before) and not any(base_spans(r.text) for r in after if "<CARD>" in r.text)
            assert all(r.text == before[r.doc_id].text for r in after if not any(c.isdigit() or c == "@" for c in before[r.doc_id].text))
            assert any("<EMAIL>" in r.text or "<CARD>" in r.text for r in after)
        else:
            assert {r.doc_id for r in after} == set(before)
        docs = result
        seen.append(name)
    assert len(seen) == 5


def test_null_texts(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "word " * 80 + ".", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF)
        assert result.count() == (0 if name == "quality_rules" else 3), name
        assert stage(spark, docs.where("false"), SF).count() == 0, name


def test_near_copies(spark):
    """Copies with a similarity from 0.80 up to 0.85 go too; looser ones stay."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        base = [f"w{i}x{rng.randrange(5000)}" for _ in range(200)]
        rows.append((2 * i, " ".join(base)))
        for at in (20, 60, 100, 140, 180)[:3 + i % 3]:
            base[at] = "changed"
        rows.append((2 * i + 1, " ".join(base)))
    want = near_groups(rows, 80)
    assert {k for k, (_, c) in want.items() if c != k} == {2 * i + 1 for i in range(60) if i % 3 < 2}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect()} == {c for _, c in want.values()}
