"""The near-duplicate stage against all pairs by brute force."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from habitat_spark.llm import near_texts
from habitat_spark.llm.simhash import majority

from . import cases


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_roots(texts):
    found = [shingles(t) for t in texts]
    top = list(range(len(texts)))
    for i, x in enumerate(found):
        for j in range(i):
            if 5 * len(x & found[j]) >= 4 * len(x | found[j]) and top[i] != top[j]:
                low, high = sorted((top[i], top[j]))
                top = [low if t == high else t for t in top]
    return top


def made(seed):
    """Chains of near copies about the threshold, a crowd of near copies, a common line and short texts."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    texts = [" ".join(word(n)) for n in (0, 1, 4, 5, 6, 8, 9)] + ["a b c d e f g h", "a b c d e f g h i", "A b c d", "a  b c d", "a b c e"]
    line = word(12)
    for _ in range(40):
        base = word(int(rng.integers(8, 150))) + line
        for _ in range(int(rng.integers(1, 5))):
            texts.append(" ".join(base))
            base = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(0, 4))):
                base[at] = word(1)[0]
    crowd = word(200)
    for _ in range(60):
        copy = list(crowd)
        for at in rng.integers(0, 200, int(rng.integers(0, 6))):
            copy[at] = word(1)[0]
        texts.append(" ".join(copy))
    return [texts[i] for i in rng.permutation(len(texts))]


@pytest.mark.parametrize("often, common, crowd", [(32, 1_000_000, 512), (2, 10, 4)])
def test_stage_finds_every_link(spark, tmp_path, monkeypatch, often, common, crowd):
    monkeypatch.setattr(near_texts, "CROWD", crowd)
    monkeypatch.setattr(near_texts, "PIVOTS", crowd // 2)
    monkeypatch.setattr(near_texts, "SAMPLE", 1 + crowd // 512)
    monkeypatch.setattr(near_texts, "OFTEN", often)
    monkeypatch.setattr(near_texts, "COMMON", common)
    texts = made(often) + [t for d, t in cases.texts() if d is not None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    top = brute_roots(texts)
    empty = [i for i, t in enumerate(texts) if not shingles(t)]
    want = {i for i, t in enumerate(top) if i == t} - set(empty[1:])
    assert kept == want
    assert len({top.count(t) for t in top}) > 3


def test_stage_counts_links_of_fingerprints(spark, tmp_path):
    """The pipeline's stage against all pairs: 3 bits of the fingerprints, or a similarity of 0.8."""
    draw = random.Random(278)
    base = [f"w{draw.randrange(5000)}" for _ in range(100)]
    copy = ["x" if i in (10, 30, 50) else w for i, w in enumerate(base)]  # similarity 0.73, 3 bits
    texts = [" ".join(base), " ".join(copy), " ".join(reversed(base)), *made(2)]
    flat = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    prints = [majority(near_texts.sets(x, np.array([0, x.size]))[0]) for x in flat]
    top = brute_roots(texts)
    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 3 and top[i] != top[j]:
                low, high = sorted((top[i], top[j]))
                top = [low if t == high else t for t in top]
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()} == {i for i, t in enumerate(top) if i == t}
    assert top[1] == 0 and len(set(top)) < len(set(brute_roots(texts)))
