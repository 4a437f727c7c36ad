"""Spelling variants, hard negatives and token counts against brute force, on hard tables and on empty ones."""

import functools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from habitat_spark.llm import hard_negatives, spelling, token_counts

from . import cases

SOURCE = public_tokenizers.path("byte_bpe_50k.json")
_LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark).repartition(3).cache()


def brute_words(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(_LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near, form = defaultdict(list), {}
    for a in words:
        near[a] = [b for b in words if is_near(a, b)]
        if near[a]:
            best = min(near[a], key=lambda x: (-words[x], x))
            if words[best] >= 10 * words[a]:
                form[a] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), words.get(form.get(w), -1)) for w, n in words.items())


def variants_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def noisy_words():
    rng = random.Random(3)
    words = {}
    for _ in range(60):
        w = "".join(rng.choice("aabbcdé") for _ in range(rng.randrange(7, 12)))
        words[w] = rng.choice([2, 3, 40, 500, 9000])
        for _ in range(4):
            i = rng.randrange(len(w) + 1)
            x = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abÿz") + w[i:], w[:i] + rng.choice("abÿz") + w[i + 1 :]])
            if len(x) >= 7:
                words.setdefault(x, rng.randrange(2, 60))
    words |= {"x" * k: 10 ** (k % 5 + 1) for k in range(7, 30)} | {"prefixed" + a + b: 5 for a in "abcdefgh" for b in "abcdefgh"}
    return words | {"é" * 3000: 2, "é" * 2999 + "a": 30, "é" * 3001: 400}


@pytest.mark.parametrize("hot, together", [(20_000, 1 << 22), (5, 300), (1, 1)])
def test_spelling_groups(spark, hot, together):
    words = noisy_words()
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert variants_of(spelling.variants(table, hot=hot, together=together)) == brute_variants(words)


def test_spelling_documents(spark, docs):
    rows = cases.texts() + [(None, "Variants variants VARIANTS variantx"), (None, "ÀLPHABETS àlphabets Àlphabets")] + [(i, "misspelling misspeling Naïveté naïvete ×÷×÷×÷× ") for i in range(40)]
    got = variants_of(spelling.spelling_variants(cases.frame(spark, rows)))
    assert got == brute_variants(brute_words(rows)) and len(got) > 5
    assert spelling.spelling_variants(cases.frame(spark, [])).count() == 0


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 64, 100):
        numbers = rng.permutation(n)
        first, low = rng.integers(0, n, 50), rng.integers(0, n, 50)
        last, high = first + rng.integers(0, n, 50), low + rng.integers(0, n, 50)
        last, high = np.minimum(last, n), np.minimum(high, n)
        query, value = spelling.WaveletTree(numbers).report(first, last, low, high)
        want = [(q, v) for q in range(50) for v in numbers[first[q] : last[q]] if low[q] <= v < high[q]]
        assert sorted(zip(query.tolist(), value.tolist())) == sorted(map(tuple, np.array(want).reshape(-1, 2).tolist()))


def brute_negatives(rows):
    kept = []
    for vec, label, x in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        kept.append((vec, (label + 1) % 10 if vec is not None and vec % 7 == 0 else label, [math.floor(256 * v) for v in x]))
    order = lambda t: (-t[0], kept[t[1]][0] is None, kept[t[1]][0] or 0)
    out = []
    for i, (vec, label, q) in enumerate(kept):
        if vec is None or vec % 100:
            continue
        scores = sorted(((sum(a * b for a, b in zip(q, r[2])), j) for j, r in enumerate(kept) if j != i), key=order)
        for p, j in [s for s in scores if kept[s[1]][1] == label][:5]:
            hits = [(s, k) for s, k in scores if kept[k][1] != label and 80 * p <= 100 * s <= 100 * p][:5]
            out += [(vec, kept[j][0], r + 1, kept[k][0], p, s) for r, (s, k) in enumerate(hits)]
    return sorted(out, key=repr)


def vectors(n=400, d=9):
    rng = random.Random(8)
    rows = [(i, rng.randrange(4), [rng.gauss(0.2, 0.4) for _ in range(d)]) for i in range(n)]
    rows += [(1000 + i, i % 3, [0.25] * d) for i in range(150)]  # one common vector
    rows += [(2000, None, [1.0] * d), (2100, 1, None), (2200, 1, [None, 1.0]), (2300, 1, [math.nan]), (2400, 2, [math.inf] * d), (2500, 2, []), (2600, 3, [0.5] * 40), (None, 1, [0.25] * d), (None, 2, [0.9] * d)]
    return rows + [rows[0], rows[100], (2700, 2**31 - 1, [0.3] * d), (-100, -8, [0.3] * d)]


SCHEMA = "vec_id long, label int, embedding array<float>, a int, b int, chunk int, uid long, q int, rank int"


@pytest.mark.parametrize("sizes", [{}, {"anchor_rows": 2, "block_rows": 16, "width": 4}, {"anchor_rows": 1, "block_rows": 1000, "width": 1}])
def test_hard_negatives(spark, sizes):
    rows = [(i, x, None if v is None else [None if y is None else float(np.float32(y)) for y in v]) for i, x, v in vectors()]
    table = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, hard_negatives.mined(table, **sizes).collect()), key=repr)
    assert got == brute_negatives(rows) and len(got) > 50


def test_hard_negatives_beyond_64_bits(spark):
    table = spark.createDataFrame([(i, i % 2, [1e30, -1e30, float(i)], 1, 2, 3, 4, 5, 6) for i in range(0, 300, 50)], SCHEMA)
    hard_negatives.mined(table).collect()
    assert hard_negatives.mined(table.limit(0)).count() == 0
    a = np.array([[2**40, 3]])
    assert hard_negatives.product(a, a).tolist() == [[(2**80 + 9) % 2**64]]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(SOURCE)


def test_token_counts(spark, docs, library):
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t in cases.texts()]
    for settings in ({}, {"chunk": 50, "fan": 4}, {"chunk": 7000, "fan": 2}):
        if settings.get("fan", 64) ** 2 * settings.get("chunk", 1 << 20) < 200_000:
            settings["fan"] = 64  # two rounds must hold the longest text
        got = token_counts.token_counts(docs, SOURCE, **settings)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert token_counts.token_counts(cases.frame(spark, []), SOURCE).count() == 0


PARTS = ["'", "'s", "'re", "'ll", "'v", "r", "e", " ", "  ", "\n", "\t", "a", "the", "ing", "12", "!", "<|endoftext|>", "<|endof", "<", "é", "中文", " ", "　", "\x1c", "\x85", "ſ", "'T", "²", "😀", "́", "st", "'m", "'d", "ve"]


def test_transducer_and_its_maps(library):
    own, rng = token_counts.Transducer(open(SOURCE, encoding="utf-8").read(), states=500), random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 16)))
        want = len(library.encode(text, add_special_tokens=False).ids)
        cut = rng.randrange(1, 6)
        maps = [token_counts.ChunkMap.of(text[i : i + cut], own.count) for i in range(0, len(text), cut)]
        k = rng.randrange(len(maps) + 1)  # composing is associative
        parts = [functools.reduce(lambda a, b: a.then(b, own.count), x) for x in (maps[:k], maps[k:]) if x]
        assert own.count(text) == own.counted(text) == functools.reduce(lambda a, b: a.then(b, own.count), parts).total(own.count) == want, text


def test_other_tokenizers_are_refused(spark, docs):
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
