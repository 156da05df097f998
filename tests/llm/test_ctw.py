import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from skylocus.llm import ctw


def kt(zeros, ones):
    """The estimator's probability, one decision after the other."""
    p, seen = 1.0, [0, 0]
    for bit in [0] * zeros + [1] * ones:
        p *= (seen[bit] + 0.5) / (sum(seen) + 1)
        seen[bit] += 1
    return p


def contexts(text, depth):
    """The classes before each byte, the nearest first; the text begins after spaces."""
    padded = b" " * depth + text
    classes = ctw.byte_classes()
    return [tuple(int(classes[padded[i + depth - k]]) for k in range(1, depth + 1)) for i in range(len(text))]


def brute_score(learned, text, depth):
    counts = Counter()
    for t in learned:
        for byte, context in zip(t, contexts(t, depth), strict=True):
            for bit in range(8):
                prefix, decision = (1 << bit) | (byte >> (8 - bit)), byte >> (7 - bit) & 1
                for k in range(depth + 1):
                    counts[prefix, context[:k], decision] += 1
    seen = {(p, c) for p, c, _ in counts}

    def own(p, c):
        return kt(counts[p, c, 0], counts[p, c, 1])

    def weighted(p, c):
        if (p, c) not in seen:
            return 1.0
        if len(c) == depth:
            return own(p, c)
        return 0.5 * own(p, c) + 0.5 * math.prod(weighted(p, (*c, x)) for x in range(ctw.CLASSES))

    def one(p, c, k=0):
        a, b = counts[p, c[:k], 0], counts[p, c[:k], 1]
        here = (b + 0.5) / (a + b + 1)
        if k == depth:
            return here
        stop = 0.5 * own(p, c[:k]) / weighted(p, c[:k])
        return stop * here + (1 - stop) * one(p, c, k + 1)

    total = 0.0
    for byte, context in zip(text, contexts(text, depth), strict=True):
        for bit in range(8):
            p = one((1 << bit) | (byte >> (8 - bit)), context)
            total += math.log10(p if byte >> (7 - bit) & 1 else 1 - p)
    return total


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_against_brute_force(spark, depth):
    learned = ["abab ab", "Abba é", "", None, "ab"]
    table = ctw.fit(spark.createDataFrame([(t,) for t in learned], "text string"), "text", depth)
    for text in ("ab", "zz é", "bab a"):
        want = brute_score([(t or "").encode() for t in learned], text.encode(), depth)
        assert ctw.score(text.encode(), table, depth) == pytest.approx(want, rel=1e-4)


def test_probabilities_sum_to_one(spark):
    table = ctw.fit(spark.createDataFrame([("the cat sat on the mat",)], "text string"), "text", 2)
    assert np.allclose((10.0 ** table.reshape(-1, 256).astype(float)).sum(1), 1, atol=1e-4)


def test_scores(spark):
    r = random.Random(5)
    words = ["the", "cat", "Sat", "on", "mat", "über"]
    rows = [(k, " ".join(r.choices(words, k=30))) for k in range(60)] + [(3, "the the"), (61, None), (62, ""), (None, "cat dog")]
    rows.append((63, "qxz jkv wq zzx" * 3))
    df = spark.createDataFrame([(*x, "extra") for x in rows], "doc_id long, text string, block string")
    got = sorted((tuple(x) for x in ctw.score_documents(df, block_bytes=200).collect()), key=str)
    apart = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    tokens = lambda t: [w.lower() for w in (t or "").split()] + [None]
    counts = Counter(w for i, t in rows if not apart(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        want.append((i, apart(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, base))
    want.sort(key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in want])
    by_id = {x[0]: x for x in got}
    # text like the rest is cheaper than noise, and much cheaper than with no model
    assert by_id[1][8] < by_id[63][8] < 8 and by_id[1][8] < 2
    assert by_id[61][6] == by_id[62][6] == 0


def test_empty_table(spark):
    assert ctw.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("depth", [2, 3, ctw.DEPTH, 5])
def test_scores_are_those_of_byte_contexts(spark, monkeypatch, depth):
    rows = [(1, "abab ab"), (2, "Abba é"), (3, "дом дым"), (4, ""), (5, None), (6, "ab дом"), (17, "дым 12")]
    learned = [(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    assert len(learned) < len(rows)
    got = {x.doc_id: x.score for x in ctw.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), depth).collect()}
    # a class for each byte that occurs will do: others have seen nothing and count as 1
    there = sorted({x for t in learned for x in t} | {32})
    number = {x: k for k, x in enumerate(there)}
    monkeypatch.setattr(ctw, "CLASSES", len(there))
    monkeypatch.setattr(ctw, "byte_classes", lambda: np.array([number.get(x, 1000 + x) for x in range(256)]))
    for i, t in rows:
        if i in (1, 3, 4, 6, 17):
            assert got[i] == pytest.approx(brute_score(learned, t.encode(), depth), rel=1e-6)
