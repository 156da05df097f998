import random
import re

import pytest
from pyspark.sql import functions as F

from skylocus.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t", "one", "a b c a b c", "a b c d a b c", "x x x x", "same line\nsame line\nother\n \nsame line ",
    "é ü — “quoted” \x1c\x85 #tag $5 <b>", "- a\n- b\n* c\n• d", "wait...\nmore…\nend", "w" * 1500,
    "p q r " * 400, " ".join(f"w{k}" for k in range(3000)),
]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 2000 else set()
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines), "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(covered),
        "n_distinct_words": len(set(words)), "longest_word": max((len(w.encode()) for w in words), default=0),
    }


def test_measures():
    r = random.Random(1)
    texts = TEXTS + [" ".join(r.choices("abcd", k=r.randrange(40))) for _ in range(50)]
    for text in texts:
        got = dict(zip(quality.MEASURES, quality.measure(None if text is None else text.encode()), strict=True))
        want = brute(text)
        assert {k: got[k] for k in want} == want, text


def test_many_distinct_words():
    import numpy as np

    ids = np.array([1, 2, 3, 9, 1, 2, 3])
    assert quality.repeated_words(ids, 10) == quality.repeated_words(ids, 1 << 22) == 6


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    vocabulary = [f"word{k}" for k in range(500)]
    texts = TEXTS + [" ".join(r.choices(vocabulary, k=r.randrange(20, 120))) for _ in range(40)] + ["a$ b# c| " * 60]
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"failed": F.lit("x"), "n_words": F.lit(0)})


def test_ledger_and_policies(docs):
    entries = quality.verdicts(quality.ledger(docs)).collect()
    assert len(entries) == docs.count()
    for e in entries:
        assert bool(e.failed & 1) == (e.n_words < 50) and bool(e.failed & 2) == (100 * e.n_repeat_words > 50 * e.n_words)
        assert e.kept_base == (e.failed & 3 == 0)
        hard, soft = quality.CURRENT.masks()
        assert e.kept_v2 == (e.failed & hard == 0 and (e.failed & soft).bit_count() < 2)


def test_ablations_against_verdicts(docs):
    entries = quality.ledger(docs)
    masks = [r.failed for r in entries.select("failed").collect()]
    for row in quality.ablations(entries).collect():
        policy = next(p for p in quality.POLICIES if p.version == row.version)
        hard, soft = policy.masks()
        keeps = lambda m: m & hard == 0 and (m & soft).bit_count() < policy.at_least  # noqa: E731, B023
        bit = quality.BIT[row.rule]
        assert row.n_failed == sum(bool(m & bit) for m in masks)
        assert row.n_rejected == sum(not keeps(m) for m in masks)
        assert row.n_rescued == sum(not keeps(m) and keeps(m & ~bit) for m in masks)


def test_apply_keeps_the_rows_of_the_policy(docs):
    kept = quality.apply(docs)
    assert kept.columns == docs.columns
    want = sorted(r.text for r in docs.collect() if _kept(r.text))
    assert sorted(r.text for r in kept.collect()) == want and want


def _kept(text):
    m = dict(zip(quality.MEASURES, quality.measure(None if text is None else text.encode()), strict=True))
    n = m["n_words"]
    return not (n < 50 or 100 * m["n_repeat_words"] > 50 * n or 100 * m["n_symbols"] > 10 * n or 100 * m["n_letter_words"] < 60 * n)


def test_empty(docs):
    assert quality.ledger(docs.limit(0)).collect() == [] and quality.apply(docs.limit(0)).collect() == []


def test_apply_with_clashing_names(spark):
    from pyspark.sql import functions as F

    good = " ".join(f"word{k}" for k in range(80))
    docs = spark.createDataFrame([(1, good), (1, "short"), (None, good), (2, None)], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(k) for k, c in enumerate(("__measures", "failed", "Failed_", "n_words", "doc", "__own_0"))})
    out = quality.apply(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "None"]
    assert quality.apply(docs.limit(0)).collect() == []
