import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylocus.llm import common, encode, packing, tokenfiles

BYTES, WORDS = (public_tokenizers.path(f"{x}.json") for x in ("byte_bpe_50k", "word_bpe_49k"))
TEXTS = [
    None, "", " ", "Hello, world! It's we'll THEY'RE 'so' 123 4.5", "a<|endoftext|>b <|startoftext|> c", "<|endoftext|>", "é e\u0301 ﬁ İ ΣΑΣ ß", "日本語 한국 🙂\u200d🙂",
    "tab\there\x0bnow\x0c \r\n\x1c\x1d\x85\xa0x\u3000y", "a..b--c 'tis ''s ''ll x'd", "Ünïcode  double  space ", "w" * 3000, "\x00\x01 control \x7f", "don't  \n\n stop",
]


def arrays(path, texts, end=()):
    t = Tokenizer.from_file(path)
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + list(end), np.uint32) for x in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_the_librarys(path, sf_dir):
    import pyarrow.parquet as pq

    texts = TEXTS + pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()[:60]
    with open(path, encoding="utf-8") as f:
        enc = encode.Encoder(f.read())
    assert enc.fast
    for text, want in zip(texts, arrays(path, texts), strict=True):
        assert np.array_equal(enc.ids(None if text is None else text.encode()), want), text


def test_every_character(tmp_path):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}{c} 1{c}. " for c in chars[k : k + 40]) for k in range(0, len(chars), 40)]
    for path in (BYTES, WORDS):
        with open(path, encoding="utf-8") as f:
            enc = encode.Encoder(f.read())
        for text, want in zip(texts, arrays(path, texts), strict=True):
            assert np.array_equal(enc.ids(text.encode()), want)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    texts = TEXTS + [" ".join(r.choices(["alpha", "beta", "gamma,", "Delta"], k=r.randrange(0, 700))) for _ in range(30)]
    return texts, spark.createDataFrame([(k * 3 - 9, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns({"start": F.lit(0), "part": F.lit("x")})


def test_token_files_round_trip(spark, docs):
    texts, df = docs
    folder = common.new_folder(spark, "tokens")
    manifest = tokenfiles.write(df.repartition(5), WORDS, folder)
    want = arrays(WORDS, texts, [2])
    starts = np.concatenate(([0], np.cumsum([len(x) for x in want])))
    got = sorted(tuple(r) for r in tokenfiles.read(manifest).collect())
    assert got == [(k * 3 - 9, starts[k], len(x), zlib.crc32(x.astype("<u4").tobytes())) for k, x in enumerate(want)]
    parts = [tokenfiles.Part(r["bin"], r["idx"]) for r in manifest.orderBy("part").collect()]
    assert all(p.tokens.dtype == np.dtype("<u2") and isinstance(p.tokens, np.memmap) for p in parts)
    assert np.array_equal(np.concatenate([p.tokens for p in parts]), np.concatenate(want))


def test_token_files_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (None, None)], "doc_id long, text string")
    got = tokenfiles.read(tokenfiles.write(df, WORDS, common.new_folder(spark, "tokens"), end_id=None)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None", "None"] and sorted(r.n_tokens for r in got) == [0, 1, 1, 1]
    assert tokenfiles.read(tokenfiles.write(df.limit(0), WORDS, common.new_folder(spark, "tokens"))).collect() == []


def test_cuts():
    assert packing.cuts(0, 4) == [] and packing.cuts(4, 4) == [(0, 4)] and packing.cuts(3, 4) == [(0, 3)]
    assert packing.cuts(10, 4) == [(0, 2), (2, 4), (6, 4)]


def best_fit(lengths, capacity):
    """Sequences that best fit, longest first, needs; by hand."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fitting = [k for k, g in enumerate(gaps) if g >= n]
        if fitting:
            gaps[min(fitting, key=lambda k: gaps[k])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 16, 100])
    lengths = [r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    filled = {}
    ranks = []
    for m in packing.plan(counts, capacity):
        for rank in range(m["first"], m["last"] + 1):
            k = rank - m["first"]
            s = m["sequence"] + k // m["each"]
            assert filled.get(s, 0) == m["filled"] + k % m["each"] * m["length"]
            filled[s] = filled.get(s, 0) + m["length"]
            ranks.append(rank)
    assert ranks == list(range(len(lengths))) and max(filled.values()) <= capacity
    assert len(filled) == best_fit(lengths, capacity)


def test_pack_documents(spark, docs):
    texts, df = docs
    out = packing.pack_documents(df.unionByName(df.limit(3)), BYTES, 64).collect()
    want = [x for x in arrays(BYTES, texts, [2])]
    extra = [r.doc_id for r in df.limit(3).collect()]
    expected = []
    for k, x in enumerate(want):
        for _ in range(2 if k * 3 - 9 in extra else 1):
            expected += [(k * 3 - 9, j, a, n, zlib.crc32(x[a : a + n].astype("<u4").tobytes())) for j, (a, n) in enumerate(packing.cuts(len(x), 64))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(expected)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) == best_fit([e[3] for e in expected], 64)


def test_pack_empty(spark, docs):
    assert packing.pack_documents(docs[1].limit(0), BYTES, 64).collect() == []
