import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from skylocus.llm import mixing, packing, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(6)
    words = [f"word{k}" for k in range(500)]
    rows = []
    for k in range(120):
        text = " ".join(r.choices(words, k=r.choice([60, 200, 1500])))
        rows.append((k, text, "en", ["web", "books", None][k % 3], len(text)))
    rows += [(200 + k, rows[k][1], "en", "web", None) for k in range(40)]  # copies
    rows += [(300, None, None, None, None), (301, "", "en", "web", 0), (302, "too few words", "en", "web", 13), (303, "same thing again " * 60, "en", "web", 1)]
    return rows


def test_stages(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
    assert sorted(r.doc_id for r in kept["quality_rules"]) == sorted(r[0] for r in rows if r[0] < 300)
    # of a text and its copies, the smallest id stays; the texts are far apart
    assert sorted(r.doc_id for r in kept["near_dedup"]) == list(range(120))
    mixed = Counter(r.doc_id for r in kept["mix"])
    assert set(mixed) <= set(range(120)) and max(mixed.values()) <= 2
    whole = sum(len(r.text.split()) for r in kept["near_dedup"])
    assert abs(sum(len(r.text.split()) for r in kept["mix"]) - 1.5 * whole) < 0.05 * whole
    packed = kept["pack"]
    assert Counter(r.doc_id for r in packed if r.piece == 0) == mixed
    fills = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills.get(r.sequence_id, 0)
        fills[r.sequence_id] = r.offset + r.length
    assert max(fills.values()) <= 1024
    rerun = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert rerun == sorted(tuple(r) for r in packed)


def hot_documents():
    """A third of all rows are near copies of one text, some of which are only near to others of them; and the rest."""
    r = random.Random(12)
    words = [f"word{k}" for k in range(3000)]
    passage = " ".join(r.choices(words, k=55))
    rows = [(k, passage + " " + " ".join(r.choices(words, k=r.choice([150, 250, 700])))) for k in range(100)]
    hot = r.choices(words, k=300)
    for k in range(60):
        text = list(hot)
        for at in r.sample(range(300), r.choice([0, 1, 3])):
            text[at] = f"new{k}x{at}"
        rows.append((1000 + k, " ".join(text)))
    # each is near to the one before, the last far from the first
    text = list(hot)
    for k in range(12):
        text[20 * k] = f"chain{k}"
        text[20 * k + 9] = f"link{k}"
        rows.append((2000 + k, " ".join(text)))
    rows += [(3000 + k, rows[k][1].upper()) for k in range(20)] + [(4000 + k, "same thing again " * 60) for k in range(5)] + [(5000, None), (5001, "few")]
    r.shuffle(rows)
    return [(i, t, "en", r.choice(["hot", "hot", "books", None]), 0) for i, t in rows]


def shingles(text, words=5):
    own = text.lower().split()
    return {tuple(own[k : k + words]) for k in range(max(1, len(own) - words + 1))}


def brute_run(rows):
    """The whole pipeline, document by document and pair by pair: how often each piece comes, and how many sequences they need."""
    good = []
    for row in rows:
        m = dict(zip(quality.MEASURES, quality.measure((row[1] or "").encode()), strict=True))
        if m["n_words"] >= 50 and 100 * m["n_repeat_words"] <= 50 * m["n_words"] and 100 * m["n_symbols"] <= 10 * m["n_words"] and 100 * m["n_letter_words"] >= 60 * m["n_words"]:
            good.append(row)
    sets, group = [shingles(x[1]) for x in good], list(range(len(good)))
    pairs = [(i, j) for i in range(len(good)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in good:
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    kept = [min((good[k] for k in range(len(good)) if group[k] == g), key=lambda x: x[0]) for g in set(group)]
    size = {x[0]: len(x[1].split()) for x in kept}
    names = sorted({x[3] for x in kept if x[3] is not None}) + [None] * any(x[3] is None for x in kept)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    sizes = {s: sum(size[x[0]] for x in kept if x[3] == s) for s in names}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if per * weight[s] >= 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: per * weight[s] for s in open_}
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    copies = {}
    for s in names:
        rate = round(target[s] / sizes[s] * mixing.UNIT)
        mark = "0:null" if s is None else f"0:={s}"
        offset = int(hashlib.md5(mark.encode()).hexdigest()[:7], 16) * (mixing.UNIT >> 28)
        for k, x in enumerate(sorted((x for x in kept if x[3] == s), key=lambda x: (size[x[0]], x[0]))):
            copies[x[0]] = ((k + 1) * rate + offset) // mixing.UNIT - (k * rate + offset) // mixing.UNIT
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for x in kept:
        ids = np.array([*tokenizer.encode(x[1], add_special_tokens=False).ids, 2], "<u4")
        for k, (a, n) in enumerate(packing.cuts(len(ids), 1024)):
            if copies[x[0]]:
                pieces[x[0], k, a, n, zlib.crc32(ids[a : a + n].tobytes())] += copies[x[0]]
    gaps = []
    for n in sorted((p[3] for p in pieces.elements()), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((1024 if fit is None else fit) - n)
    return pieces, len(gaps)


def test_run_against_brute_force(spark, tmp_path):
    rows = hot_documents()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    pieces, sequences = brute_run(rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    assert len({r.sequence_id for r in got}) == sequences
    # the hot group is one document, and so is the chain that begins near it
    assert {p[0] for p in pieces if p[0] >= 1000} <= {1000}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_used():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "mix", "pack"]
    assert quality.CURRENT and simhash and packing
