import random

import pytest

from skylocus.llm import similar

SCHEMA = "doc_id long, text string, signature int"


def jaccard(a, b, words=5):
    a, b = a.split(), b.split()
    x, y = ({tuple(t[k : k + words]) for k in range(max(1, len(t) - words + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def changed(r, text, n):
    words = text.split()
    for k in r.sample(range(len(words)), n):
        words[k] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def made_texts():
    """Texts with a common passage, and changed copies of them; all by id."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    passage = " ".join(r.choices(words, k=60))
    texts = {k: " ".join(r.choices(words, k=r.randrange(60, 400))) + " " + passage for k in range(120)}
    for k in range(120):
        texts[1000 + k] = changed(r, texts[k], r.randrange(0, 20))
    return texts


def test_groups_are_those_of_all_pairs(spark):
    texts = made_texts()
    assert sum(0.83 <= jaccard(texts[k], texts[1000 + k]) < 1 for k in range(120)) > 20
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], SCHEMA).repartition(5)
    out = similar.without_similar(docs)
    assert out.columns == docs.columns
    ids = [x.doc_id for x in out.collect()]
    kept = set(ids)
    assert len(ids) == len(kept) and set(range(120)) <= kept
    # the estimate has a standard error of 0.025
    surely = {i for i in range(1000, 1120) if jaccard(texts[i], texts[i - 1000]) >= 0.86}
    never = {i for i in range(1000, 1120) if jaccard(texts[i], texts[i - 1000]) < 0.68}
    assert surely and never and not surely & kept and never <= kept


def test_passage_in_short_texts_links_nothing(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    passage = " ".join(r.choices(words, k=50))
    texts = [passage + " " + " ".join(r.choices(words, k=r.randrange(40, 60))) for _ in range(400)]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], SCHEMA)
    assert similar.without_similar(docs).count() == 400


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (None, "a b", 0), (None, "a b", 0), (4, "A b", 0), (5, "a  B", 0), (6, "a b c", 0), (6, "a b c", 0)]
    rows += [(7, "long " * 20_000, 0), (8, "LONG " * 20_000, 0)]
    out = similar.without_similar(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(x.doc_id for x in out if x.doc_id) == [1, 4, 6, 7]
    assert sum(x.doc_id is None for x in out) == 2
    assert similar.without_similar(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketch_does_not_depend_on_the_parts(monkeypatch):
    text = " ".join(random.Random(1).choices([f"w{k}" for k in range(300)], k=2000)).encode()
    whole = similar.sketch(text)
    monkeypatch.setattr(similar, "AT_ONCE", 13)
    assert similar.sketch(text) == whole


def edited(words, at, n=1):
    """The words with ``n`` new ones from position ``at`` on, apart from others by more than a shingle."""
    out = list(words)
    for k in range(n):
        out[at + 6 * k] = f"new{at}x{k}"
    return out


@pytest.mark.parametrize("block", [1 << 12, 7])
def test_chains_in_a_bucket_whose_rep_is_unlike_them(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block, raising=False)
    r = random.Random(3)
    classes, chains = [], []
    for k in range(6):
        # all are in one bucket; each text of a chain is near to the one before only
        texts = [[f"c{k}w{j}" for j in range(400)]]
        for step in range(3):
            texts.append(edited(texts[-1], 100 * step, 7))
        names = [" ".join(t) for t in texts]
        assert all(jaccard(a, b) >= 0.83 for a, b in zip(names, names[1:], strict=False)) and jaccard(names[0], names[2]) < 0.75
        chains.append([100 * k + j for j in range(4)])
        classes += zip(chains[-1], names, strict=True)
    classes += [(-1 - k, " ".join(r.choices(names[0].split(), k=300))) for k in range(20)]
    rows = [(i, bytearray(similar.sketch(t.encode())[1]), [5]) for i, t in classes]
    df = spark.createDataFrame(rows, "node long, signature binary, prints array<long>")
    links = {(x.u, x.v) for x in similar.candidate_links(df, 0.8).collect()}
    group = {i: i for i, _ in classes}
    for _ in classes:
        for u, v in links:
            group[u] = group[v] = min(group[u], group[v])
    assert [[group[i] for i in chain] for chain in chains] == [[chain[0]] * 4 for chain in chains]
    assert all(group[-1 - k] == -1 - k for k in range(20))


def pair(k, shared, own):
    """Two texts with ``shared`` shingles in common and ``own`` further ones each, all different."""
    start = [f"p{k}w{j}" for j in range(shared + 4)]
    return [" ".join(start + [f"p{k}{side}{j}" for j in range(own)]) for side in "ab"]


def test_limit_is_exact(spark):
    texts, near, far = [], [], []
    for k in range(300):
        # 80 of 100, 160 of 200 ...: 0.8 itself; one shingle less is below it
        m = 1 + k % 3
        both = pair(k, 80 * m, 10 * m) if k < 150 else pair(k, 80 * m - 1, 10 * m + 1)
        assert (jaccard(*both) >= 0.8) == (k < 150) and jaccard(*both) > 0.77
        (near if k < 150 else far).append(1000 + k)
        texts += [(k, both[0], 0), (1000 + k, both[1], 0)]
    kept = {x.doc_id for x in similar.without_similar(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert set(range(300)) <= kept and set(far) <= kept
    # all that draw the same shingles are removed; by design two in a thousand don't
    prints = {i: similar.sketch(t.encode())[2] for i, t, _ in texts}
    meet = {i for i in near if any(x == y for x, y in zip(prints[i - 1000][1:], prints[i][1:], strict=True))}
    assert meet <= set(near) - kept and len(meet) >= 147


def test_exact_links_against_all_pairs():
    r = random.Random(4)
    texts = ["", None, "a b"]
    for k in range(40):
        texts += [changed(r, " ".join(f"t{k % 13}w{j}" for j in range(r.choice((60, 64, 90)))), r.randrange(4)) for _ in range(2)]
    group, found = list(range(len(texts))), list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i] or "", texts[j] or "") >= 0.8]
    u, v = similar.exact_links([t and t.encode() for t in texts], 5, 0.8)
    for links, of in ((pairs, group), (list(zip(u, v, strict=True)), found)):
        for _ in texts:
            for i, j in links:
                of[i] = of[j] = min(of[i], of[j])
    assert group == found and 5 < len(set(group)) < len(texts) - 10


def joined(n, links):
    group = list(range(n))
    for _ in range(n):
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    return group


@pytest.mark.parametrize(("block", "shared"), [(1 << 10, 16), (40, 2), (16, 0), (3, 1)])
def test_blocks_join_what_all_pairs_join(spark, monkeypatch, block, shared):
    """One hot group of near copies, chains in it and beside it, and texts like nothing else, all in one group: cut into blocks, nothing is lost."""
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "SHARED", max(1, shared))
    r = random.Random(11)
    hot = [f"h{j}" for j in range(200)]
    texts = [changed(r, " ".join(hot), r.randrange(3)) for _ in range(60)]
    text = [f"c{j}" for j in range(200)]
    for k in range(15):
        text = edited(text, 10 * k, 2)
        texts.append(" ".join(text))
    texts += [" ".join(f"own{k}x{j}" for j in range(100)) for k in range(10)] + [None]
    texts.append(texts[0])
    want = joined(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i] or "", texts[j] or "") >= 0.8])
    assert 12 < len(set(want)) < 30
    values = spark.createDataFrame([(k, t and t.encode()) for k, t in enumerate(texts)], "node long, value binary")
    blocks = -(-len(texts) // block)
    members = spark.createDataFrame([(1, blocks, k) for k in range(len(texts))], "group long, blocks int, node long").repartition(3)
    links = similar._links(members, values, lambda v: similar.exact_links(v, 5, 0.8), lambda v, roots, asks: similar.exact_between(v, 5, 0.8, roots, asks))
    assert joined(len(texts), [(x.u, x.v) for x in links.collect()]) == want


def test_between_asks_others_only():
    import numpy as np

    rows = np.array([[0] * 8, [0] * 8, [2**64 - 1] * 8, [0] * 8], np.uint64)
    asks, roots = np.array([True, False, False, False]), np.array([0, 1, 2, 1])
    assert similar.between(rows, 250, roots, asks) == ([1], [0])
    assert similar.between(rows, 250, np.zeros(4, int), asks) == ([], [])
    texts = [b"a b c d e f", b"a b c d e f", b"x", None]
    assert similar.exact_between(texts, 5, 0.8, roots, asks) == ([1], [0])
    assert similar.exact_between(texts, 5, 0.8, roots, ~asks & False) == ([], [])


def test_unlike_texts_with_equal_ids(spark):
    one, two, other = (" ".join(f"{x}{j}" for j in range(100)) for x in "abc")
    near = one.replace("a99", "new")
    rows = [(6, one, 0), (6, two, 0), (9, one, 0), (12, near, 0), (7, two, 0), (7, other, 0)]
    out = similar.without_similar(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x.doc_id, x.text) for x in out) == sorted([(6, one), (6, two), (7, other)])


def test_clashing_names(spark):
    rows = [(k, f"a b c d e f {k // 2}", k, "x", 0) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, row string, node int").selectExpr("*", "1 AS doc", "2 AS __id", "3 AS __row")
    out = similar.without_similar(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 2, 4]
