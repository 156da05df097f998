import random

import pytest
import xxhash

from skylocus.llm import simhash


def brute_fingerprint(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: list of (id, fingerprint); the smallest id of each row's component."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        r = find(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprint_of_odd_texts():
    for text in (None, "", " \t\n", "One", "A b c", "a B c D", "x " * 9, "é É z\x1cy q r s t", "w" * 10_000, " ".join(map(str, range(300)))):
        assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_long_text_in_parts(monkeypatch):
    text = " ".join(random.Random(1).choices(["a", "bb", "ccc", "dd"], k=997)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 10)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text.decode())


def clusters(seed, n, spread):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, spread)):
            out.add(x)
            for _ in range(r.randrange(0, 6)):
                x ^= 1 << r.randrange(64)
    return sorted(out)[:n]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def found_components(spark, prints, **options):
    df = spark.createDataFrame([(signed(x),) for x in prints], "fingerprint long")
    edges = [(r.u, r.v) for r in simhash.links(df, **options).collect()]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    groups = {}
    for x in prints:
        groups.setdefault(roots.get(signed(x), signed(x)), []).append(x)
    return sorted(map(sorted, groups.values()))


def brute_groups(prints):
    groups = {}
    for x, c in zip(prints, brute_components([(i, x) for i, x in enumerate(prints)]), strict=True):
        groups.setdefault(c, []).append(x)
    return sorted(map(sorted, groups.values()))


def test_trie_walk_against_all_pairs(spark):
    prints = clusters(3, 500, 12)
    assert found_components(spark, prints) == brute_groups(prints)


def test_split_tasks_lose_no_link(spark):
    prints = clusters(5, 300, 60)
    base = random.Random(2).getrandbits(64)
    prints = sorted({*prints, *(base ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a))})
    assert found_components(spark, prints, task_rows=100) == brute_groups(prints)


def test_small_leaves_walk_deep(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "LEAF_PAIRS", 1)
    prints = np.array(clusters(7, 400, 30), np.uint64)
    walk = simhash.Walk(prints, 4)
    n = len(prints)
    component = walk.run(np.array([[0], [n], [0], [n]]), np.array([0]), np.array([0]))
    groups = {}
    for x, c in zip(prints.tolist(), component.tolist(), strict=True):
        groups.setdefault(c, []).append(x)
    assert sorted(map(sorted, groups.values())) == brute_groups(prints.tolist())


def test_near_duplicates(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(r.choices(words, k=r.randrange(0, 90)))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(30)] + [(200 + k, rows[k][1] + " end") for k in range(30)]
    rows += [(7, None), (7, None), (None, rows[3][1]), (None, "nothing like it " * 9), (300, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fingerprint int")
    got = sorted(((x.doc_id, x.fingerprint, x.component_id) for x in simhash.near_duplicates(df).collect()), key=str)
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints), strict=True)), key=str)
    assert got == want
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [x.doc_id for x in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({c for i, _, c in want if c is not None and c == i})


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("at_once", [1 << 20, 5])
def test_components_of_chains_stars_and_graphs(spark, monkeypatch, at_once):
    """Where a task holds all links it is done at once; else stars are drawn in rounds."""
    monkeypatch.setattr(simhash, "LINKS_AT_ONCE", at_once)
    r = random.Random(2)
    chain = [(k, k + 1) for k in range(1000, 1060)]
    star = [(5000, 5000 + k) for k in range(1, 80)]
    graph = [(r.randrange(-300, 0), r.randrange(-300, 0)) for _ in range(200)]
    links = chain + star + graph + [(7, 7), (1000, 1001), (1001, 1000)]
    r.shuffle(links)
    got = {x.node: x.root for x in simhash.components(spark.createDataFrame(links, "u long, v long").repartition(6)).collect()}
    root = {x: x for link in links for x in link}
    for _ in range(len(root)):
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {x: y for x, y in root.items() if x != y}
    assert simhash.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_links_are_contracted_some_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "LINKS_AT_ONCE", 4)
    links = pa.table({"u": [5, 4, 3, 2, 9, 8], "v": [4, 3, 2, 1, 8, 7]})
    out = pa.Table.from_batches(simhash._contracted(iter(links.to_batches(max_chunksize=3))))
    assert sorted(zip(out["u"].to_pylist(), out["v"].to_pylist(), strict=True)) == [(2, 1), (3, 1), (4, 1), (5, 1), (8, 7), (9, 7)]
