import pytest
from pyspark.sql import functions as F

from skylocus.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left = {}, share * sum(sizes.values())
    active = set(names)
    while active:
        per = left / sum(weight[s] for s in active)
        full = {s for s in active if per * weight[s] > cap * sizes[s]}
        if not full:
            return target | {s: per * weight[s] for s in active}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        active -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, None: 30}, {"a": 0, "b": 0}, {"x": 7}, {"a": 1, "b": 1000, "c": 50, "d": 3, "é": 900, None: 4}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, [5, 2, 1], 1.5, 2.0).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s])


def documents(spark, n):
    rows = [(k if k != 5 else None, None if k % 17 == 0 else "w " * (k * 7919 % 90) + "\x0bx\x1c", [None, "a", "b", "hot", "hot", "hot"][k % 6]) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("clash"), "rate": F.lit(2), "offset": F.lit(1)})


def test_mix(spark):
    docs = documents(spark, 600)
    out = mixing.mix(docs, [5, 2, 1]).collect()
    again = mixing.mix(docs.repartition(7), [5, 2, 1]).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    texts = {r.doc_id: r.text for r in docs.collect()}
    sizes, taken, largest = {}, {}, {}
    for r in out:
        if r.doc_id is not None:
            assert r["size"] == len((texts[r.doc_id] or "").encode().split())
        assert 0 <= r["copies"] <= 2
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r["copies"]
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    want = brute_targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r.source] and r["target"] == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s]


def test_copies_are_one_for_each_boundary(spark):
    out = [r for r in mixing.mix(documents(spark, 400), [5, 2, 1]).collect() if r.source == "hot"]
    expected = out[0]["target"] / out[0]["source_size"] * len(out)
    assert abs(sum(r["copies"] for r in out) - expected) <= 1


def test_taken_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c2"), (None, "n")], "doc_id long, text string")
    copies = spark.createDataFrame([(1, 2), (2, 0), (3, 2), (3, 1), (None, 1)], "doc_id long, copies long")
    got = sorted((r.doc_id or 0, r.text[0]) for r in mixing.taken_rows(docs, copies).collect())
    assert got == [(0, "n"), (1, "a"), (1, "a"), (3, "c"), (3, "c"), (3, "c")]


def test_empty(spark):
    assert mixing.mix(documents(spark, 1).limit(0), [5, 2, 1]).collect() == []


@pytest.mark.parametrize("rank", [0, 7, 1 << 30, 5 * 10**9, 3 * 10**12])
@pytest.mark.parametrize("rate", [0, 1, 123456789, mixing.UNIT, 2 * mixing.UNIT])
def test_crossed_of_very_many_documents(spark, rank, rate):
    row = spark.range(1).select(F.lit(rank).alias("rank"), F.lit(rate).cast("long").alias("rate"), F.lit(mixing.UNIT - 1).cast("long").alias("offset"))
    got = row.select(mixing.crossed("rank"), mixing.crossed("(rank + 1)")).first()
    assert tuple(got) == tuple((k * rate + mixing.UNIT - 1) // mixing.UNIT for k in (rank, rank + 1))


def test_targets_of_many_sources(spark):
    sizes = {f"s{k}": (k * 7919) % 1000 ** (1 + k % 2) for k in range(300)}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), [5, 2, 1], 1.5, 2.0).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_taken_rows_of_clashing_names_and_null_ids(spark):
    rows = [(None, f"n{k}") for k in range(50)] + [(k, f"d{k}") for k in range(5)]
    clash = ("copies", "n", "id", "own_id", "doc", "rank", "turn", "__copies", "__id")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(k) for k, c in enumerate(clash)})
    copies = spark.createDataFrame([(None, k % 3) for k in range(50)] + [(k, 1) for k in range(5)], "doc_id long, copies long")
    out = mixing.taken_rows(docs, copies)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns and sum(i is None for i, _ in got) == sum(k % 3 for k in range(50)) and len(got) == 49 + 5
    assert max(got.count(x) for x in got) == 1
    assert mixing.taken_rows(docs.limit(0), copies).collect() == [] == mixing.taken_rows(docs, copies.limit(0)).collect()
