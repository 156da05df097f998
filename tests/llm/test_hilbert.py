import hashlib
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from skylocus.llm import hilbert


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_the_grid(spark, n, bits):
    names = [f"c{k}" for k in range(n)]
    cells = spark.createDataFrame(list(product(range(1 << bits), repeat=n)), names).select(*[F.col(c).cast("int") for c in names])
    rows = cells.withColumn("h", hilbert.curve_index([F.col(c) for c in names], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << bits * n))
    for a, b in zip(rows, rows[1:], strict=False):
        assert sum(abs(a[c] - b[c]) for c in names) == 1


def test_classes(spark):
    sizes = [None, 0, 1, 2, 3, 4, 5, 7, 8, 31, 32, 63, 64, 65, 127, 128, 1000, 1001, 1 << 40, (1 << 62) + 1]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in sizes], "x long").select(hilbert.size_class(F.col("x"))).collect()]
    want = [max(x or 1, 1).bit_length() * 32 + ((max(x or 1, 1) << 6 >> max(x or 1, 1).bit_length()) & 31) for x in sizes]
    assert got == want and got[2:] == sorted(got[2:]) and max(got) < hilbert.CLASSES
    words = spark.createDataFrame([(None,), ("",), ("en",)], "x string").select(hilbert.category_class(F.col("x"))).collect()
    assert words[0] == words[1] and all(0 <= r[0] < hilbert.CLASSES for r in words)


def test_cells_hold_equally_many_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("class"), (F.col("id") % 4).alias("few"), (F.col("id") * 37 % 1000).alias("many"), F.lit(1).alias("b"))
    rows = hilbert.equal_cells(df, {"a": F.col("few").cast("int"), "c": F.col("many").cast("int"), "d": F.lit(5)}, 5).collect()
    assert len(rows) == 1000 and sorted({r.a for r in rows}) == [0, 8, 16, 24] and {r.d for r in rows} == {0}
    counts = [sum(r.c == k for r in rows) for k in range(32)]
    assert sum(counts) == 1000 and max(counts) - min(counts) <= 1 and all((r.c, r.many) <= (32, 1000) for r in rows)
    assert all(r.c == r.many * 32 // 1000 for r in rows)
    assert hilbert.equal_cells(df.limit(0), {"a": F.col("few").cast("int")}, 5).collect() == []


def shards(df, n_shards):
    rows = hilbert.equal_cells(df.select("doc_id", "lang", "size"), {"a": hilbert.category_class(F.col("lang")), "b": hilbert.size_class(F.col("size"))}, 7)
    return hilbert.shard(rows, {"a": F.col("a"), "b": F.col("b")}, 7, n_shards, ["doc_id"], ["doc_id", "size"])


@pytest.mark.parametrize("n", [0, 1, 5, 8, 30, 101])
def test_shards_are_even_and_slots_gapless(spark, n):
    rows = [(k if k % 7 else None, None if k % 11 == 3 else f"l{k % 3}", k % 4) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, size long").withColumns({"curve": F.lit("x"), "rank": F.lit(1), "a": F.lit(0)})
    got = shards(df, 8).collect()
    counts = [sorted(r.slot for r in got if r.shard == s) for s in range(8)]
    assert len(got) == n and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert all(c == list(range(len(c))) for c in counts)
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in got)


def test_zone_map_prunes(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.format_string("l%d", F.col("id") % 5).alias("lang"), (F.col("id") + 1).alias("size"))
    out = shards(df, 16).cache()
    zones = hilbert.zone_map(out, ["a", "b"])
    wanted = out.filter("doc_id = 700").first()
    kept = {r.shard for r in hilbert.prune(zones, {"a": (wanted.a, wanted.a), "b": (wanted.b, wanted.b)}).collect()}
    assert wanted.shard in kept and len(kept) < 8


def test_documents_are_pruned(spark):
    """Of 64 shards of the documents, a reader of one language, source or eighth of the sizes reads a part."""
    from skylocus.llm import common

    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", F.octet_length("text").alias("n"), F.col("lang").alias("l"), F.col("source").alias("s"))
    classes = {"lang": hilbert.category_class(F.col("l")), "source": hilbert.category_class(F.col("s")), "size": hilbert.size_class(F.col("n"))}
    rows = hilbert.equal_cells(docs, classes, 7)
    zones = hilbert.zone_map(hilbert.shard(rows, {c: F.col(c) for c in classes}, 7, 64, ["doc_id"], ["doc_id"]), list(classes)).cache()
    cells = rows.select(*classes).collect()
    kept = {}
    for c in classes:
        values = sorted({r[c] for r in cells})
        wanted = [(v, v) for v in values] if c != "size" else [(k, k + 15) for k in range(0, 128, 16)]
        read = [hilbert.prune(zones, {c: w}).count() for w in wanted]
        kept[c] = sum(read) / len(read) / 64
    assert zones.count() == 64 and kept["lang"] < 0.5 and kept["source"] < 0.6 and kept["size"] < 0.6, kept


def test_query_against_brute_force(spark, sf_dir):
    from skylocus.llm import queries

    got = {r.doc_id: r for r in queries.op1_hilbert_shards(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert r["size"] == len(d.text.encode()) + 1 and r["text_crc32"] == zlib.crc32(d.text.encode()) and r["law"] == "rows"
    order = sorted(got.values(), key=lambda r: (r.shard, r.slot))
    assert [r["shard"] for r in order] == [k * 8 // len(order) for k in range(len(order))]
    # the order is the curve's, whose points are all found by walking it
    assert order == sorted(order, key=lambda r: (r.curve, r.text_md5, r.doc_id))
    want = {}
    classes = {"lang_cell": lambda d: int(hashlib.md5((d.lang or "").encode()).hexdigest()[:3], 16), "source_cell": lambda d: int(hashlib.md5((d.source or "").encode()).hexdigest()[:3], 16)}
    for cell, of in classes.items():
        numbers = sorted(of(d) for d in docs)
        for d in docs:
            want[cell, d.doc_id] = sum(x < of(d) for x in numbers) * 128 // len(docs)
    assert all(got[d.doc_id][c] == want[c, d.doc_id] for d in docs for c in classes)
