"""Near duplicates by the similarity of their shingles, found through SimHash tries.

The SimHash of a whole text differs in some ten bits between texts of similarity 0.8,
far beyond a budget that a trie walk can prune. So each text gets, besides that one,
SimHashes of a few of its shingles, drawn min-wise: two texts draw the same shingles
with the probability of their similarity, and then these fingerprints agree. The trie
self-join links the whole texts' fingerprints; the drawn ones have a budget of no bits,
as five shingles either agree or differ in some twenty bits, so equal ones meet. In
each bucket all texts are compared with one another by signatures of min-wise values,
but for pairs that others have joined already. What may be similar by these is a group
of candidates, whose texts are then all compared by their shingles themselves. A large
bucket or group is cut into blocks, so no task holds all of it and no pairs become rows:
first the texts of each block are compared, and with a few that all blocks have; then
the texts that are not in the largest component by that, and only these, are compared
with all others. So a group of copies that are all alike costs no more than its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, simhash

#: Fingerprints besides the whole text's, and the shingles drawn for each: at a similarity of 0.8, a pair
#: agrees in one with a probability of 1 - (1 - 0.8 ** 5) ** 16 = 0.998.
DRAWS, DRAWN = 16, 5
#: Values of a signature, 2 bits each. The similarity is estimated with a standard error of 0.03 at 0.8.
VALUES = 256
#: By how much the estimate may fall short of the similarity asked for: nearly five standard errors, as shingles are compared after it.
SLACK = 0.14
#: Members of a block of a large group, and bytes of their texts; and members that all its blocks have, about.
BLOCK, BLOCK_BYTES, SHARED = 1 << 10, 8 << 20, 16
#: Shingles whose values are computed at a time.
AT_ONCE = 1 << 12

_random = np.random.default_rng(42)
_FLIP = _random.integers(0, 1 << 64, VALUES, np.uint64)[:, None]
_TIMES = _random.integers(0, 1 << 64, VALUES, np.uint64)[:, None] | np.uint64(1)


def shingle_hashes(tokens: list[bytes], words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of ``tokens``, some at a time; fewer tokens than ``words`` are one shingle."""
    if len(tokens) <= words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tokens), seed)], np.uint64)
        return
    digest, n = xxhash.xxh64_intdigest, len(tokens) - words + 1
    for lo in range(0, n, AT_ONCE):
        part = tokens[lo : min(lo + AT_ONCE, n) + words - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False)], np.uint64)


def sketch(text: bytes | None, words: int = 5) -> tuple[bytes, bytes, list[int]]:
    """A digest of the text's words, its signature, and its fingerprints (signed; the whole text's first).

    A-Z are lower-cased. A null text is an empty one; texts without words are all alike.
    """
    tokens = (text or b"").lower().split()
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    drawn = np.zeros(VALUES, np.uint64)
    ones, n = np.zeros(simhash.BITS, np.int64), 0
    for hashes in shingle_hashes(tokens, words):
        values = (hashes ^ _FLIP) * _TIMES
        at = values.argmin(axis=1)
        value = values[np.arange(VALUES), at]
        less = value < least
        least[less], drawn[less] = value[less], hashes[at[less]]
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, simhash.BITS).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    bits = np.unpackbits(drawn[: DRAWS * DRAWN].astype(">u8").view(np.uint8)).reshape(DRAWS, DRAWN, simhash.BITS).sum(axis=1)
    prints = np.packbits(np.concatenate(([2 * ones > n], 2 * bits > DRAWN)), axis=1).view(">i8").ravel()
    planes = np.packbits(np.stack((least & np.uint64(1), least >> np.uint64(1) & np.uint64(1))).astype(np.uint8), axis=1)
    return hashlib.md5(b" ".join(tokens)).digest(), planes.tobytes(), prints.tolist()


def sketches(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``row`` (the text's XXH64), ``digest``, ``signature`` and ``prints`` of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, signatures, prints = zip(*(sketch(x.as_py(), words) for x in batch.column(2)), strict=True) if batch.num_rows else ((), (), ())
            columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(prints, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "digest", "signature", "prints"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, digest binary, signature binary, prints array<long>")


def agreeing(signatures: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many values each row of ``signatures`` (words of either plane of bits) agrees with ``other``."""
    apart = signatures ^ other
    half = apart.shape[-1] // 2
    return VALUES - np.bitwise_count(apart[..., :half] | apart[..., half:]).sum(axis=-1, dtype=np.int32)


def enough_values(similarity: float) -> float:
    """Values that agree at ``similarity``, as expected: two bits agree by chance in a quarter of the others."""
    return (similarity + (1 - similarity) / 4) * VALUES


def reached(signatures: np.ndarray, enough: float) -> tuple[list[int], list[int]]:
    """Links (u, v) that join what chains of rows agreeing in ``enough`` values or more join, a forest.

    Each row is compared with all that no chain has reached yet, so only pairs in one component are left out.
    """
    u, v, left = [], [], np.arange(len(signatures))
    rows = signatures
    while len(left):
        queue = [int(left[0])]
        left, rows = left[1:], rows[1:]
        while queue and len(left):
            x = queue.pop()
            near = agreeing(rows, signatures[x]) >= enough
            if near.any():
                found = left[near].tolist()
                u += found
                v += [x] * len(found)
                queue += found
                left, rows = left[~near], rows[~near]
    return u, v


def between(signatures: np.ndarray, enough: float, roots: np.ndarray, asks: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (u, v) from each row that ``asks`` to a row of each other root that agrees in ``enough`` values or more, if it has one among the others."""
    u, v, others = [], [], np.flatnonzero(~asks)
    rows = signatures[others]
    for x in np.flatnonzero(asks).tolist():
        found = others[(agreeing(rows, signatures[x]) >= enough) & (roots[others] != roots[x])]
        found = found[np.unique(roots[found], return_index=True)[1]].tolist()
        u += found
        v += [x] * len(found)
    return u, v


def _links(members: DataFrame, values: DataFrame, within, across) -> DataFrame:
    """Links (u, v) that join what similarity joins in each ``group`` of ``members`` (group, blocks, node); ``values`` are (node, value).

    ``within(values)`` and ``across(values, roots, asks)`` give links of the rows of a task.
    A group of one block is a task. Of a larger one, each block is a task, which also has
    some members that all blocks have. Members that aren't in the group's largest component
    then ask all blocks; any other pair is in that component already.
    """
    home = members.withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    is_shared = F.pmod(F.xxhash64("node", F.lit("shared")), F.greatest(F.lit(1), F.col("blocks") * F.lit(BLOCK // SHARED))) == 0
    shared = home.filter((F.col("blocks") > 1) & is_shared).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("at <> own")
    rows = home.select(F.xxhash64("group", "own").alias("task"), "node").unionByName(shared.select(F.xxhash64("group", "at").alias("task"), "node"))
    first = _by_task(rows.join(values, "node").select("task", "node", "value"), within)
    if home.filter("blocks > 1").isEmpty():
        return first
    roots = simhash.components(first)
    large = home.filter("blocks > 1").join(roots.withColumnRenamed("root", "other"), "node", "left").withColumn("root", F.coalesce("other", "node"))
    counts = large.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("group").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    large = common.checkpoint(large.select("group", "blocks", "node", "own", "root").join(largest, "group"))
    asking = large.filter("root <> largest")
    sizes = asking.join(values.select("node", F.octet_length("value").alias("bytes")), "node").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    parts = large.join(sizes.select("group", _blocks("n", "bytes").alias("askers")), "group")
    asked = parts.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("askers") - 1))).withColumn("i", F.col("own")).withColumn("asks", F.lit(False))
    asking = parts.filter("root <> largest").withColumn("j", F.pmod(F.xxhash64("node", F.lit("asks")), F.col("askers")).cast("int"))
    asking = asking.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    rows = asked.unionByName(asking.select(asked.columns)).select(F.xxhash64("group", "i", "j").alias("task"), "node", "root", "asks")
    second = _by_task(rows.join(values, "node").select("task", "node", "value", "root", "asks"), across)
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(second)


def _blocks(n: str, size: str) -> Column:
    """How many blocks so many members of so many bytes together make: one at least, and no more than members."""
    return F.greatest(F.ceil(F.col(n) / BLOCK), F.least(F.col(n), F.ceil(F.coalesce(size, F.lit(0)) / BLOCK_BYTES)), F.lit(1)).cast("int")


def _by_task(rows: DataFrame, of) -> DataFrame:
    """Links (u, v) of ``of(values)`` for each task of ``rows`` (task, node, value, and what else ``of`` takes); a task's rows are in one partition."""
    more = rows.columns[3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.whole_groups(batches, "task", 1):
            task, nodes, values, rest = part["task"].to_numpy(), part["node"].to_numpy(), part["value"].to_pylist(), [part[c].to_numpy() for c in more]
            edges = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
            us, vs = [], []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi - lo > 1:
                    u, v = of(values[lo:hi], *(x[lo:hi] for x in rest))
                    us.append(nodes[lo:hi][u])
                    vs.append(nodes[lo:hi][v])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], ["u", "v"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "u long, v long")


def candidate_links(classes: DataFrame, similarity: float, errors: int = 4) -> DataFrame:
    """Links (u, v) that join the ``node`` rows of ``classes`` (node, signature, prints) that meet and may be similar, by their signatures."""
    whole = classes.select("node", F.get("prints", F.lit(0)).alias("fingerprint"))
    roots = simhash.components(simhash.links(common.checkpoint(whole.select("fingerprint").distinct()), errors))
    whole = whole.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    drawn = classes.select("node", F.posexplode(F.slice("prints", 2, DRAWS)).alias("draw", "fingerprint"))
    members = whole.select(F.xxhash64(F.lit(-1), F.coalesce("root", "fingerprint")).alias("bucket"), "node")
    members = members.unionByName(drawn.select(F.xxhash64("draw", "fingerprint").alias("bucket"), "node"))
    # buckets of the same texts are one group
    sets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"set{k}") for k in (0, 1)))
    sets = sets.filter("n > 1").select("bucket", F.xxhash64("n", "set0", "set1").alias("group"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    meetings = common.checkpoint(members.join(sets, "bucket").select("group", "blocks", "node").distinct())
    enough = enough_values(similarity - SLACK)
    rows_of = lambda values: np.frombuffer(b"".join(values), np.uint64).reshape(len(values), -1)
    return _links(
        meetings, classes.select("node", F.col("signature").alias("value")),
        lambda values: reached(rows_of(values), enough), lambda values, roots, asks: between(rows_of(values), enough, roots, asks),
    )


def exact_links(texts: list[bytes | None], words: int, similarity: float) -> tuple[list[int], list[int]]:
    """Links (u, v) that join what chains of texts with a Jaccard similarity of ``similarity`` or more join, a forest.

    All pairs are compared by their sets of shingles (as XXH64), but for those in one
    component already and those whose sizes alone keep them below.
    """
    sets = [np.unique(np.concatenate(list(shingle_hashes((t or b"").lower().split(), words)))) for t in texts]
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets = [sets[k] for k in order]
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    marked = np.zeros(int(ids.max()) + 1, bool)
    # in whole numbers, so that no float decides at the limit itself
    part, whole = round(similarity * 10**6), 10**6
    u, v, left, n, flat = [], [], np.arange(len(sets)), sizes, ids
    while len(left):
        queue = [int(left[0])]
        left, flat, n = left[1:], flat[n[0] :], n[1:]
        starts = np.concatenate(([0], np.cumsum(n)))
        while queue and len(left):
            x = queue.pop()
            lo, hi = np.searchsorted(n * whole, sizes[x] * part), np.searchsorted(n * part, sizes[x] * whole, "right")
            if lo >= hi:
                continue
            own = ids[ends[x] - sizes[x] : ends[x]]
            marked[own] = True
            both = np.add.reduceat(marked[flat[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
            marked[own] = False
            near = np.zeros(len(left), bool)
            near[lo:hi] = both * whole >= (n[lo:hi] + sizes[x] - both) * part
            if near.any():
                found = left[near].tolist()
                u += found
                v += [x] * len(found)
                queue += found
                flat = flat[np.repeat(~near, n)]
                left, n = left[~near], n[~near]
                starts = np.concatenate(([0], np.cumsum(n)))
    return order[u].tolist() if u else [], order[v].tolist() if v else []


def exact_between(texts: list[bytes | None], words: int, similarity: float, roots: np.ndarray, asks: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (u, v) from each text that ``asks`` to a text of each other root with a Jaccard similarity of ``similarity`` or more, if it has one among the others."""
    sets = [np.unique(np.concatenate(list(shingle_hashes((t or b"").lower().split(), words)))) for t in texts]
    sizes, others = np.array([len(x) for x in sets]), np.flatnonzero(~asks)
    if not len(others) or not asks.any():
        return [], []
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    flat = np.concatenate([ids[ends[k] - sizes[k] : ends[k]] for k in others])
    n = sizes[others]
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    marked = np.zeros(int(ids.max()) + 1, bool)
    part, whole = round(similarity * 10**6), 10**6
    u, v = [], []
    for x in np.flatnonzero(asks).tolist():
        own = ids[ends[x] - sizes[x] : ends[x]]
        marked[own] = True
        both = np.add.reduceat(marked[flat], starts, dtype=np.int64)
        marked[own] = False
        found = others[(both * whole >= (n + sizes[x] - both) * part) & (roots[others] != roots[x])]
        found = found[np.unique(roots[found], return_index=True)[1]].tolist()
        u += found
        v += [x] * len(found)
    return u, v


def similar_links(classes: DataFrame, texts: DataFrame, own: DataFrame, words: int, similarity: float, errors: int = 4) -> DataFrame:
    """Links (u, v) between ``node`` rows of ``classes`` whose texts are similar: all pairs that candidates join are compared.

    ``own`` (node, id, row) says which of ``texts`` (id, row, text) is a node's.
    """
    roots = simhash.components(candidate_links(classes, similarity, errors))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    wanted = members.join(own, "node")
    sized = texts.join(wanted, ["id", "row"]).select("node", F.col("root").alias("group"), F.col("text").alias("value"))
    sized = common.checkpoint(sized.dropDuplicates(["node"]))
    groups = sized.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("bytes"))
    members = sized.select("group", "node").join(groups.select("group", _blocks("n", "bytes").alias("blocks")), "group")
    return _links(
        members, sized.select("node", "value"),
        lambda values: exact_links(values, words, similarity), lambda values, roots, asks: exact_between(values, words, similarity, roots, asks),
    )


def without_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, errors: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of its smallest doc_id, and of the smallest digest where texts share that.

    Groups are chains of texts whose shingles of ``words`` words have a Jaccard
    similarity of ``similarity`` or more, of those that meet. Texts with equal words
    are one text. Rows without an id stay; rows with equal ids and
    unlike texts are documents of their own; null and empty texts are alike; an empty table gives no rows;
    columns may have any names.
    """
    # copies are one class from here on, however many there are; it is known by its digest, as ids may repeat
    known = sketches(docs, words).filter("doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "row"))
    classes = known.groupBy("digest").agg(first.alias("first"), F.first("signature").alias("signature"), F.first("prints").alias("prints"))
    classes = common.checkpoint(classes.withColumn("node", F.xxhash64("digest")))
    id_, row = F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("row")
    own = classes.select("node", F.col("first.doc_id").alias("id"), F.col("first.row").alias("row"))
    texts = docs.select(id_, row, F.col("text").cast("binary").alias("text"))
    roots = simhash.components(similar_links(classes.select("node", "signature", "prints"), texts, own, words, similarity, errors))
    grouped = classes.select("node", "first", "digest").join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
    kept = grouped.groupBy("group").agg(F.min(F.struct("first.doc_id", "digest", "first.row")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("id"), F.col("k.row").alias("row"))
    # the documents as structs, so that their columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), id_, row)
    out = rows.join(kept, ["id", "row"], "left_semi").dropDuplicates(["id", "row"])
    return out.unionByName(rows.filter("id IS NULL")).select("doc.*")
