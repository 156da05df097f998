"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints that differ in at most ``errors`` bits are linked, and linked
documents make a component. Only distinct fingerprints enter the join. The trie
is walked as pairs of nodes: a pair splits by the next bit into pairs of
children, differing bits add up, and a pair beyond the error budget is dropped.

To spread the walk, the 64 bits are cut into ``errors + 1`` blocks. Two linked
fingerprints agree in a whole block at least, so for each block a trie that has
this block's bits first finds them below one node. Each such node is a task of
its own. A task with many fingerprints is replaced by the tasks of its pairs of
child nodes, which the budget prunes, until all are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 64
#: Shingles hashed at a time, so that a long text needs little memory besides itself.
SHINGLES_AT_ONCE = 1 << 16
#: A task with more fingerprints than this is split by this many bits.
TASK_ROWS = 1 << 16
SPLIT_BITS = 3
#: Pairs of nodes with at most so many pairs of fingerprints are compared directly.
LEAF_PAIRS = 1 << 10
#: Fingerprints walked together, and pairs compared at once.
WALK_ROWS = 1 << 17
COMPARE_AT_ONCE = 1 << 21
#: Links that a task draws stars of at once.
LINKS_AT_ONCE = 1 << 20


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a text, as an unsigned 64-bit int.

    A-Z are lower-cased; shingles are ``words`` words joined by spaces, repeats
    included, or all words where there are fewer. A bit is 1 if more than half of
    the shingles' XXH64 have it. A null text and one without words give 0.
    """
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    digest = xxhash.xxh64_digest
    n = len(tokens) - words + 1
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, SHINGLES_AT_ONCE):
        part = tokens[lo : min(lo + SHINGLES_AT_ONCE, n) + words - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (the bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


def blocks(errors: int) -> list[tuple[int, int]]:
    """Start and width of each block of bits, from the highest bit."""
    cuts = [round(BITS * k / (errors + 1)) for k in range(errors + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def least_reachable(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest of ``n`` numbered nodes that each can reach over the links x, y."""
    root = np.arange(n)
    while True:
        x, y = root[x], root[y]
        apart = x != y
        x, y = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        if not len(x):
            return root
        np.minimum.at(root, y, x)
        while True:  # follow the roots to their ends
            up = root[root]
            if (up == root).all():
                break
            root = up


class Walk:
    """The walk of pairs of trie nodes over arrays of fingerprints, as far as it takes to join components.

    A node is a range of ``keys`` (sorted in each task's side) with a common prefix.
    """

    def __init__(self, keys: np.ndarray, errors: int) -> None:
        self.keys, self.errors = keys, errors
        self.component = np.arange(len(keys))
        self.changes: np.ndarray | None = None
        self.ones: dict[int, np.ndarray] = {}

    def ones_before(self, depth: int) -> np.ndarray:
        if depth not in self.ones:
            bit = (self.keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            self.ones[depth] = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        return self.ones[depth]

    def joined(self, nodes: np.ndarray) -> np.ndarray:
        """Which pairs lie in one component already."""
        if self.changes is None:
            self.changes = np.concatenate(([0], np.cumsum(self.component[1:] != self.component[:-1])))
        a, a_end, b, b_end = nodes
        one = (self.changes[a] == self.changes[a_end - 1]) & (self.changes[b] == self.changes[b_end - 1])
        return one & (self.component[a] == self.component[b])

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        """Join the components of linked fingerprints."""
        x, y = self.component[u], self.component[v]
        apart = x != y
        if not apart.any():
            return
        edges = np.unique(np.minimum(x, y)[apart] * np.int64(len(self.keys)) + np.maximum(x, y)[apart])
        self.component = least_reachable(len(self.keys), edges // len(self.keys), edges % len(self.keys))[self.component]
        self.changes = None

    def compare(self, nodes: np.ndarray, same: np.ndarray) -> None:
        """Compare all fingerprints of small pairs of nodes directly."""
        sizes = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
        ends = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + COMPARE_AT_ONCE, "right")))
            part, n = nodes[:, first:last], sizes[first:last]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(part[3] - part[2], n)
            u, v = np.repeat(part[0], n) + at // wide, np.repeat(part[2], n) + at % wide
            keep = ~np.repeat(same[first:last], n) | (u < v)
            u, v = u[keep], v[keep]
            near = np.bitwise_count(self.keys[u] ^ self.keys[v]) <= self.errors
            self.link(u[near], v[near])
            first = last

    def run(self, nodes: np.ndarray, depth: np.ndarray, diff: np.ndarray) -> np.ndarray:
        """Walk from the given pairs of nodes (rows: start and end of either); returns the component of each key."""
        stack = [(int(d), nodes[:, depth == d], diff[depth == d]) for d in np.unique(depth)]
        while stack:
            level, pairs, spent = stack.pop()
            if pairs.shape[1] > WALK_ROWS:
                half = pairs.shape[1] // 2
                stack += [(level, pairs[:, half:], spent[half:]), (level, pairs[:, :half], spent[:half])]
                continue
            open_pairs = ~self.joined(pairs)
            pairs, spent = pairs[:, open_pairs], spent[open_pairs]
            same = pairs[0] == pairs[2]
            small = ((pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= LEAF_PAIRS) | (level >= BITS)
            if small.any():
                self.compare(pairs[:, small], same[small])
            pairs, spent, same = pairs[:, ~small], spent[~small], same[~small]
            if not pairs.shape[1]:
                continue
            ones = self.ones_before(level)
            a, a_end, b, b_end = pairs
            a_mid, b_mid = a_end - (ones[a_end] - ones[a]), b_end - (ones[b_end] - ones[b])
            children = [
                (np.array([a_mid, a_end, b_mid, b_end]), spent, np.ones_like(same)),
                (np.array([a, a_mid, b, b_mid]), spent, np.ones_like(same)),
                (np.array([a, a_mid, b_mid, b_end]), spent + 1, np.ones_like(same)),
                (np.array([a_mid, a_end, b, b_mid]), spent + 1, ~same),
            ]
            kept = [((c[1] > c[0]) & (c[3] > c[2]) & (s <= self.errors) & use) for c, s, use in children]
            # unlike children go below like ones, so that these join components first
            for among in ((2, 3), (0, 1)):
                pairs = np.concatenate([children[k][0][:, kept[k]] for k in among], axis=1)
                if pairs.shape[1]:
                    stack.append((level + 1, pairs, np.concatenate([children[k][1][kept[k]] for k in among])))
        return self.component


def _walk_tasks(errors: int):
    """A function for sorted rows of tasks (block, a, b, depth, diff, side, key), giving (fingerprint, root)."""
    starts = np.array([s for s, _ in blocks(errors)], np.uint64)

    def of(rows: pa.Table) -> pa.RecordBatch:
        block, a, b, depth, diff, side, key = (rows.column(k).to_numpy() for k in range(7))
        edge = np.flatnonzero((block[1:] != block[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        first, last = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
        seconds = np.concatenate(([0], np.cumsum(side)))
        middle = last - (seconds[last] - seconds[first])
        twofold = a[first] != b[first]
        nodes = np.array([first, np.where(twofold, middle, last), np.where(twofold, middle, first), last])
        full = (nodes[1] > nodes[0]) & (nodes[3] > nodes[2])
        walk = Walk(key.view(np.uint64), errors)
        component = walk.run(nodes[:, full], depth[first][full], diff[first][full])
        # a component's smallest key is its first one within its block and task only; any member will do as its root
        own = np.flatnonzero(component != np.arange(len(key)))
        turn = starts[block[own]]
        back = (np.uint64(BITS) - turn) % np.uint64(BITS)

        def turned_back(x: np.ndarray) -> np.ndarray:
            return ((x << back) | (x >> (np.uint64(BITS) - back) % np.uint64(BITS))) if len(x) else x

        keys = key.view(np.uint64)
        u, v = turned_back(keys[own]), turned_back(keys[component[own]])
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < WALK_ROWS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            block, a, b = (rows.column(k).to_numpy() for k in range(3))
            same = (block == block[-1]) & (a == a[-1]) & (b == b[-1])
            cut = len(same) - (int(np.argmin(same[::-1])) if not same.all() else len(same))
            if cut:
                yield of(rows.slice(0, cut))
            rest = rows.slice(cut)
            held, n = rest.to_batches(), rest.num_rows
        if n:
            yield of(pa.Table.from_batches(held).combine_chunks())

    return run


def links(prints: DataFrame, errors: int = 4, task_rows: int = TASK_ROWS) -> DataFrame:
    """Links (u, v) that join the linked ones of distinct ``fingerprint`` rows: a forest in each task, not all pairs."""
    turned = []
    for k, (start, width) in enumerate(blocks(errors)):
        fp = F.col("fingerprint")
        key = F.shiftleft(fp, start).bitwiseOR(F.shiftrightunsigned(fp, BITS - start)) if start else fp
        node = F.shiftrightunsigned(key, BITS - width)
        turned.append(F.struct(F.lit(k).alias("block"), node.alias("a"), node.alias("b"), F.lit(width).alias("depth"), F.lit(0).alias("diff"), F.lit(0).alias("side"), key.alias("key")))
    rows = prints.select(F.explode(F.array(*turned)).alias("t")).select("t.*")
    task = ["block", "a", "b"]
    done: list[DataFrame] = []
    while True:
        counts = rows.groupBy(*task, "depth").agg(F.count(F.lit(1)).alias("n"))
        heavy = counts.filter((F.col("n") > task_rows) & (F.col("depth") < BITS)).select(*task)
        heavy = common.checkpoint(heavy)
        if heavy.isEmpty():
            break
        done.append(rows.join(heavy, task, "left_anti").select(rows.columns))
        rows = common.checkpoint(_split(rows.join(heavy, task).select(rows.columns), errors))
    done.append(rows)
    for more in done[1:]:
        done[0] = done[0].unionByName(more)
    return done[0].repartition(*task).sortWithinPartitions(*task, "side", "key").mapInArrow(_walk_tasks(errors), "u long, v long")


def _split(rows: DataFrame, errors: int) -> DataFrame:
    """Rows of tasks dealt to the tasks of their pairs of nodes some bits deeper, without those that lack a side."""
    width = F.least(F.lit(SPLIT_BITS), F.lit(BITS) - F.col("depth"))
    shift = lambda x, n, how: F.call_function(how, x, n)
    mask = shift(F.lit(1), width, "shiftleft") - 1
    own = shift(F.col("key"), F.lit(BITS) - F.col("depth") - width, "shiftrightunsigned").bitwiseAND(mask.cast("long")).cast("int")
    rows = rows.withColumn("own", own).withColumn("width", width)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), mask)))
    rows = rows.withColumn("diff", F.col("diff") + F.bit_count(F.col("own").bitwiseXOR(F.col("other")))).filter(F.col("diff") <= errors)
    alike = F.col("a") == F.col("b")
    # in a pair of a node with itself, the smaller child comes first; else the row keeps its side
    first = F.when(alike, F.col("own") <= F.col("other")).otherwise(F.col("side") == 0)
    mine = lambda node: shift(F.col(node), F.col("width"), "shiftleft")
    out = rows.select(
        "block",
        (mine("a") + F.when(first, F.col("own")).otherwise(F.col("other"))).alias("a2"),
        (mine("b") + F.when(first, F.col("other")).otherwise(F.col("own"))).alias("b2"),
        (F.col("depth") + F.col("width")).alias("depth"), "diff", F.when(first, 0).otherwise(1).alias("side"), "key",
    ).withColumnsRenamed({"a2": "a", "b2": "b"})
    whole = out.groupBy("block", "a", "b").agg(F.min("side").alias("low"), F.max("side").alias("high"))
    whole = whole.filter((F.col("a") == F.col("b")) | (F.col("low") < F.col("high"))).select("block", "a", "b")
    return out.join(whole, ["block", "a", "b"], "left_semi").select("block", "a", "b", "depth", "diff", "side", "key")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each so many links (u, v), those from every node to the smallest that it can reach over them."""

    def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        nodes, at = np.unique(np.concatenate((rows["u"].to_numpy(), rows["v"].to_numpy())), return_inverse=True)
        root = least_reachable(len(nodes), at[: rows.num_rows], at[rows.num_rows :])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["u", "v"])

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while n + batch.num_rows >= LINKS_AT_ONCE:
            yield of([*held, batch.slice(0, LINKS_AT_ONCE - n)])
            batch, held, n = batch.slice(LINKS_AT_ONCE - n), [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield of(held)


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """The smallest node reachable (``root``) of each ``node`` in ``edges`` (u, v): stars drawn to smaller nodes until nothing moves.

    Tasks first draw the stars of some links each, of bounded number. Where one task
    has them all, these are the components. Else each node links its larger neighbours,
    and then its smaller ones, to the smallest that it sees, and tasks contract again.
    Minima are aggregated before they are joined back, so a node with very many
    neighbours is a skewed join, which Spark splits, and never a group held by one task.
    """
    edges = common.checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v"))
    n, before = edges.count(), None
    for _ in range(max_rounds):
        tasks = n // LINKS_AT_ONCE + 1
        stars = edges.coalesce(tasks).mapInArrow(_contracted, "u long, v long")
        edges = common.checkpoint(stars if tasks == 1 else stars.distinct())
        if tasks == 1:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        edges = joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = common.checkpoint(edges.filter("u <> v").distinct())
        n = edges.count()
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, errors: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of each row of ``docs``.

    The component is the smallest doc_id that links lead to, the row's own included;
    copies share a fingerprint and so a component. Null ids count for no minimum (a
    component with null ids only has a null id); repeated rows stay; an empty table
    gives no rows; other columns are ignored.
    """
    prints = common.checkpoint(fingerprints(docs, doc_id, text, words))
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    distinct = common.checkpoint(distinct)
    roots = components(links(distinct.select("fingerprint"), errors))
    rooted = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(named, "root").select("fingerprint", "component_id")
    out = prints.join(named, "fingerprint")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, words: int = 4, errors: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id. Rows without an id stay, and columns may have any names."""
    found = near_duplicates(docs, words=words, errors=errors).filter("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("id"))
    kept = rows.join(found, "id", "left_semi").dropDuplicates(["id"])
    return kept.unionByName(rows.filter("id IS NULL")).select("doc.*")
