"""Language-model scores by context-tree weighting.

A byte is eight binary decisions. Each of the 255 prefixes of a byte has a context
tree over the bytes before, and every node of it estimates its decision's
probability with the Krichevsky-Trofimov estimator. A node's weighted probability of
what was learned is half its own estimate and half the product of its children's, so
all depths are mixed, each as far as it has proved itself. After learning the counts
are frozen, and a text's code length is the sum over its bytes.

Contexts are the bytes before, to a fixed depth. All distinct cells (a context and its
byte) of the corpus are a distributed table, which grows with the texts. It is dealt and
sorted by the nearest bytes of context, all but two, and the trees below these are made
for many of them at a time: they give what they have learned to the contexts of one byte
less, whose estimates are broadcast, and then each cell's probability. So a tree has
2 ** 24 cells at most, and there are 2 ** 16 contexts to broadcast at most, of which texts
have some thousands. Blocks of documents send their distinct cells there and get these back.

``fit`` is the small model for one machine: a context byte counts by its class, of
which there are 32, so its table is 33 MB at depth 3 whatever the corpus is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CLASSES = 32
#: Bytes of context, and the most that keep trees and broadcast bounded.
DEPTH, DEEPEST = 4, 5
#: Bytes whose cells are counted or looked up at a time.
AT_ONCE = 1 << 19
#: Cells whose trees are made at a time, or all below the nearest bytes of context.
CELLS_AT_ONCE = 1 << 20
#: Bytes of text that are scored together, and their words' counts fetched.
BLOCK_BYTES = 32 << 20
#: Rows of a block's counts that are given out at a time.
ROWS_AT_ONCE = 1 << 16


def byte_classes() -> np.ndarray:
    """The class of each byte as context: a letter of either case, space, digits, marks, and the parts of longer characters."""
    out = np.full(256, 29, np.int64)  # ASCII marks
    out[:0x21] = out[0x7F] = 31
    out[[0x20, *range(0x09, 0x0E)]] = 0
    for k in range(26):
        out[ord("a") + k] = out[ord("A") + k] = 1 + k
    out[0x30:0x3A] = 27
    out[0x80:0xC0] = 28
    out[0xC0:] = 30
    return out


_CLASS = byte_classes()
_BYTE = np.arange(256)


def cells(text: bytes, depth: int, kinds: np.ndarray = _CLASS, n_kinds: int = CLASSES) -> Iterator[np.ndarray]:
    """``context * 256 + byte`` of each byte, some at a time; the text begins after spaces. The nearest byte leads the context."""
    for lo in range(0, len(text), AT_ONCE):
        own = np.frombuffer(text, np.uint8, min(AT_ONCE, len(text) - lo), lo)
        before = text[max(0, lo - depth) : lo].rjust(depth)
        classes = kinds[np.frombuffer(before + own.tobytes(), np.uint8)]
        n = len(own)
        context = np.zeros(n, np.int64)
        for k in range(1, depth + 1):
            context = context * n_kinds + classes[depth - k : depth - k + n]
        yield context * 256 + own


def count_cells(docs: DataFrame, text: str, depth: int) -> DataFrame:
    """How often each cell occurs in all texts: ``cell`` and ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0

        def merge() -> None:
            nonlocal keys, ns, held, size
            new, n = np.unique(np.concatenate(held), return_counts=True)
            both, at = np.unique(np.concatenate((keys, new)), return_inverse=True)
            keys, ns = both, np.bincount(at, np.concatenate((ns, n)), len(both)).astype(np.int64)
            held, size = [], 0

        for batch in batches:
            for value in batch.column(0):
                for part in cells(value.as_py() or b"", depth):
                    held.append(part)
                    size += len(part)
                    if size >= AT_ONCE:
                        merge()
        if held:
            merge()
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ns)], ["cell", "n"])

    counted = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "cell long, n long")
    return counted.groupBy("cell").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for x of 0.5 or more, by Stirling's series from x + 8 on."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def decisions(counts: np.ndarray) -> np.ndarray:
    """From counts (..., 256) of bytes, counts (..., 256, 2) of the decisions at each prefix.

    Prefixes are numbered as in a heap: 1 is empty, and 2p, 2p + 1 follow p by a bit.
    """
    out = np.zeros((*counts.shape, 2))
    for level in range(8):
        n = counts.reshape(*counts.shape[:-1], 1 << level, 2, 1 << (7 - level)).sum(axis=-1)
        out[..., 1 << level : 2 << level, :] = n
    return out


def kt_log(n: np.ndarray) -> np.ndarray:
    """The estimator's log probability of ``n[..., 0]`` zeros and ``n[..., 1]`` ones."""
    out = np.zeros(n.shape[:-1])
    seen = n.sum(axis=-1) > 0
    a, b = n[seen, 0], n[seen, 1]
    out[seen] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)
    return out


def model(cell: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """The table of log10 probabilities, ``[context * 256 + byte]``, from the counts of cells."""
    counts = np.zeros((CLASSES**depth, 256))
    counts.reshape(-1)[cell] = n
    by_depth = [counts.reshape(CLASSES**k, -1, 256).sum(axis=1) for k in range(depth)] + [counts]
    weighted = None
    stops: list[np.ndarray] = [None] * (depth + 1)
    ones: list[np.ndarray] = [None] * (depth + 1)
    for k in range(depth, -1, -1):
        contexts = len(by_depth[k])
        own = np.empty((contexts, 256))
        p = np.empty((contexts, 256), np.float32)
        for lo in range(0, contexts, 1024):
            part = decisions(by_depth[k][lo : lo + 1024])
            own[lo : lo + 1024] = kt_log(part)
            p[lo : lo + 1024] = (part[..., 1] + 0.5) / (part.sum(axis=-1) + 1)
        ones[k] = p
        if k == depth:
            weighted = own
        else:
            below = weighted.reshape(contexts, CLASSES, 256).sum(axis=1)
            weighted = np.logaddexp(own, below) + math.log(0.5)
            stops[k] = np.exp(own + math.log(0.5) - weighted).astype(np.float32)
    table = np.empty((CLASSES**depth, 256), np.float32)
    width = CLASSES ** max(0, depth - 1)
    for first in range(0, CLASSES**depth, width):  # a slab of contexts at a time
        p = ones[depth][first : first + width].astype(np.float64)
        for k in range(depth - 1, -1, -1):
            at = np.arange(first, first + width) // CLASSES ** (depth - k)
            p = stops[k][at] * ones[k][at] + (1 - stops[k][at]) * p
        logs = np.log10(np.stack((1 - p, p), axis=-1))
        out = np.zeros((len(p), 1))
        for level in range(8):
            step = logs[:, 1 << level : 2 << level, :]
            out = (out[:, :, None] + step).reshape(len(p), -1)
        table[first : first + width] = out
    return table.reshape(-1)


def fit(learned: DataFrame, text: str = "text", depth: int = 3) -> np.ndarray:
    """Learn from all rows of ``learned``. At most ``32 ** depth * 256`` counts reach the driver, for any input."""
    if CLASSES**depth > 1 << 15:
        raise ValueError("the table would be larger than its bound; the depth is 3 at most")
    found = count_cells(learned, text, depth).toArrow()
    return model(found["cell"].to_numpy(), found["n"].to_numpy(), depth)


def score(text: bytes | None, table: np.ndarray, depth: int) -> float:
    """The model's log10 probability of a text's bytes (null or empty: 0)."""
    return float(sum(table[part].sum(dtype=np.float64) for part in cells(text or b"", depth)))


def byte_cells(texts: list[bytes], depth: int) -> Iterator[np.ndarray]:
    """The cells of byte contexts of all texts, some at a time."""
    held, size = [], 0
    for text in texts:
        for part in cells(text, depth, _BYTE, 256):
            held.append(part)
            size += len(part)
            if size >= AT_ONCE:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


class Counts:
    """Distinct keys, sorted, and how often those that are learned from have each."""

    def __init__(self) -> None:
        self.keys, self.n, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.new: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, by: int) -> None:
        found = pa.array(keys).value_counts()
        self.new.append((found.field(0).to_numpy(), found.field(1).to_numpy() * by))
        self.held += len(self.new[-1][0])
        if self.held > AT_ONCE:
            self.merge()

    def merge(self) -> None:
        """Add what is new in place, so that little is held twice."""
        if not self.new:
            return
        keys, at = np.unique(np.concatenate([k for k, _ in self.new]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n for _, n in self.new]), len(keys)).astype(np.int64)
        self.new, self.held = [], 0
        place = np.searchsorted(self.keys, keys)
        there = place < len(self.keys)
        there[there] = self.keys[place[there]] == keys[there]
        self.n[place[there]] += n[there]
        self.n = np.insert(self.n, place[~there], n[~there])
        self.keys = np.insert(self.keys, place[~there], keys[~there])

    def batches(self, *first: int) -> Iterator[pa.RecordBatch]:
        """Rows of ``first``, key and count, some at a time."""
        self.merge()
        for lo in range(0, len(self.keys), ROWS_AT_ONCE):
            keys, n = self.keys[lo : lo + ROWS_AT_ONCE], self.n[lo : lo + ROWS_AT_ONCE]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(keys), x, np.int32)) for x in first), pa.array(keys), pa.array(n)], ["kind", "block", "key", "n"])


def some_texts(column: pa.Array, marks: list | None = None) -> Iterator[tuple[list[bytes], object]]:
    """A column's texts (null: empty), of ``AT_ONCE`` bytes or one at a time, in order; those of one mark together, with the mark."""
    held, size, mark = [], 0, None
    for k, value in enumerate(column):
        text = value.as_py() or b""
        own = marks[k] if marks else None
        if held and (size + len(text) > AT_ONCE or own != mark):
            yield held, mark
            held, size = [], 0
        held.append(text)
        size, mark = size + len(text), own
    if held:
        yield held, mark


def nearest_bytes(depth: int) -> int:
    """By how many bytes of context the cells are dealt: two are left below, and never less than two above."""
    return max(2, depth - 2)


class Tree:
    """The trees of the cells below some contexts of ``top`` bytes, one for each prefix of a byte; ``cell`` is sorted and distinct."""

    def __init__(self, cell: np.ndarray, n: np.ndarray, depth: int) -> None:
        self.depth, self.top, self.keys, self.counts = depth, nearest_bytes(depth), {depth: cell}, {depth: n.astype(np.float64)}
        for k in range(depth - 1, self.top - 1, -1):
            key = self.keys[k + 1] >> 16 << 8 | self.keys[k + 1] & 255
            self.keys[k], at = np.unique(key, return_inverse=True)
            self.counts[k] = np.bincount(at, self.counts[k + 1], len(self.keys[k]))

    def level(self, bits: int) -> tuple[dict, ...]:
        """By depth, for the prefixes of so many bits: nodes, their decisions, their parents' places, weighted logs, and shares of the own estimate."""
        ids, seen, up, weighted, stops = {}, {}, {}, {}, {}
        for k in range(self.top, self.depth + 1):
            node = self.keys[k] >> (8 - bits)
            starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            ones = np.add.reduceat(self.counts[k] * (self.keys[k] >> (7 - bits) & 1), starts)
            ids[k], seen[k] = node[starts], np.stack((np.add.reduceat(self.counts[k], starts) - ones, ones), axis=-1)
            if k > self.top:
                up[k] = np.searchsorted(ids[k - 1], ids[k] >> (8 + bits) << bits | ids[k] & ((1 << bits) - 1))
        for k in range(self.depth, self.top - 1, -1):
            own = kt_log(seen[k])
            if k == self.depth:
                weighted[k] = own
            else:
                weighted[k] = np.logaddexp(own, np.bincount(up[k + 1], weighted[k + 1], len(own))) + math.log(0.5)
                stops[k] = np.exp(own + math.log(0.5) - weighted[k])
        return ids, seen, up, weighted, stops

    def above(self, bits: int, ids: dict) -> tuple[np.ndarray, np.ndarray]:
        """The context of one byte less of each topmost node, and its prefix as numbered in a heap."""
        return ids[self.top] >> (bits + 8), 1 << bits | ids[self.top] & ((1 << bits) - 1)

    def learned(self) -> pa.RecordBatch:
        """What the topmost contexts give to those of one byte less: ``context``, ``prefix``, ``zeros``, ``ones`` and ``below``, a row for each of these."""
        parts = []
        for bits in range(8):
            ids, seen, _, weighted, _ = self.level(bits)
            parts.append((*self.above(bits, ids), seen[self.top][:, 0], seen[self.top][:, 1], weighted[self.top]))
        context, prefix, *sums = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, at = np.unique(context << 8 | prefix, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(key >> 8), pa.array(key & 255), *(pa.array(np.bincount(at, x, len(key))) for x in sums)], ["context", "prefix", "zeros", "ones", "below"])

    def logs(self, contexts: np.ndarray, known: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Each cell's log10 probability; ``known`` and ``rest`` [context, prefix] are the part of the estimates above and the share left."""
        out = np.zeros(len(self.keys[self.depth]))
        for bits in range(8):
            ids, seen, up, _, stops = self.level(bits)
            context, prefix = self.above(bits, ids)
            at = np.searchsorted(contexts, context), prefix
            p, share = known[at], rest[at]
            for k in range(self.top, self.depth + 1):
                if k > self.top:
                    p, share = p[up[k]], share[up[k]]
                here = (seen[k][:, 1] + 0.5) / (seen[k].sum(axis=-1) + 1)
                stop = stops.get(k, 1.0)
                p, share = p + share * stop * here, share * (1 - stop)
            cell = self.keys[self.depth]
            p = p[np.searchsorted(ids[self.depth], cell >> (8 - bits))]
            out += np.log10(np.where(cell >> (7 - bits) & 1, p, 1 - p))
        return out


def shallow(found: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of ``length`` bytes (one or two) that there are, and ``known`` and ``rest`` of ``Tree.logs`` for them, from the sums of ``Tree.learned``."""
    contexts, at = np.unique(found["context"].to_numpy(), return_inverse=True)
    seen, below = np.zeros((len(contexts), 256, 2)), np.zeros((len(contexts), 256))
    at = at, found["prefix"].to_numpy()
    seen[at] = np.stack((found["zeros"].to_numpy(), found["ones"].to_numpy()), axis=-1)
    below[at] = found["below"].to_numpy()
    # from the longest contexts to none: decisions, own and weighted logs, and each one's parent
    levels, names = [], contexts
    for _ in range(length + 1):
        own = kt_log(seen)
        weighted = np.logaddexp(own, below) + math.log(0.5)
        names, up = np.unique(names >> 8, return_inverse=True)
        levels.append((seen, own, weighted, up))
        used = np.where(seen.sum(axis=-1) > 0, weighted, 0)
        sums = np.zeros((len(names), 256, 2)), np.zeros((len(names), 256))
        np.add.at(sums[0], up, seen)
        np.add.at(sums[1], up, used)
        seen, below = sums
    known, rest = np.zeros((1, 256)), np.ones((1, 256))
    for seen, own, weighted, up in reversed(levels):
        stop = np.exp(own + math.log(0.5) - weighted)
        known = known[up] + rest[up] * stop * (seen[..., 1] + 0.5) / (seen.sum(axis=-1) + 1)
        rest = rest[up] * (1 - stop)
    return contexts, known, rest


def cell_logs(counted: DataFrame, depth: int) -> DataFrame:
    """``cell`` and ``p`` (log10) from the distinct cells (cell, n) of a corpus."""
    top = nearest_bytes(depth)
    rows = counted.select("cell", "n", F.shiftright("cell", 8 * (depth + 1 - top)).alias("nearest"))
    rows = common.checkpoint(rows.repartition("nearest").sortWithinPartitions("cell"))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
        for part in common.whole_groups(batches, "nearest", CELLS_AT_ONCE):
            yield Tree(part["cell"].to_numpy(), part["n"].to_numpy(), depth)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in trees(batches):
            yield t.learned()

    below = rows.mapInArrow(learned, "context long, prefix long, zeros double, ones double, below double")
    sums = below.groupBy("context", "prefix").agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "below")))
    above = counted.sparkSession.sparkContext.broadcast(shallow(sums.toArrow(), top - 1))

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in trees(batches):
            yield pa.RecordBatch.from_arrays([pa.array(t.keys[depth]), pa.array(t.logs(*above.value))], ["cell", "p"])

    return rows.mapInArrow(logs, "cell long, p double")


def held_out(doc_id: Column) -> Column:
    """Documents not learned from: CRC-32 of the id as text leaves 0 by 10 (a null id: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts, lower-cased, each as its XXH64 (signed); and how many each text has."""
    digest = xxhash.xxh64_intdigest
    words = [t.lower().split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter((digest(w) for own in words for w in own), np.uint64, int(n.sum())).view(np.int64), n


def score_documents(docs: DataFrame, depth: int = DEPTH, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The model's and the unigram base's scores of all rows of ``docs``, learned from those not held out.

    Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score``, ``n_bytes`` and ``bits_per_byte`` (null for an empty text).

    The base needs each word's count in the corpus, and the vocabulary grows with the
    corpus, so it isn't broadcast. Documents are dealt to blocks of some 32 MB, each a
    partition that is streamed through; a block sends a row for each distinct word to the
    word's count, and gets it back before its documents; so it does for each distinct cell
    of ``depth`` (2 to 5) bytes of context. Words are known by their XXH64, so two words
    that share it would count as one. Counts are aggregated first and then joined, so that
    a word of every block is a skewed join, which Spark splits. The end that each text has
    is counted apart.
    Null texts are empty ones and null ids held out; repeated rows count and stay; an
    empty table gives no rows; other columns are ignored.
    """
    if not 2 <= depth <= DEEPEST:
        raise ValueError(f"the depth is 2 to {DEEPEST}")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    size, n_ends = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    n_blocks = size // block_bytes + 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, number = (Counts(), Counts()), 0
        for batch in batches:
            for texts, apart in some_texts(batch.column("text"), batch.column("held_out").to_pylist()):
                found[0].add(word_keys(texts)[0], 1 - apart)
                for cells_ in byte_cells(texts, depth):
                    found[1].add(cells_, 1 - apart)
            if batch.num_rows:
                number = batch.column("block")[0].as_py()
        for kind in (0, 1):
            yield from found[kind].batches(kind, number)

    folder = common.new_folder(spark, "counts")
    # those learned from come together, so that many are counted at a time
    rows.repartitionById(n_blocks, "block").sortWithinPartitions("held_out").mapInArrow(count, "kind int, block int, key long, n long").write.parquet(folder)
    used = spark.read.parquet(folder)
    used_words, used_cells = used.filter("kind = 0"), used.filter("kind = 1")
    c = used_words.groupBy("key").agg(F.sum("n").alias("c"))
    known_words, distinct = c.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    n_train, n_distinct = int(known_words or 0) + n_ends, int(distinct or 0) + (n_ends > 0)
    logs_of = cell_logs(used_cells.groupBy(F.col("key").alias("cell")).agg(F.sum("n").alias("n")), depth).withColumnRenamed("cell", "key")
    # a block's rows: its words and its cells, each in order, and its documents
    none = lambda kind: F.lit(None).cast(kind)
    whole = math.log10(n_train + 0.1 * (n_distinct + 1))
    parts = [
        used_words.join(c, "key").select("block", "kind", "key", (F.log10(F.col("c") + 0.1) - whole).alias("p"), none("binary").alias("text"), none("boolean").alias("held_out")),
        used_cells.join(logs_of, "key").select("block", "kind", "key", "p", none("binary").alias("text"), none("boolean").alias("held_out")),
        rows.select("block", F.lit(2).alias("kind"), F.col("doc_id").alias("key"), none("double").alias("p"), "text", "held_out"),
    ]
    dealt = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartitionById(n_blocks, "block").sortWithinPartitions("kind", "key")
    of_end = math.log10(n_ends + 0.1) - whole
    # between a count of 0, whose log10 is -1 with the 0.1, and one of 1, whose is above 0
    least_known = -0.5 - whole

    def score_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]
        known: list[np.ndarray] = []
        for batch in batches:
            order = batch.column("kind").to_numpy()
            edges = [0, *np.searchsorted(order, [1, 2]).tolist(), len(order)]
            asked, priced, own = (batch.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False))
            for k, part in enumerate((asked, priced)):
                held[2 * k].append(part.column("key").to_numpy(zero_copy_only=False).astype(np.int64))
                held[2 * k + 1].append(part.column("p").to_numpy(zero_copy_only=False))
            if not own.num_rows:
                continue
            if not known:
                known = [np.concatenate(x) for x in held]
            at = 0
            for texts, _ in some_texts(own.column("text")):
                rows_ = own.slice(at, len(texts))
                at += len(texts)
                keys, n = word_keys(texts)
                p = looked_up(keys, *known[:2])
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                own_p = np.concatenate([np.zeros(0), *(looked_up(part, *known[2:]) for part in byte_cells(texts, depth))])
                score = sums_of(own_p, size)
                bits = [-x / math.log10(2) / m if m else None for x, m in zip(score.tolist(), size.tolist(), strict=True)]
                n_known = sums_of(p > least_known, n).astype(np.int64) + (n_ends > 0)
                columns = [n + 1, n_known, np.full(len(n), n_train), sums_of(p, n) + of_end, score, size]
                yield pa.RecordBatch.from_arrays([rows_.column("key"), rows_.column("held_out"), *map(pa.array, columns), pa.array(bits, pa.float64())], names)

    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
        *[common.long_field(x) for x in ("n_tokens", "n_known", "train_tokens")],
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
        common.long_field("n_bytes"), T.StructField("bits_per_byte", T.DoubleType()),
    ])
    names = schema.names
    return dealt.mapInArrow(score_rows, schema)


def looked_up(wanted: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each wanted key; ``keys`` is sorted and has them all. Each distinct one is searched once, in order."""
    if not len(wanted):
        return np.zeros(0)
    coded = pa.array(wanted).dictionary_encode()
    distinct = coded.dictionary.to_numpy()
    order = np.argsort(distinct)
    found = np.empty(len(distinct))
    found[order] = values[np.searchsorted(keys, distinct[order])]
    return found[coded.indices.to_numpy()]


def sums_of(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sums of as many values in turn as ``n`` says."""
    ends = np.cumsum(n)
    return np.array([values[a:b].sum(dtype=np.float64) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)], np.float64)
