"""Best-fit packing of tokenised documents into sequences.

The pieces of documents are sorted by length, the longest first, by range over the
cluster. Pieces of equal length are alike, and so are sequences with equal gaps; a
class of either is one run with a count. A superstep takes the next class of pieces
and sweeps the gaps: the class meets its successor, the smallest gap that holds it,
as often as the counts of both allow, conflicts between pieces of a class are
resolved by their rank in the distributed sort, the gaps met shrink, and what is left
sweeps again, or opens sequences where no gap is wide enough. This gives the same
sequences as best fit piece by piece, but the sweeps handle runs, of which there are
a few for each length up to the capacity, however many documents there are. So all
supersteps fit a task on an executor; as jobs of their own they would be some thousands.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, encode

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of ``n`` ids: whole pieces at its end, the rest first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))] if n else []


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise the rows of ``docs`` and cut those longer than ``capacity``: a row for each piece.

    A null text is an empty one, which has its end id, or no piece without one; null ids
    and repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encode.encoder(content.value)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            out: list[tuple] = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate((enc.ids(value.as_py()), end)).astype("<u4")
                out += [(doc, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cuts(len(ids), capacity))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[dict[str, int]]:
    """The sweeps over classes of pieces, given how many there are of each length.

    Each match is a run of pieces of one ``length``, ranks ``first`` to ``last`` in the
    sort by descending length; the sequences from ``sequence`` on take ``each`` of them,
    in turn by rank, after the ``filled`` ids that they hold already.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # by gap: first sequence and number
    gaps: list[int] = []  # those with runs, ascending
    matches: list[dict[str, int]] = []
    opened = rank = 0

    def add(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in runs:
                runs[gap] = []
                bisect.insort(gaps, gap)
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} ids doesn't fit {capacity}")
        left = counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)  # the successor
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = gap // length
            used = min(n, -(-left // each))
            placed = min(left, used * each)
            matches.append({"length": length, "first": rank, "last": rank + placed - 1, "each": each, "sequence": first, "filled": capacity - gap})
            add(gap, first + used, n - used)
            whole = placed // each
            add(gap - each * length, first, whole)
            add(gap - (placed - whole * each) * length, first + whole, used - whole)
            left -= placed
            rank += placed
    return matches


MATCHES = ["length", "first", "last", "each", "sequence", "filled"]


def sweeps(counts: DataFrame, capacity: int) -> DataFrame:
    """``plan`` for ``counts`` (length, n), a row for each length and so the capacity's number at most, in a task on an executor: ``MATCHES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for batch in batches:
            held |= zip(*(c.to_pylist() for c in batch.columns), strict=True)
        found = plan(held, capacity)
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in MATCHES])
    return counts.select("length", "n").coalesce(1).mapInArrow(run, ", ".join(f"{c} long" for c in MATCHES))


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Place pieces (columns of ``pieces``) into sequences of ``capacity`` ids: adds ``sequence_id`` and ``offset``.

    Pieces of equal length are interchangeable and placed by rank, ties by document,
    start and piece. Null ids and repeated rows are pieces like any other; an empty
    table gives no rows.
    """
    order = [F.col("length").desc(), F.col("doc_id").asc_nulls_first(), F.col("start").asc()]
    rows = common.ranked(cut.select("doc_id", "piece", "start", "length", "ids_crc32"), order)
    matches = sweeps(rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")), capacity)
    # a few matches for each length
    table = common.checkpoint(matches).withColumnRenamed("length", "__length")
    out = rows.join(F.broadcast(table), (F.col("length") == F.col("__length")) & F.col("rank").between(F.col("first"), F.col("last")))
    turn = F.col("rank") - F.col("first")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.expr("(rank - first) div each")).alias("sequence_id"),
        (F.col("filled") + F.pmod(turn, F.col("each")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int | None = 2) -> DataFrame:
    """Tokenise, cut and pack the rows of ``docs``; a null text is an empty one, which has its end id only."""
    return pack(pieces(docs, tokenizer_path, capacity, end_id), capacity)
