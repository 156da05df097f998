"""Token ids as flat files of unsigned ints with 64-bit document offsets.

``<part>.bin`` holds the ids of a range of documents, one after the other, as
little-endian unsigned ints of 16 bits, or of 32 where the vocabulary needs them.
``<part>.idx`` holds, as little-endian 64-bit ints: a format number, the bytes of an
id, the number of documents n, n + 1 offsets in ids (the first 0), and n document
ids (null: the smallest number). Parts follow each other in document order; a part's
base, the ids in all parts before, is a prefix sum over the manifest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, encode, files

FORMAT = 1
NULL_ID = -(1 << 63)
#: Documents encoded between two writes.
DOCS_AT_ONCE = 256


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all rows of ``docs`` in ascending order of ``doc_id``; returns the manifest.

    A row for each part: ``part``, ``bin``, ``idx`` (their URIs), ``n_docs``, ``n_tokens``
    and ``base``. Null ids come first; a null text has no ids but ``end_id``; repeated
    rows are documents of their own; an empty table gives no parts; other columns are
    ignored. A task that runs twice writes under another name, and the manifest, which
    is materialised, names one of them.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    files.make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encode.encoder(content.value)
        kind = np.dtype("<u2") if max(enc.n_ids - 1, end_id or 0) < 1 << 16 else np.dtype("<u4")
        end = [] if end_id is None else [end_id]
        part = TaskContext.get().partitionId()
        bin_uri = files.fresh(folder, f"part-{part:05d}", ".bin")
        idx_uri = bin_uri.removesuffix(".bin") + ".idx"
        ids, counts = [], []
        system, path = files.resolve(bin_uri)
        out = None
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS_AT_ONCE):
                rows = batch.slice(lo, DOCS_AT_ONCE)
                tokens = [np.concatenate((enc.ids(x.as_py()), np.array(end, np.uint32))).astype(kind) for x in rows.column(1)]
                out = out or system.open_output_stream(path)
                out.write(b"".join(x.tobytes() for x in tokens))
                counts.append(np.array([len(x) for x in tokens], np.int64))
                ids.append(rows.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        ids = np.concatenate(ids)
        system, path = files.resolve(idx_uri)
        with system.open_output_stream(path) as out:
            for x in (np.array([FORMAT, kind.itemsize, len(ids)]), offsets, ids):
                out.write(x.astype("<i8").tobytes())
        yield pa.RecordBatch.from_pylist([{"part": part, "bin": bin_uri, "idx": idx_uri, "n_docs": len(ids), "n_tokens": int(offsets[-1])}])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    manifest = common.checkpoint(rows.mapInArrow(run, "part long, bin string, idx string, n_docs long, n_tokens long"))
    # a row for each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Part:
    """A part, with its ids mapped into memory where the operating system can, else read."""

    def __init__(self, bin_uri: str, idx_uri: str) -> None:
        head = self._map(idx_uri, "<i8")
        if head[0] != FORMAT:
            raise ValueError(f"{idx_uri} isn't of format {FORMAT}")
        n = int(head[2])
        self.offsets, self.doc_ids = head[3 : n + 4], head[n + 4 : 2 * n + 4]
        self.tokens = self._map(bin_uri, f"<u{head[1]}")

    @staticmethod
    def _map(uri: str, kind: str) -> np.ndarray:
        if path := files.local_path(uri):
            try:
                return np.memmap(path, kind, "r")
            except ValueError:  # an empty file can't be mapped
                return np.zeros(0, kind)
        system, path = files.resolve(uri)
        with system.open_input_stream(path) as f:
            return np.frombuffer(f.read(), kind)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.tokens[self.offsets[k] : self.offsets[k + 1]]


def read(manifest: DataFrame) -> DataFrame:
    """A row for each document in the files: ``doc_id``, ``start`` (ids before it in all parts), ``n_tokens``, ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = Part(row["bin"], row["idx"])
                for lo in range(0, len(part), 1 << 14):
                    at = range(lo, min(lo + (1 << 14), len(part)))
                    ids = pa.array(np.asarray(part.doc_ids[lo : at.stop]), mask=np.asarray(part.doc_ids[lo : at.stop] == NULL_ID))
                    crcs = pa.array([zlib.crc32(part[k].astype("<u4").tobytes()) for k in at], pa.int64())
                    starts = np.asarray(part.offsets[lo : at.stop])
                    sizes = np.asarray(part.offsets[lo + 1 : at.stop + 1]) - starts
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts + row["base"]), pa.array(sizes), crcs], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.repartition(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
