"""WARC archives: writing, normalising whole-file gzip streams, and reading by offset.

``write`` makes archives as some crawlers leave them: one gzip stream around a whole
file. ``normalise`` inflates such a stream once, from front to back, and writes every
record again as a gzip member of its own, with a sidecar index of the members'
offsets. ``read`` then goes to each record by its offset.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from io import BytesIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, files

#: Bytes inflated, copied or compressed at a time.
CHUNK = 1 << 18
#: Pages that refer to others are broadcast up to this number; a row is about a hundred bytes.
FEW_REVISITS = 1 << 18
#: A task starts another archive after so many payload bytes.
ARCHIVE_BYTES = 256 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
INDEX_HEAD = "#offset\tlength\ttype\trecord_id\n"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    value = (record or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if re.fullmatch(r"-?\d+", value) else None


def head(fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page ``refers_to``, which holds the HTTP header only."""
    uri = "about:blank" if not url else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
        payload = b""
    fields.append(("Content-Type", "application/http; msgtype=response"))
    return head(fields, len(http) + len(payload)) + http + payload + b"\r\n\r\n"


def decide(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest`` (hex) and ``refers_to`` of each page.

    Of pages with equal payloads of ``min_bytes`` or more, that with the smallest id
    is the response and the others refer to it. Rows that repeat the smallest id are
    responses too; a page without id refers to the smallest id, if any page of its
    payload has one; a null payload is an empty one; an empty table gives no rows; other
    columns are ignored. Only digests and ids are aggregated and joined by digest, so a
    payload of very many pages is a skewed join of small rows. The pages that refer to
    others are joined back by page and digest: broadcast if there are few, which is
    checked, so that payloads stay where they are; else payloads are dealt by page and digest.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    small = rows.filter(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    first = small.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = small.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    again = common.checkpoint(again.select(F.col("page_id").alias("__page_id"), F.col("digest").alias("__digest"), "refers_to"))
    if again.count() <= FEW_REVISITS:
        again = F.broadcast(again)
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("__page_id")) & (F.col("digest") == F.col("__digest")), "left")
    return rows.select("page_id", "url", "payload", "digest", "refers_to")


def write(decided: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write archives, each one gzip stream, from the rows of ``decide``; returns their manifest (``archive``, ``n_records``)."""
    files.make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, gzip, uri, n, size = [], None, None, "", 0, 0
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[k].as_py() for c in batch.columns)
                if out is None:
                    uri, n, size = files.fresh(folder, f"pages-{TaskContext.get().partitionId():05d}", ".warc.gz"), 0, 0
                    system, path = files.resolve(uri)
                    out, gzip = system.open_output_stream(path, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                    info = b"software: skylocus\r\n"
                    out.write(gzip.compress(head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{uri.rpartition('/')[2]}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], len(info)) + info + b"\r\n\r\n"))
                out.write(gzip.compress(page_record(page_id, url, payload, base32(digest), refers_to)))
                n, size = n + 1, size + len(payload)
                if size >= ARCHIVE_BYTES:
                    out.write(gzip.flush())
                    out.close()
                    done.append({"archive": uri, "n_records": n})
                    out = None
        if out is not None:
            out.write(gzip.flush())
            out.close()
            done.append({"archive": uri, "n_records": n})
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return common.checkpoint(decided.mapInArrow(run, "archive string, n_records long"))


class Inflated:
    """The bytes of a gzip file of one member or many, read once from front to back."""

    def __init__(self, source) -> None:
        self.source, self.gzip, self.buffer, self.begun = source, zlib.decompressobj(31), bytearray(), False

    def more(self) -> bool:
        """Inflate some more into the buffer; False at the end. Bounded even where a little input inflates to very much."""
        while True:
            data = self.gzip.unconsumed_tail
            if not data and self.gzip.eof:
                data = self.gzip.unused_data or self.source.read(CHUNK)
                if not data:
                    return False
                self.gzip, self.begun = zlib.decompressobj(31), False
            elif not data:
                data = self.source.read(CHUNK)
                if not data and not self.begun:
                    return False
            self.begun = True
            out = self.gzip.decompress(data, CHUNK)
            if out:
                self.buffer += out
                return True
            if not data and not self.gzip.eof:
                raise EOFError("the gzip stream is cut off")

    def until(self, mark: bytes) -> bytes | None:
        """All up to and with ``mark``; None at the end of the file."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.more():
                if self.buffer.strip():
                    raise EOFError("the last record is cut off")
                return None
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def copy(self, n: int, to: Callable[[bytes], object]) -> None:
        """Pass on the next ``n`` bytes, a chunk at a time."""
        while n:
            if not self.buffer and not self.more():
                raise EOFError("the last record is cut off")
            part = bytes(self.buffer[:n])
            del self.buffer[:n]
            n -= len(part)
            to(part)


def fields_of(header: bytes) -> dict[str, str]:
    """A header's fields by lower-case name; the first line is left out."""
    out = {}
    for line in header.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def normalise_stream(source, target, level: int = 6) -> Iterator[tuple[int, int, str, str]]:
    """Rewrite the records of ``source``, each as a gzip member; yields (offset, length, type, record id) of each."""
    stream = Inflated(source)
    at = 0
    while (header := stream.until(b"\r\n\r\n")) is not None:
        header = header.lstrip(b"\r\n")
        fields = fields_of(header)
        if not header.startswith(b"WARC/") or "content-length" not in fields:
            raise ValueError(f"not a WARC record: {header[:60]!r}")
        gzip = zlib.compressobj(level, zlib.DEFLATED, 31)
        length = 0

        def put(data: bytes, gzip=gzip) -> None:
            nonlocal length
            out = gzip.compress(data)
            length += len(out)
            target.write(out)

        put(header)
        stream.copy(int(fields["content-length"]) + 4, put)
        end = gzip.flush()
        target.write(end)
        length += len(end)
        yield at, length, fields.get("warc-type", ""), fields.get("warc-record-id", "")
        at += length


def normalise(manifest: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Normalise each ``archive`` of the manifest; returns ``archive``, ``index`` (URIs) and ``n_records`` of the new ones."""
    files.make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uri = files.fresh(folder, "normal", ".warc.gz")
                (system, path), (own, target), (_, index) = (files.resolve(u) for u in (row["archive"], uri, uri + ".idx"))
                n = 0
                with system.open_input_stream(path, compression=None) as source, own.open_output_stream(target, compression=None) as out, own.open_output_stream(index) as idx:
                    idx.write(INDEX_HEAD.encode())
                    for entry in normalise_stream(source, out, level):
                        idx.write(("\t".join(map(str, entry)) + "\n").encode())
                        n += 1
                yield pa.RecordBatch.from_pylist([{"archive": uri, "index": uri + ".idx", "n_records": n}])

    return common.checkpoint(_one_each(manifest).mapInArrow(run, "archive string, index string, n_records long"))


def _one_each(manifest: DataFrame) -> DataFrame:
    """The manifest's rows, a small one for each archive, with a task for each."""
    return manifest.coalesce(1).repartition(max(1, manifest.count()))


def parse_page(member: bytes) -> dict | None:
    """What a member says about its page; None if it isn't a response or revisit."""
    stream = Inflated(BytesIO(member))
    fields = fields_of(stream.until(b"\r\n\r\n") or b"")
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block: list[bytes] = []
    stream.copy(int(fields["content-length"]), block.append)
    http, _, payload = b"".join(block).partition(b"\r\n\r\n")
    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields_of(http)["content-length"])
    if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)) != (digest, size):
        raise ValueError(f"{fields['warc-record-id']}: the payload isn't the one that its header tells of")
    return {
        "page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page_of(fields.get("warc-refers-to")),
    }


PAGES = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(manifest: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` (of ``PAGES``) of each page in normalised archives, by the offsets in their indexes."""
    fields = {f.split()[0]: f for f in PAGES.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (system, path), (_, index) = files.resolve(row["archive"]), files.resolve(row["index"])
                with system.open_input_stream(index) as f:
                    entries = f.read().decode().splitlines()[1:]
                out: list[dict] = []
                size = 0
                with system.open_input_file(path) as archive:
                    for entry in entries:
                        offset, length, kind, _ = entry.split("\t")
                        if kind not in ("response", "revisit"):
                            continue
                        archive.seek(int(offset))
                        page = parse_page(archive.read(int(length)))
                        out.append({c: page[c] for c in columns})
                        size += len(page["payload"] or b"") if "payload" in columns else 100
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c, kinds[fields[c].split()[1]]) for c in columns])
    return _one_each(manifest).mapInArrow(run, ", ".join(fields[c] for c in columns))


def archive_pages(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write, normalise; returns the manifest of the normalised archives. An empty table gives no archives.

    The archives written first go when all are normalised: the manifest is materialised then.
    """
    written = write(decide(pages, min_bytes), f"{folder}/raw")
    normalised = normalise(written, f"{folder}/normal")
    files.remove_folder(f"{folder}/raw")
    return normalised
