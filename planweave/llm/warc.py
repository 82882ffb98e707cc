"""WARC archives: a writer and a sequential reader.

One gzip member a record. The writer rolls files at a size and returns a manifest of the
files it finished; only files in the committed manifest are ever read, so a task that
runs twice leaves no record twice. The reader is a state machine over incremental zlib
decompression: it reads the file in small pieces, starts a new decompressor at each
member, frames header and block by Content-Length and verifies both digests while the
bytes pass, holding one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import file_system, make_dir, materialize, scratch, spread

CHUNK = 1 << 18
CRLF = b"\r\n"
DATE = "2020-01-01T00:00:00Z"  # pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(kind: str, url: str, payload: bytes, page_id: int | None, refers_to: int | None = None, of: tuple[str, int] | None = None, refers_url: str | None = None, place: str = "") -> bytes:
    """A whole gzip member. A revisit carries no payload but its response's digest and length (``of``)
    and URL; ``place`` (file and number of the record) keeps the ids of equal records apart."""
    clean = lambda u: " ".join((u or "about:blank").split()) or "about:blank"
    url = clean(url)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    payload_digest, length = of or (digest(payload), len(payload))
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind}:{page_id}:{url}:{place}")
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", payload_digest),
        ("WARC-Block-Digest", digest(block)),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(length)),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", clean(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + CRLF + block + CRLF + CRLF
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(CRLF + CRLF)[2]


def _members(stream) -> Iterator[Iterator[bytes]]:
    """The members of a gzip stream, each an iterator over its decompressed pieces."""
    rest = b""
    while True:
        if not rest and not (rest := stream.read(CHUNK)):
            return
        left = [rest]

        def pieces(left=left) -> Iterator[bytes]:
            unpack = zlib.decompressobj(31)
            data = left[0]
            while True:
                out = unpack.decompress(data, CHUNK)
                if out:
                    yield out
                if unpack.eof:
                    left[0] = unpack.unused_data
                    return
                data = unpack.unconsumed_tail or stream.read(CHUNK)
                if not data and not out:
                    raise ValueError("the archive ends inside a member")

        member = pieces()
        yield member
        for _ in member:  # whatever the caller left unread
            pass
        rest = left[0]


def read_records(stream) -> Iterator[Record]:
    """Records of an archive, in order; a wrong frame or digest raises ValueError."""
    for member in _members(stream):
        held = bytearray()
        end = -1
        for piece in member:
            held += piece
            if (end := held.find(CRLF + CRLF)) >= 0:
                break
        if end < 0 or not held.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        lines = bytes(held[:end]).decode("utf-8").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        need = int(headers["Content-Length"])
        del held[: end + 4]
        for piece in member:
            held += piece
        if len(held) != need + 4 or held[need:] != CRLF + CRLF:
            raise ValueError("Content-Length doesn't frame the block")
        record = Record(headers, bytes(held[:need]))
        if digest(record.block) != headers["WARC-Block-Digest"]:
            raise ValueError("the block digest differs")
        if headers["WARC-Type"] == "response" and digest(record.payload) != headers["WARC-Payload-Digest"]:
            raise ValueError("the payload digest differs")
        yield record


def plan_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``pages`` with ``payload`` (binary), ``length``, ``sha1`` and ``refers_to``: of equal
    payloads of at least ``least`` bytes the largest page_id answers for the others."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumns({"length": F.length("payload").cast("long"), "sha1": F.sha1("payload")})
    # Only digests that occur again: few rows, and no payload, meet in this aggregate.
    again = rows.filter(F.col("length") >= least).groupBy("sha1", "length").agg(F.max("page_id").alias("first"), F.max_by("url", "page_id").alias("first_url"), F.count("*").alias("copies")).filter("copies > 1 and first is not null").drop("copies")
    again = materialize(again, "digests").withColumnsRenamed({"sha1": "s", "length": "l"})
    joined = rows.join(again, (F.col("sha1") == F.col("s")) & (F.col("length") == F.col("l")), "left")
    return joined.select("page_id", "url", "payload", "length", "sha1", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"), "first_url")


def write_archives(pages: DataFrame, least: int = 1000, roll: int = 64 << 20) -> DataFrame:
    """Write a record per page; returns the committed manifest (path, records, bytes).

    Null html is an empty payload, a null url ``about:blank``; a null page_id can only be a
    response or revisit another page; repeated rows give repeated records (rows with the
    response's own id are responses too); an empty table writes no file."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    make_dir(spark, folder)

    def run(batches):
        import pandas as pd

        files, base = file_system(folder)
        out = name = None
        count = size = 0

        def close():
            nonlocal out
            out.close()
            out = None
            return pd.DataFrame({"path": [f"{folder}/{name}"], "records": [count], "bytes": [size]})

        for batch in batches:
            for page_id, url, payload, length, sha1, refers, first_url in zip(*(batch[c].array for c in ("page_id", "url", "payload", "length", "sha1", "refers_to", "first_url"))):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                pid = None if pd.isna(page_id) else int(page_id)
                if pd.isna(refers):
                    raw = encode_record("response", url, payload, pid, place=f"{name}:{count}")
                else:
                    of = ("sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(), int(length))
                    raw = encode_record("revisit", url, b"", pid, int(refers), of, first_url, f"{name}:{count}")
                out.write(raw)
                count += 1
                size += len(raw)
                if size >= roll:
                    yield close()
        if out is not None:
            yield close()

    return materialize(plan_revisits(pages, least).mapInPandas(run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Rows of the archives a manifest lists: page_id, payload_bytes, payload_digest (hex
    SHA-1 of the full payload), record_type, refers_to and, on request, url and payload."""

    def run(batches):
        import pandas as pd

        columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if payloads else [])]
        for batch in batches:
            for path in batch["path"]:
                files, name = file_system(path)
                rows, held = [], 0
                with files.open_input_stream(name, compression=None) as stream:
                    for r in read_records(stream):
                        h = r.headers
                        kind = h["WARC-Type"]
                        page = int(h["X-Page-ID"]) if h["X-Page-ID"] else None
                        sha1 = base64.b32decode(h["WARC-Payload-Digest"].partition(":")[2]).hex()
                        size = len(r.payload) if kind == "response" else int(h["X-Payload-Length"])
                        refers = int(h["X-Refers-To-Page"]) if kind == "revisit" else None
                        rows.append([page, size, sha1, kind, refers, *([h["WARC-Target-URI"], r.payload] if payloads else [])])
                        held += len(r.block) * payloads + 100
                        if held > 16 << 20 or len(rows) >= 50_000:
                            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", url string, payload binary" if payloads else "")
    return spread(manifest.select("path")).mapInPandas(run, kinds)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives and read them back."""
    return read_archives(write_archives(pages))
