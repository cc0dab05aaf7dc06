"""WARC archives: written one gzip member per record, read back sequentially.

Each task writes one archive to shared storage (under a temporary name that is
moved into place, so a repeated task leaves one whole file). The reader
decompresses member after member incrementally, frames each record by its
Content-Length and verifies block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed date of all records: the archives of one input are byte-identical.
RECORD_DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_PAGE = "<urn:no-page>"


class WarcError(ValueError):
    """A record that breaks the framing or whose digest does not match."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _one_line(value) -> str:
    """Header values hold no line breaks; they are percent-encoded."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _page_urn(page_id) -> str:
    """Record id of a page; a page without an id has a name of its own."""
    return _NO_PAGE if page_id is None else f"<urn:page:{_one_line(page_id)}>"


def write_record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record as one gzip member. A null id is written as ``<urn:no-page>`` and read back as null. A revisit keeps the HTTP header (so the
    payload's length is known) and refers to the response; it has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_page_urn(page_id)}", f"WARC-Date: {RECORD_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_page_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    record = "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def read_members(stream) -> Iterator[Iterator[bytes]]:
    """Decompressed chunks of each gzip member of a stream, in order; a member
    is read to its end before the next begins."""
    data = stream.read(CHUNK)
    while data:
        rest = []

        def member(data=data, rest=rest):
            unpacker = zlib.decompressobj(31)
            while True:
                out = unpacker.decompress(data, CHUNK)
                if out:
                    yield out
                if unpacker.eof:
                    rest.append(unpacker.unused_data)
                    return
                data = unpacker.unconsumed_tail or stream.read(CHUNK)
                if not data:
                    raise WarcError("archive ends inside a member")

        chunks = member()
        yield chunks
        for _ in chunks:
            pass
        data = rest[0] or stream.read(CHUNK)


def _headers(data: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = data.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def read_record(chunks: Iterator[bytes]) -> dict:
    """Frame and verify one record: header, then Content-Length bytes of block,
    then the end mark. Reading stops there, whatever follows: a damaged member that
    goes on is found at its next chunk and never held. The payload is also returned."""
    data = b""
    while (cut := data.find(b"\r\n\r\n")) < 0:
        more = next(chunks, None)
        if more is None:
            raise WarcError("record without a header end")
        data += more
    version, head = _headers(data[:cut])
    if not version.startswith("WARC/"):
        raise WarcError(f"not a WARC record: {version[:40]!r}")
    length = int(head["content-length"])
    parts, have = [data[cut + 4:]], len(data) - cut - 4
    while have < length + 4 and (more := next(chunks, None)) is not None:
        parts.append(more)
        have += len(more)
    block = b"".join(parts)
    if have != length + 4 or block[length:] != b"\r\n\r\n":
        raise WarcError(f"record of {have - 4} bytes, Content-Length {length}")
    if next(chunks, None) is not None:
        raise WarcError(f"bytes after the record, Content-Length {length}")
    block = block[:length]
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise WarcError("block digest does not match")
    cut = block.find(b"\r\n\r\n")
    _, http = _headers(block[:cut])
    payload, size = block[cut + 4:], int(http["content-length"])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise WarcError("payload digest does not match")
    name = lambda k: head[k][len("<urn:page:"):-1] if head.get(k, _NO_PAGE) != _NO_PAGE else None
    plain = lambda x: x if x is None else x.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {"record_id": plain(name("warc-record-id")), "record_type": head["warc-type"], "refers_to": plain(name("warc-refers-to")),
            "url": plain(head.get("warc-target-uri")), "payload_bytes": size, "payload_digest": digest,
            "payload": payload if head["warc-type"] == "response" else None}


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> int:
    """Write one archive per task below ``folder``; returns the number of records.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with
    the largest id is the response and the others revisit it (rows that repeat
    that id are responses too; equal payloads without any id are all
    responses). Null html is an empty payload; a null url has no header.
    """
    data = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), data.alias("data")).select("*", F.sha1("data").alias("sha"))
    copies = source.where(F.octet_length("data") >= min_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("response")).where("n > 1")
    marked = source.join(copies.select("sha", "response"), "sha", "left").select("id", "url", "data", "response")

    def run(batches):
        target, base = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        draft, n = f"{base}/.draft-{part}-{uuid.uuid4().hex}", 0
        target.create_dir(base, recursive=True)
        with target.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for i, url, data, response in zip(*(c.to_pylist() for c in batch.columns)):
                    out.write(write_record(i, url, data, response, response is not None and i != response))
                    n += 1
        if n:
            target.move(draft, f"{base}/part-{part:06d}.warc.gz")
        else:
            target.delete_file(draft)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return marked.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


_RECORD = T.StructType([T.StructField(k, t) for k, t in (
    ("record_id", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.StringType()), ("url", T.StringType()),
    ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("payload", T.BinaryType()))])


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below ``folder``, one task per archive at most.
    A broken record fails the job. An absent or empty folder gives no rows."""
    source, base = fs.FileSystem.from_uri(folder)
    found = source.get_file_info(fs.FileSelector(base, allow_not_found=True))
    paths = sorted(f.path for f in found if f.base_name.endswith(".warc.gz"))
    schema = _RECORD if payloads else T.StructType(_RECORD.fields[:-1])
    names = schema.names

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for chunks in read_members(stream):
                        record = read_record(chunks)
                        rows.append({k: record[k] for k in names})
                        held += 500 + (len(record["payload"] or b"") if payloads else 0)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kinds = {"long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(f.name, kinds.get(f.dataType.typeName(), pa.string())) for f in schema.fields])
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartitionByRange(max(1, len(paths)), "path").mapInArrow(run, schema)
