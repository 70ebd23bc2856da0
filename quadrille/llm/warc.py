"""WARC archives: written as whole-file gzip streams, normalised to one member a record, read back by offset.

A monolithic .warc.gz can only be read from its start. The normaliser inflates such a file once, in pieces, cuts
the records as they come, writes each as a gzip member of its own and notes where it lies in a sidecar index, so
that any record can then be read alone. Files are a bounded number of megabytes and lie in the shared folder; a
task that is run again writes a file of a new name, and only files that a finished task has named are read.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import join_counted, shared_dir, small_batches, staged, store

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    number = (record_id or "").rpartition(":")[2].rstrip(">")
    return int(number) if number.lstrip("-").isdigit() else None


def record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head of the payload that it leaves out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {"version": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflated(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members, piece by piece."""
    z = zlib.decompressobj(31)
    while data := stream.read(piece):
        while data:
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
    if tail := z.flush():
        yield tail


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and whole bytes of each record; holds one record at a time. ValueError where a stream breaks off."""
    held = bytearray()
    want = None
    for data in pieces:
        held += data
        while True:
            if want is None:
                cut = held.find(_END)
                if cut < 0:
                    break
                fields = headers(bytes(held[:cut]))
                want = cut + 4 + int(fields["content-length"]) + 4
            if len(held) < want:
                break
            yield fields, bytes(held[:want])
            del held[:want]
            want = None
    if held:
        raise ValueError("the archive ends within a record")


_FILES = pa.schema([("path", pa.string()), ("records", pa.int64())])
_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])


def _write(folder: str, file_bytes: int, date: str, level: int):
    def run(batches):
        out = sink = None
        done = size = 0
        path = ""
        for batch in batches:
            for page_id, url, html, sha1, refers_to, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to", "revisit"))):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    there, place = store(path)
                    there.create_dir(place.rpartition("/")[0], recursive=True)
                    sink, out, done, size = there.open_output_stream(place, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                raw = record(page_id, url, html.encode(), base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, revisit, date)
                sink.write(out.compress(raw))
                done, size = done + 1, size + len(raw)
                if size >= file_bytes:
                    sink.write(out.flush())
                    sink.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"path": path, "records": done}], schema=_FILES)
        if out is not None:
            sink.write(out.flush())
            sink.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": done}], schema=_FILES)

    return run


def _normalise(folder: str, level: int):
    def run(batches):
        for batch in batches:
            for source in batch.column("path").to_pylist():
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                there, place = store(path)
                there.create_dir(place.rpartition("/")[0], recursive=True)
                rows, at = [], 0
                origin, inside = store(source)
                with origin.open_input_stream(inside, compression=None) as stream, there.open_output_stream(place, compression=None) as sink:
                    for fields, raw in records(inflated(stream)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        sink.write(member)
                        rows.append({"path": path, "offset": at, "length": len(member), "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type")})
                        at += len(member)
                with there.open_output_stream(place + ".idx", compression=None) as side:
                    side.write("".join(f"{r['offset']} {r['length']} {r['record_type']} {r['record_id']}\n" for r in rows).encode())
                for k in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 5000], schema=_INDEX)

    return run


_PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _read(with_payload: bool):
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                there, place = store(path)
                with there.open_input_file(place) as f, there.open_input_stream(place + ".idx", compression=None) as side:
                    rows = []
                    for line in side.read().decode().splitlines():
                        offset, length = map(int, line.split(" ", 2)[:2])
                        f.seek(offset)
                        raw = zlib.decompress(f.read(length), 31)
                        head, _, block = raw[:-4].partition(_END)
                        fields = headers(head)
                        http, _, payload = block.partition(_END)
                        revisit = fields["warc-type"] == "revisit"
                        digest = fields["warc-payload-digest"].partition(":")[2]
                        size = int(headers(http)["content-length"])
                        if not revisit and (len(payload) != size or digest != _digest(payload)):
                            raise ValueError(f"{path} at {offset}: the payload does not match its digest")
                        rows.append({"page_id": _page_id(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": _page_id(fields.get("warc-refers-to")) if revisit else None, "payload": payload if with_payload and not revisit else None})
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_pylist(rows, schema=_PAGES)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema=_PAGES)

    return run


def _digest(payload: bytes) -> str:
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, file_bytes: int = 16 << 20, date: str = "1970-01-01T00:00:00Z", min_revisit_bytes: int = 0, level: int = 1) -> DataFrame:
    """Writes a record for each page into monolithic .warc.gz files; returns their path and records.

    The payload is html in UTF-8, a null one empty. Of equal payloads of min_revisit_bytes or more, the page with
    the largest page_id is a response and the others are revisits that refer to it; shorter ones are responses all.
    Pages that repeat that page_id with that payload are all responses. A null page_id is the smallest. A null
    url gives a record without a target. Other columns are left out; an empty table gives no file.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("key", F.when(F.octet_length("html") >= min_revisit_bytes, F.sha2("html", 256)))
    largest = own.filter("key is not null").groupBy(F.col("key").alias("of")).agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).checkpoint()
    # a payload that many pages share, such as an empty one, is dealt over all writers
    told = join_counted(own, largest, "key", "left").select("page_id", "url", "html", F.sha1(F.col("html").cast("binary")).alias("sha1"), "refers_to", F.coalesce(F.col("refers_to").isNotNull() & ~F.col("refers_to").eqNullSafe(F.col("page_id")), F.lit(False)).alias("revisit"))
    return staged(told.mapInArrow(_write(folder, file_bytes, date, level), "path string, records long"), "warc-files")


def normalise_archives(files: DataFrame, level: int = 1) -> DataFrame:
    """Rewrites each file with a gzip member for each record and a sidecar index (path.idx: offset, length, type and
    id a line); returns the index as rows: path, offset, length, record_id, record_type. Files that have members
    for records already are rewritten alike. ValueError for a file that breaks off within a record."""
    spark = files.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    n = max(1, files.count())
    dealt = files.select("path").repartition(2 * n, "path")
    return staged(dealt.mapInArrow(_normalise(folder, level), "path string, offset long, length long, record_id string, record_type string"), "warc-index")


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the indexed files, read member by member: page_id, url, payload_bytes,
    payload_digest (of the full payload, also for revisits), record_type, refers_to and the payload (null for revisits).
    A response whose payload does not match its digest raises ValueError."""
    paths = index.select("path").distinct()
    n = max(1, paths.count())
    return paths.repartition(2 * n, "path").mapInArrow(_read(with_payload), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
