"""WARC archives: writing, and normalising a file that was compressed as one stream.

A file compressed as a whole can only be read from its start. The normaliser inflates it once, writes every record as
a gzip member of its own, and writes a sidecar index with the offset and length of each, so that later readers fetch
single records. Memory is bounded by the largest record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverloom.llm import common

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f1c2f0e-5d0b-4d0c-9a68-1a6ad0f0a9d4")
#: Payload bytes after which a task begins another file.
FILE_BYTES = 256_000_000
CHUNK = 1 << 20
FILES = "path string, n_records long"
INDEXED = "path string, index_path string, n_records long"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def _line(text: str) -> str:
    """A header value holds no line breaks."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One response or revisit record; a revisit states length and digest of the payload that it leaves out."""
    digest = digest32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _line(url)))
    if page_id is not None:
        head.append(("Page-Id", str(page_id)))
    if revisit:
        head.append(("WARC-Profile", PROFILE))
        head.append(("WARC-Refers-To", record_id(refers_to, digest)))
        if refers_to is not None:
            head.append(("Refers-To-Page-Id", str(refers_to)))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record; header names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    pairs = (x.decode("utf-8", "surrogatepass").partition(":") for x in lines)
    headers = {k.strip().lower(): v.strip() for k, _, v in pairs}
    return headers, rest[: int(headers["content-length"])]


def payload_of(block: bytes) -> tuple[int, bytes]:
    """(full payload length, payload) of an HTTP block."""
    head, _, body = block.partition(b"\r\n\r\n")
    length = next((x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"0")
    return int(length), body


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The raw records of an inflated stream, each whole; at most one record and one chunk are held."""
    held = bytearray()
    ended = False

    def more() -> bool:
        nonlocal ended
        if not ended and (x := next(chunks, None)) is not None:
            held.extend(x)
            return True
        ended = True
        return False

    while True:
        while (cut := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if bytes(held).strip():
                    raise ValueError("the stream ends within a record's headers")
                return
        head = bytes(held[:cut]).lower()
        at = head.find(b"\r\ncontent-length:")
        if not head.startswith(b"warc/") or at < 0:
            raise ValueError("not a WARC record")
        size = int(head[at + 17 :].split(b"\r\n", 1)[0])
        end = cut + 4 + size + 4
        while len(held) < end:
            if not more():
                raise ValueError("the stream ends within a record")
        yield bytes(held[:end])
        del held[:end]


def inflate(fs, path: str) -> Iterator[bytes]:
    """The content of a gzip file of one member or many, chunk by chunk."""
    with fs.open_input_stream(path, compression=None) as f:
        unpack = zlib.decompressobj(31)
        while data := f.read(CHUNK):
            while data:
                if out := unpack.decompress(data):
                    yield out
                data = unpack.unused_data
                if unpack.eof:
                    unpack = zlib.decompressobj(31)
        if out := unpack.flush():
            yield out


def plan_records(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", least: int = 0) -> DataFrame:
    """``pages`` with __digest and, for payloads that stand in several records, __first: the smallest id that has it.

    Payloads are compared by digest; only digests and ids are shuffled, and only digests that repeat come back. Nulls
    are empty payloads. Payloads shorter than ``least`` bytes never refer to others.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    pages = pages.withColumn("__digest", F.sha1(payload))
    many = pages.where(F.octet_length(payload) >= least).groupBy("__digest").agg(F.min(id_col).alias("__first"), F.count("*").alias("__n"))
    many = common.written(many.where("__n > 1").drop("__n"), "repeated")
    return pages.join(many, "__digest", "left")


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    level: int = 1,
) -> DataFrame:
    """A record per row, in files that are each compressed as one gzip stream; returns the manifest (path, n_records).

    Of rows with equal payloads, those with the smallest id are responses, the others revisit them (a null id is never
    the smallest unless all are null). A null payload is an empty one, a null url is left out of its record. Payloads of
    any length are written whole; a task holds one record at a time beside the rows of a batch. Rows that repeat an id
    are records of their own. Other columns are not read, whatever their names. An empty table gives no files.
    """
    rows = plan_records(pages.select(id_col, url_col, payload_col), id_col=id_col, payload_col=payload_col, least=least)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"), "__digest", F.col("__first").cast("long").alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        out = pack = None
        number = count = size = 0

        def close():
            out.write(pack.flush())
            return pa.RecordBatch.from_pydict({"path": [out.commit()], "n_records": pa.array([count], pa.int64())})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "url", "payload", "first")]
            for page_id, url, text, first in zip(*columns, strict=True):
                if out is None:
                    out = common.SharedWriter(folder, f"part-{task:06d}-{number:04d}.warc.gz")
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    count = size = 0
                payload = (text or "").encode("utf-8", "surrogatepass")
                revisit = first is not None and page_id != first
                out.write(pack.compress(record(page_id, url, payload, first, revisit, date)))
                count, size = count + 1, size + len(payload)
                if size >= FILE_BYTES:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    return common.written(rows.drop("__digest").mapInArrow(write, FILES), "archives")


def normalise(manifest: DataFrame, folder: str, *, level: int = 6) -> DataFrame:
    """Rewrite each archive with a gzip member per record and a sidecar index; returns (path, index_path, n_records).

    An index line is a JSON object with offset, length, type, page_id, digest and url of a record, in file order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = common.filesystem(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = path.rsplit("/", 1)[1]
                out, index = common.SharedWriter(folder, name), common.SharedWriter(folder, name + ".index.jsonl")
                n = 0
                for raw in records(inflate(fs, path)):
                    headers, _ = parse(raw)
                    member = gzip.compress(raw, level, mtime=0)
                    entry = {
                        "offset": out.tell(),
                        "length": len(member),
                        "type": headers["warc-type"],
                        "page_id": headers.get("page-id"),
                        "digest": headers.get("warc-payload-digest"),
                        "url": headers.get("warc-target-uri"),
                    }
                    out.write(member)
                    index.write(json.dumps(entry).encode() + b"\n")
                    n += 1
                at = out.commit()
                yield pa.RecordBatch.from_pydict({"path": [at], "index_path": [index.commit()], "n_records": pa.array([n], pa.int64())})

    files = manifest.repartition(common.partitions(manifest.sparkSession)).select("path")
    return common.written(files.mapInArrow(run, INDEXED), "indexed")


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per record of normalised archives, each fetched by its index entry; digests are recomputed.

    A response whose payload does not have its stated digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index_path in zip(batch.column("path").to_pylist(), batch.column("index_path").to_pylist(), strict=True):
                fs, _ = common.filesystem(path)
                with fs.open_input_stream(index_path, compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                found = []
                with fs.open_input_file(path) as f:
                    for e in entries:
                        f.seek(e["offset"])
                        headers, block = parse(gzip.decompress(f.read(e["length"])))
                        size, body = payload_of(block)
                        stated = headers["warc-payload-digest"].removeprefix("sha1:")
                        revisit = headers["warc-type"] == "revisit"
                        if not revisit and (digest32(body) != stated or len(body) != size):
                            raise ValueError(f"{path}, offset {e['offset']}: the payload is not the one stated")
                        found.append((_int(headers.get("page-id")), size, stated, headers["warc-type"], _int(headers.get("refers-to-page-id"))))
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    files = manifest.repartition(common.partitions(spark)).select("path", "index_path")
    return files.mapInArrow(run, ROWS)


def _int(x: str | None) -> int | None:
    return None if x is None else int(x)
