"""WARC archives compressed with a Zstandard dictionary of their own.

An archive starts with a skippable frame that holds a dictionary, built from the archive's
records; every record is a frame by itself, compressed with it. A page whose payload another
page has too becomes a revisit record, without payload, that refers to that page's record.

Tasks write whole archives to the shared folder under names of their own and report them; only reported archives are
read, so what a lost or repeated attempt leaves behind does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_hot, new_folder, opened, screen, stored, table

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
#: Bytes of a dictionary, of the records it is built from, and of records in an archive, at most about.
DICTIONARY, SAMPLE, ARCHIVE = 32 << 10, 1 << 20, 64 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: Records are cut into pieces of so many bytes for the dictionary's builder, which needs a number of samples.
_PIECE = 1 << 13
_SKIPPABLE = struct.Struct("<II")
_MAGIC = 0x184D2A5D
_NAME = "urn:corpusmill:page:"


def record(kind: str, name: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the payload, or a revisit of the page refers_to with the HTTP header only."""
    name = f"{_NAME}{'none' if page_id is None else page_id}"
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or name)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return record("response", name, headers, http + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_NAME}{refers_to}>")]
    return record("revisit", name, headers, http)


def compressed(records: Iterator[bytes]) -> Iterator[tuple[bytes, int]]:
    """Archives of the records, each with the number of its pages."""
    held: list[bytes] = []
    size = 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= ARCHIVE:
            yield archive(held), len(held)
            held, size = [], 0
    if held:
        yield archive(held), len(held)


def archive(records: list[bytes]) -> bytes:
    """One archive; without a dictionary if its records are too few or too small to build one."""
    # From records all over the archive, of each at most a sixteenth of the sample, so that long records leave room for others.
    step, sample, size = max(1, sum(map(len, records)) // SAMPLE), [], 0
    for r in records[::step] if len(records) // step >= 16 else records:
        if size >= SAMPLE:
            break
        parts = [r[i : i + _PIECE] for i in range(0, min(len(r), SAMPLE // 16), _PIECE)]
        sample += parts
        size += sum(map(len, parts))
    try:
        words = zstandard.train_dictionary(min(DICTIONARY, max(1024, size // 8)), sample, level=LEVEL, k=256, d=8)
    except zstandard.ZstdError:
        words = None
    out = io.BytesIO()
    if words:
        words.precompute_compress(level=LEVEL)
        raw = words.as_bytes()
        out.write(_SKIPPABLE.pack(_MAGIC, len(raw)) + raw)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True, write_content_size=True)
    out.write(press.compress(record("warcinfo", "urn:corpusmill:info", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
    for r in records:
        out.write(press.compress(r))
    return out.getvalue()


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    words, at = None, 0
    if len(content) >= _SKIPPABLE.size:
        magic, size = _SKIPPABLE.unpack_from(content)
        if magic == _MAGIC:
            at = _SKIPPABLE.size + size
            words = zstandard.ZstdCompressionDict(content[_SKIPPABLE.size : at])
    opened = zstandard.ZstdDecompressor(dict_data=words).stream_reader(io.BytesIO(content[at:]), read_across_frames=True)
    with io.BufferedReader(opened, 1 << 20) as lines:
        while first := lines.readline():
            if not first.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            headers = {}
            while (line := lines.readline().rstrip(b"\r\n")) and b":" in line:
                k, v = line.split(b":", 1)
                headers[k.decode().lower()] = v.strip().decode()
            block = lines.read(int(headers["content-length"]))
            lines.read(4)
            yield headers, block


def _page(name: str) -> int | None:
    tail = name.strip("<>").removeprefix(_NAME)
    return None if tail == "none" else int(tail)


def page_of(headers: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of a response or revisit."""
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)[1])
    if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {headers['warc-record-id']}")
    refers = _page(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
    return _page(headers["warc-record-id"]), size, digest, headers["warc-type"], refers, payload


def with_references(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html (null as empty) and refers_to, the page that a row revisits.

    Only pages whose digest a screen of the repeated ones lets through are moved, and of those not the ones of hot digests.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("html", 256)))
    large = rows.where(F.octet_length("html") >= LEAST_BYTES)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 and response is not null")
    groups = stored(groups, "warc-groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    maybe = screen(groups.select(F.xxhash64("digest")))(F.xxhash64("digest")) & (F.octet_length("html") >= LEAST_BYTES)
    named = joined_hot(rows.where(maybe), groups.select("digest", "n", "response"), ["digest"], "n", total, left=True)
    linked = rows.where(~maybe).withColumn("response", F.lit(None).cast("long")).unionByName(named)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return linked.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages to archives in folder, which every executor must reach; returns file, pages, bytes of each."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()

        def records() -> Iterator[bytes]:
            for batch in batches:
                for i in range(batch.num_rows):
                    page, url, html, refers = (batch.column(k)[i].as_py() for k in range(4))
                    yield page_record(page, url, html.encode(), refers)

        for k, (content, n) in enumerate(compressed(records())):
            name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n]), pa.array([len(content)])], ["file", "pages", "bytes"])

    return stored(with_references(pages, id_col, url_col, html_col).mapInArrow(write, "file string, pages long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each response and revisit record of the archives (file): page_id, payload_bytes, payload_digest, record_type, refers_to, and payload if asked for.

    Tasks open the archives that their rows of the manifest name, so the list isn't gathered anywhere. A response's payload is checked
    against its digest and length; a revisit's are those that its record states.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    n = 6 if payloads else 5

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * n
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds[:n], strict=True)], names[:n])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = opened(file)
                with store.open_input_stream(path, compression=None) as f:
                    content = f.read()
                rows, size = [], 0
                for headers, block in records_of(content):
                    if headers["warc-type"] in ("response", "revisit"):
                        rows.append(page_of(headers, block)[:n])
                        size += len(block) * payloads
                        if len(rows) >= 10_000 or size > 32 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                yield batch_of(rows)

    return manifest.select("file").mapInArrow(read, schema)


def archived(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages to archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. Of equal payloads of at least LEAST_BYTES bytes the page with the largest page_id is
    the response; rows that repeat it are responses too, and rows without a page_id revisit it. If no
    page of the group has an id, all are responses. A null url is written as the record's own name.
    An empty table gives no archive and no rows.
    """
    return read_archives(write_archives(pages, folder or new_folder(pages.sparkSession, "warc"), id_col, url_col, html_col))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of the whole of pages, written and read back; see archived() for nulls and repeats."""
    return archived(table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT html, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY html HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html
"""
