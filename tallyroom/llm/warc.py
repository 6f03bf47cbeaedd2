"""Web archives: WARC records compressed one by one with a Zstandard dictionary, written and read by Spark.

**Writing.** Equal payloads are stored once: the row with the largest page id is the response, every other row a revisit
record that names it and carries no payload. Rows are grouped by the SHA-256 of the payload, the payload itself is taken
along once for each task and hash, and revisits are found on narrow rows, so a payload that a third of all pages
share costs one copy a task. A dictionary is trained on at most ``SAMPLE`` records of at most ``SAMPLE_BYTES``
each, those of the smallest hashes; it stands in a skippable frame at the head of each archive, and every record
is a frame of its own, so a reader can start at any of them. Tasks hand Spark whole archives of some ``ARCHIVE_BYTES``, one
row each, and Spark's text writer puts each row in a file; its commit keeps files of failed attempts out. What it
writes after a row is an empty skippable frame, so the files are plain concatenations of frames.

**Reading.** Archives are split over tasks by file. The payload of a response is checked against its digest, and a record
that does not hold what its header says raises an error rather than a wrong row.

Defined results: a null html is an empty payload. Payloads below ``least`` bytes are all responses. Of rows that share the page
id and the payload, one is the response and the others revisit it. Rows without a page id come last, so they are a response
only where no other row has the payload. Addresses are written with control characters, blanks and non-ASCII characters
percent-encoded. Fewer than ``FEWEST`` records give no dictionary, and an empty table no archives. Further
columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.llm.common import written
from tallyroom.workspace import new_folder

SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, FEWEST = 1000, 32_768, 112_640, 64
ARCHIVE_BYTES = 16_000_000
LEVEL = 3
#: Archives repeat from run to run, so the time of archiving is a parameter.
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the formats: the magic numbers of a frame that readers skip, of the frame that holds a dictionary, and names in records.
SKIPPED, DICTIONARY_FRAME = 0x184D2A50, 0x184D2A5D
NOTHING = struct.pack("<II", SKIPPED, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("page_id long, record_type string, record_id string, uri string, date string, payload_bytes long, payload_digest string, "
          "refers_to long, refers_to_id string, payload binary")


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(key: bytes, page_id: int | None, uri: str | None, copy: int) -> str:
    """A name that depends on nothing but the record."""
    name = hashlib.sha256(repr((key, page_id, uri, copy)).encode("utf-8", "surrogatepass")).digest()
    return f"urn:uuid:{uuid.UUID(bytes=name[:16], version=4)}"


def _uri(uri: str) -> str:
    return urllib.parse.quote(uri, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def record(kind: str, name: str, page_id: int | None, uri: str | None, digest: str, size: int, payload: bytes = b"", refers: tuple | None = None, date: str = DATE) -> bytes:
    """One WARC record. The head of the archived answer tells the size of the full payload, in revisits too."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode("ascii")
    block = head + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Target-URI", None if uri is None else _uri(uri)),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id)]
    if refers:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers[0]}>"), ("X-Refers-To-Page-ID", refers[1])]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("ascii") + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple:
    """The columns of RECORD."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("ascii").split("\r\n")
    field = dict(line.split(": ", 1) for line in lines)
    size = int(field["Content-Length"])
    if not first.startswith("WARC/") or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"not one whole WARC record: {first!r}, {field.get('WARC-Record-ID')}")
    answer, _, payload = rest[:size].partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) for line in answer.decode("ascii").split("\r\n")[1:])
    digest, full, kind = field["WARC-Payload-Digest"].removeprefix("sha1:"), int(said["Content-Length"]), field["WARC-Type"]
    if kind == "response" and (len(payload) != full or bare_digest(payload) != digest):
        raise ValueError(f"the payload of {field['WARC-Record-ID']} is not the one that was archived")
    number = lambda k: int(field[k]) if k in field else None
    bare = lambda k: field[k].strip("<>") if k in field else None
    return (number("X-Page-ID"), kind, bare("WARC-Record-ID"), field.get("WARC-Target-URI"), field["WARC-Date"], full, digest,
            number("X-Refers-To-Page-ID"), bare("WARC-Refers-To"), payload if kind == "response" else None)


def trained(records: list[bytes]) -> bytes:
    """A Zstandard dictionary, empty where there are too few records to learn from."""
    if len(records) < FEWEST:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=512, d=8).as_bytes()


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary if dictionary else b""


def archives(records: Iterator[bytes], dictionary: bytes, most: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """Whole archives: the dictionary, then a frame for each record. One is as large as ``most`` and its last record at most."""
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
    held, size = [], 0
    for raw in records:
        if not held:
            held = [dictionary_frame(dictionary)]
        held.append(squeeze.compress(raw))
        size += len(held[-1])
        if size >= most:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    view, at, opener = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic & ~15 == SKIPPED:
            if magic == DICTIONARY_FRAME:
                opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        one, parts, step = opener.decompressobj(), [], 1 << 14
        while not one.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            parts.append(one.decompress(view[at : at + step]))
            at = min(at + step, len(view))
            step *= 2
        at -= len(one.unused_data)
        yield b"".join(parts)


def _narrow(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
                        F.unhex(F.sha2(payload, 256)).alias("key"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).cast("long").alias("size"))


def _written(rows: DataFrame, record_of, dictionary: bytes, folder: str, most: int) -> None:
    """``rows`` as archives, a record each, by ``record_of(row)``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (record_of([c[i].as_py() for c in batch.columns]) for batch in batches for i in range(batch.num_rows))
        for archive in archives(records, dictionary, most):
            yield pa.record_batch({"archive": pa.array([archive], pa.binary())})

    packed = rows.mapInArrow(pack, "archive binary")
    (packed.select(F.col("archive").cast("string").alias("value"))
     .write.option("lineSep", NOTHING).option("maxRecordsPerFile", 1).mode("append").text(folder))


def write_archives(pages: DataFrame, folder: str, least: int = 0, most: int = ARCHIVE_BYTES) -> bytes:
    """Archive ``pages`` (page_id, url, html) in ``folder``; returns the dictionary."""
    whole = _narrow(pages)
    narrow = written(whole.drop("payload"), "pages")
    shared = F.col("size") >= least
    best = F.max(F.struct("page_id", "url")).alias("best")  # null before all others
    winners = narrow.where(shared).groupBy("key").agg(best)

    sampled = narrow.where(F.col("size").between(1, SAMPLE_BYTES)).groupBy("key").agg(F.min("size").alias("size")).orderBy("key").limit(SAMPLE).select("key")
    sample = whole.join(F.broadcast(sampled), "key").groupBy("key").agg(best, F.first("payload").alias("payload"))  # SAMPLE keys of 32 bytes
    taken = sample.orderBy("key").collect()  # SAMPLE payloads of SAMPLE_BYTES at most
    dictionary = trained([_response(bytes(r["key"]), r["best"]["page_id"], r["best"]["url"], 0, bytes(r["payload"])) for r in taken])

    # Equal keys have equal payloads, so any of them will do.
    stored = whole.where(shared).groupBy("key").agg(best, F.first("payload").alias("payload")).select("key", "best.page_id", "best.url", F.lit(0).cast("long").alias("copy"), "payload")
    _written(stored, lambda r: _response(*r), dictionary, folder, most)
    groups = narrow.groupBy("key", "digest", "page_id", "url", "size").agg(F.count("*").alias("n"))
    if least > 0:
        copies = groups.where(~shared).select("key", "page_id", "url", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
        small = whole.where(~shared).groupBy("key").agg(F.first("payload").alias("payload"))  # below ``least`` bytes each
        _written(copies.join(small, "key").select("key", "page_id", "url", "copy", "payload"), lambda r: _response(*r), dictionary, folder, most)
    others = groups.where(shared).join(winners, "key").withColumn("first", F.when(F.struct("page_id", "url").eqNullSafe(F.col("best")), 1).otherwise(0).cast("long"))
    revisits = others.where("n > first").select(
        "key", "page_id", "url", F.explode(F.sequence("first", F.col("n") - 1)).alias("copy"), "size", "digest", F.col("best.page_id").alias("of"), F.col("best.url").alias("of_url"))
    _written(revisits, lambda r: _revisit(*r), dictionary, folder, most)
    return dictionary


def _response(key: bytes, page_id: int | None, uri: str | None, copy: int, payload: bytes) -> bytes:
    return record("response", record_id(key, page_id, uri, copy), page_id, uri, bare_digest(payload), len(payload), payload)


def _revisit(key: bytes, page_id: int | None, uri: str | None, copy: int, size: int, digest: bytes, of: int | None, of_uri: str | None) -> bytes:
    return record("revisit", record_id(key, page_id, uri, copy), page_id, uri, base64.b32encode(digest).decode("ascii"), size, refers=(record_id(key, of, of_uri, 0), of))


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records in ``folder``, with the columns of RECORD; without ``payloads`` they are checked and left out."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORD.split(", ")])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for raw in frames(content.as_py()):
                    row = parsed(raw)
                    rows.append(row if payloads else (*row[:-1], None))
                    size += len(row[-1] or b"") * payloads + 200
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    found = spark.read.format("binaryFile").load(folder).select("content").mapInArrow(unpack, RECORD)
    return found.select(*[n for n in names if payloads or n != "payload"])


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op12_warc_archives": op12_warc_archives}
ORACLES = {"op12_warc_archives": """
with p as (
  select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x, max(page_id) over (partition by coalesce(html, '')) as best from pages),
-- Five hexadecimal digits are four digits of base 32.
q as (select *, [('0x' || substr(x, 5 * k + 1, 5))::int for k in range(8)] as fives from p)
select page_id, strlen(h)::bigint as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1) for v in fives], '') as payload_digest,
  case when page_id = best then 'response' else 'revisit' end as record_type, case when page_id <> best then best end as refers_to
from q"""}
