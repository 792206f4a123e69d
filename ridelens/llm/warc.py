"""WARC archives: writing pages, normalising whole-file gzip, reading by index.

Many tools gzip a WARC file as one stream, so that no record can be reached
without inflating all before it.  `normalise` takes such archives, each in one
task: the stream is inflated once, piece by piece, every record's bytes are
copied unchanged into a gzip member of its own, and a sidecar file
(`<archive>.idx`, one JSON line per record: offset, length, type, record id,
target, digest) says where each member lies.  `read_records` fetches members by
that index alone.  Memory is bounded by a buffer while writing and normalising,
and by one record while reading.

`write_pages` writes such whole-file archives of pages: a `response` record
holds an HTTP block with the html, and a page whose payload equals that of a
smaller page_id (at least `least` bytes) is a `revisit` record that refers to
it.  Equal payloads meet by their SHA-256, counted per task first, and only
digests that occur twice take part in the join with the pages.

Tasks write under names of their own attempt, and only names returned by
finished tasks enter the stored tables of archives, so retries do no harm.

Edge cases: null html is an empty payload; all rows that carry the smallest
page_id of equal payloads are responses (equal rows give equal records); a null
page_id is never referred to, so it revisits a known page or is a response; a
null url becomes `urn:unknown`, white space and control characters of a url are
percent-encoded; an empty table gives no archive and no rows; extra columns are
not read.  A truncated or damaged archive is an error that names it.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.llm.common import if_small, pick, read_table, scratch, small_batches, stored
from ridelens.llm.token_files import open_store
from ridelens.sources.io import drop_scratch

PIECE = 1 << 20
ARCHIVE_BYTES = 256 << 20
ARCHIVE_SCHEMA = "name string, n_records long, n_bytes long"
RECORD_SCHEMA = ("archive string, offset long, length long, record_type string, record_id string, "
                 "refers_to_id string, target_uri string, page_id long, refers_to long, payload_bytes long, "
                 "payload_digest string")
# fixed values of the format
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
UNKNOWN_DATE = "1970-01-01T00:00:00Z"


# records ---------------------------------------------------------------------

def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}:{digest}'.encode()).hexdigest()[:32])}>"


def header_block(lines: list[tuple[str, str]]) -> bytes:
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                date: str = UNKNOWN_DATE) -> bytes:
    """The bytes of one record; `refers_to` makes it a revisit without payload."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:unknown"
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"),
             ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", target),
             ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        lines.append(("X-Page-Id", str(page_id)))
    if refers_to is None:
        http += payload
    else:
        lines += [("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to)),
                  ("WARC-Profile", SAME_PAYLOAD)]
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http)))]
    return header_block(lines) + http + END


def read_header(stream) -> tuple[bytes, dict[str, str]] | None:
    """The next record's header, as it stands and as lower-cased names with
    their values, or None at the end of the stream."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins with {line[:40]!r}")
    raw, fields, name = [line], {}, ""
    while True:
        line = stream.readline()
        raw.append(line)
        if line in (b"\r\n", b"\n"):
            return b"".join(raw), fields
        if not line:
            raise EOFError("the archive ends inside a record's header")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:  # a folded line goes on with the value before
            fields[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()


def body_pieces(stream, length: int) -> Iterator[bytes]:
    """The `length` bytes of a record's block, never more than a piece at once."""
    while length:
        piece = stream.read(min(length, PIECE))
        if not piece:
            raise EOFError("the archive ends inside a record's block")
        length -= len(piece)
        yield piece


# writing ---------------------------------------------------------------------

def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload (binary), digest and refers_to: the smallest
    page_id with an equal payload of at least `least` bytes, if it is another."""
    p = pick(pages, page_id="long", url="string", html="string").select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    groups = stored(p.where(F.octet_length("payload") >= least).groupBy("digest")
                    .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1 and first is not null").drop("n"), "equal-payloads")
    joined = p.join(if_small(groups), "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(
        ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _archive_rows(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        zip(*rows) if rows else ((), (), ()), (pa.string(), pa.int64(), pa.int64()))], ["name", "n_records", "n_bytes"])


def write_pages(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Write the rows of `with_revisits` as archives of one gzip stream each, a
    new one after `archive_bytes` of records; returns the stored table of
    archives (name, n_records, n_bytes inflated)."""
    spark = records.sparkSession

    def write(batches):
        store, folder = open_store(path)
        store.create_dir(folder, recursive=True)
        out = squeeze = name = None
        n_records = n_bytes = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, n_records, n_bytes = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                record = page_record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                out.write(squeeze.compress(record))
                n_records, n_bytes = n_records + 1, n_bytes + len(record)
                if n_bytes >= archive_bytes:
                    out.write(squeeze.flush())
                    out.close()
                    out = None
                    yield _archive_rows([(name, n_records, n_bytes)])
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            yield _archive_rows([(name, n_records, n_bytes)])

    with small_batches(spark):
        return stored(records.mapInArrow(write, ARCHIVE_SCHEMA), "warc-archives")


# normalising -----------------------------------------------------------------

def normalise_stream(stream, out, index) -> tuple[int, int]:
    """Copy the records of an inflating `stream` to `out`, a gzip member each,
    and their places to `index`; returns (records, inflated bytes)."""
    offset = n_records = n_bytes = 0
    while (found := read_header(stream)) is not None:
        raw, fields = found
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        length, inflated = 0, len(raw)

        def put(piece: bytes) -> None:
            nonlocal length
            length += len(piece)
            out.write(piece)
        put(squeeze.compress(raw))
        for piece in body_pieces(stream, int(fields["content-length"])):
            inflated += len(piece)
            put(squeeze.compress(piece))
        put(squeeze.compress(END))
        put(squeeze.flush())
        index.write((json.dumps({
            "offset": offset, "length": length, "type": fields.get("warc-type"), "id": fields.get("warc-record-id"),
            "target": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}) + "\n").encode())
        offset, n_records, n_bytes = offset + length, n_records + 1, n_bytes + inflated + len(END)
    return n_records, n_bytes


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive `name` in the folder `source` into `target`, one
    task an archive; returns the stored table of the new archives."""
    spark = archives.sparkSession

    def run(batches):
        (store, folder), (sink, into) = open_store(source), open_store(target)
        sink.create_dir(into, recursive=True)
        for row in chain.from_iterable(b.to_pylist() for b in batches):
            name = f"{row['name'].removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
            with store.open_input_stream(f"{folder}/{row['name']}", compression=None) as packed, \
                    sink.open_output_stream(f"{into}/{name}", compression=None) as out, \
                    sink.open_output_stream(f"{into}/{name}.idx", compression=None) as index:
                try:
                    n_records, n_bytes = normalise_stream(gzip.GzipFile(fileobj=packed), out, index)
                except (EOFError, ValueError, KeyError, OSError, zlib.error) as fault:
                    raise ValueError(f"{source}/{row['name']}: {fault}") from fault
            yield _archive_rows([(name, n_records, n_bytes)])

    n = max(1, archives.count())  # archives, one task each
    return stored(archives.select("name").repartition(n).mapInArrow(run, ARCHIVE_SCHEMA), "warc-members")


# reading ---------------------------------------------------------------------

def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record header, HTTP header, payload) of one inflated record."""
    stream = io.BytesIO(member)
    _, fields = read_header(stream)
    block = b"".join(body_pieces(stream, int(fields["content-length"])))
    if not fields.get("content-type", "").startswith("application/http"):
        return fields, {}, block
    head, _, payload = block.partition(END)
    http = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    return fields, {k.lower(): v for k, v in http.items()}, payload


def _record_row(archive: str, place: dict, member: bytes) -> dict:
    fields, http, payload = parse_record(member)
    declared = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") == "revisit":
        n_bytes, digest = http.get("content-length"), declared.removeprefix("sha256:")
        n_bytes = int(n_bytes) if n_bytes else None
        payload = None
    else:
        n_bytes, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if declared.startswith("sha256:") and declared != f"sha256:{digest}":
            raise ValueError(f"the payload of {fields.get('warc-record-id')} does not have its digest")

    def number(name: str) -> int | None:
        return int(fields[name]) if name in fields else None
    return {"archive": archive, "offset": place["offset"], "length": place["length"],
            "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"),
            "refers_to_id": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"),
            "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"),
            "payload_bytes": n_bytes, "payload_digest": digest, "payload": payload}


def read_records(archives: DataFrame, path: str, payloads: bool = False) -> DataFrame:
    """RECORD_SCHEMA of every record in the normalised archives `name`, fetched
    member by member at the places their sidecars name; with `payloads`, the
    payload as well (null for revisits)."""
    spark: SparkSession = archives.sparkSession
    schema = RECORD_SCHEMA + (", payload binary" if payloads else "")
    arrow = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]])
                       for f in schema.split(", ")])

    def run(batches):
        store, folder = open_store(path)
        for row in chain.from_iterable(b.to_pylist() for b in batches):
            file = f"{folder}/{row['name']}"
            with store.open_input_file(file) as members, \
                    store.open_input_stream(f"{file}.idx", compression=None) as index:
                held, size = [], 0
                for line in io.BufferedReader(index):
                    place = json.loads(line)
                    try:
                        member = zlib.decompress(members.read_at(place["length"], place["offset"]), 31)
                        held.append(_record_row(row["name"], place, member))
                    except (EOFError, ValueError, KeyError, zlib.error) as fault:
                        raise ValueError(f"{file} at {place['offset']}: {fault}") from fault
                    size += len(member) if payloads else 0
                    if len(held) >= 1000 or size >= 32 << 20:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    n = max(1, archives.count())
    return archives.select("name").repartition(n).mapInArrow(run, schema)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    whole, members = scratch(spark, "warc-whole"), scratch(spark, "warc")
    archives = write_pages(with_revisits(read_table(spark, sf_dir, "pages")), whole)
    normalised = normalise(archives, whole, members)
    drop_scratch(spark, whole)  # its only reader is done
    return read_records(normalised, members).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
