"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. The reader's tasks take byte ranges of the archives.
A task scans its range for the gzip magic, tries each place as a member by decoding its
first bytes and looking for a WARC header, and owns the records whose members begin inside its range,
reading past the range's end where a record does. A member counts only when its CRC and
its length fit; a place that only looks like a member is passed over.

Archives lie in a folder that driver and executors share, opened through pyarrow.fs, so any
store it knows (file, hdfs, s3, gs) serves. A task writes under names of its own and
reports them in its output; what the committed manifest does not name is not read, so lost or
repeated tasks leave no double records.

Defined results: a null page is the empty payload. Payloads under `least` bytes are
always responses. Of longer equal payloads the smallest page_id is the response; rows that repeat that id and
payload are responses too; null ids come last. An empty table gives an empty archive. Very long payloads pass through in parts.
Archives of other writers are read too: header names in any case, digests by SHA-1, SHA-256, SHA-512 or MD5 in hex or base 32
(`digest_fits`; null where there is none or its name is unknown), records that are no HTTP messages. payload_bytes and payload_digest (SHA-256) are measured;
a revisit, which has no payload, gives what it states, null where that is no number.
Control characters in a URL are percent-encoded in its header. Columns beside page_id, url and
html never enter.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import table
from strataweave.session import materialize, scratch_path

#: Algorithms of payload digests that are checked.
DIGESTS = ("sha256", "sha1", "md5", "sha512")
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 20
MANIFEST = "path string, bytes bigint, records bigint"
RECORDS = (
    "record_type string, record_id string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, "
    "digest_fits boolean, path string, at bigint, payload binary"
)


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member."""
    http = HTTP.format(len(payload)).encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        lines += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, folder: str, least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of `pages` (page_id, url, html) below `folder`; returns the manifest."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.sha2(html, 256).alias("digest")).filter(F.octet_length(html) >= least)
    first = rows.groupBy(F.col("digest").alias("f_digest")).agg(F.min("page_id").alias("first_id"))
    # Only ids and digests meet by digest. Pages meet their decisions by id, so a payload that very many share is not one key.
    ids = rows.distinct().join(first, F.col("digest") == F.col("f_digest")).filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
    again = ids.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "first_id")
    whole = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("digest"))
    joined = whole.join(again.hint("merge"), F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    joined = joined.select("page_id", "url", "html", "digest", "first_id", F.col("r_digest").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size, count, done = None, "", 0, 0, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first_id", "revisit"))
            for page_id, url, text, digest, first_id, revisit in zip(*columns, strict=True):
                if out is None:
                    name, size, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                member = record(page_id, url, (text or "").encode(), digest, first_id, revisit, date)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "bytes", "records"])

    return materialize(joined.mapInArrow(run, MANIFEST), "warc-manifest")


def _header(raw: bytes) -> dict[str, str] | None:
    if not raw.startswith(b"WARC/1."):
        return None
    fields = _fields(raw)
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


class _Source:
    """Bytes of an archive from any place on, read as they are needed."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, at: int, least: int) -> memoryview:
        """At least `least` bytes from `at`, fewer only at the end."""
        inside = at - self.at
        if inside < 0 or inside + least > len(self.held) and self.at + len(self.held) < self.size:
            self.file.seek(at)
            self.held, self.at, inside = self.file.read(min(max(least, READ_BYTES), self.size - at)), at, 0
        return memoryview(self.held)[inside:]


def _fields(raw: bytes) -> dict[str, str]:
    """Header lines by lower-case name."""
    lines = (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in lines if colon}


def stated_digest(text: str) -> tuple[str, str]:
    """Algorithm and lower-case hex of a digest header, whether it is in hex or base 32; the text itself where it is neither."""
    name, colon, value = text.partition(":")
    name = name.strip().lower().replace("-", "")
    if not colon or name not in DIGESTS:
        return "", text
    size = 2 * hashlib.new(name).digest_size
    if len(value) == size and not set(value.lower()) - set("0123456789abcdef"):
        return name, value.lower()
    try:
        return name, base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    except ValueError:
        return "", text


def _member(source: _Source, at: int, payloads: bool) -> tuple[int, dict] | None:
    """Length and content of the record whose member begins at `at`, or None if none does."""
    unpack = zlib.decompressobj(31)
    head, fields, digests, taken, got = b"", None, {"sha256": hashlib.sha256()}, 0, 0
    kept: list[bytes] = []
    http, body, need, size = b"", False, 0, 0
    try:
        while not unpack.eof:
            some = source.get(at + taken, 1)
            if not len(some):
                return None
            some = bytes(some[: 1 << 16])
            data = unpack.decompress(some)
            taken += len(some) - len(unpack.unused_data)
            if fields is None:
                head += data
                if not b"WARC/1.".startswith(head[:7]) or len(head) > 1 << 20:
                    return None
                stop = head.find(b"\r\n\r\n")
                if stop < 0:
                    continue
                fields = _header(head[:stop])
                if fields is None:
                    return None
                need, data = int(fields["content-length"]), head[stop + 4 :]
                body = not fields.get("content-type", "").lower().startswith("application/http")  # else its header comes first
                name, _ = stated_digest(fields.get("warc-payload-digest", ""))
                if name:
                    digests.setdefault(name, hashlib.new(name))
            block = data[: max(0, need - got)]
            got += len(data)
            if not body:
                http += block
                stop = http.find(b"\r\n\r\n")
                body, block = stop >= 0, http[stop + 4 :] if stop >= 0 else b""
                http = http[:stop] if stop >= 0 else http
            size += len(block)
            for d in digests.values():
                d.update(block)
            if payloads:
                kept.append(block)
    except zlib.error:
        return None
    if fields is None or got != need + 4:
        return None
    stated = _fields(http).get("content-length", "")
    fields |= {"size": size, "stated-size": int(stated) if stated.isascii() and stated.isdigit() else None}
    return taken, fields | {"digests": {k: d.hexdigest() for k, d in digests.items()}, "payload": b"".join(kept) if payloads else None}


def scan(path: str, start: int, stop: int, size: int, store: pafs.FileSystem, payloads: bool = False) -> Iterator[tuple]:
    """The records whose members begin in [start, stop)."""
    with store.open_input_file(path) as file:
        source, at = _Source(file, size), start
        while at < stop:
            window = bytes(source.get(at, min(len(MAGIC) + READ_BYTES // 2, size - at)))
            place = window.find(MAGIC, 0, stop - at + len(MAGIC) - 1)
            if place < 0:
                at += max(1, len(window) - len(MAGIC) + 1)
                continue
            at += place
            if at >= stop:
                break
            found = _member(source, at, payloads)
            if found is None:
                at += 1
                continue
            length, fields = found
            kind = fields["warc-type"].lower()
            name, stated = stated_digest(fields.get("warc-payload-digest", ""))
            own = fields["digests"]
            revisit = kind == "revisit"
            yield (
                kind,
                fields.get("warc-record-id"),
                fields.get("warc-target-uri"),
                fields.get("warc-refers-to"),
                fields["stated-size"] if revisit else fields["size"],
                (stated if name in ("", "sha256") else f"{name}:{stated}") if revisit else own["sha256"],
                None if revisit or not name else own[name] == stated,
                path,
                at,
                None if revisit else fields["payload"],
            )
            at += length


def read_archives(manifest: DataFrame, folder: str, split_bytes: int = 4 << 20, payloads: bool = False) -> DataFrame:
    """The records of the archives that `manifest` (path, bytes) names, each read once."""
    size = manifest.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    starts = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"))
    splits = starts.repartition(max(1, -(-size // split_bytes)), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_fits", pa.bool_()), ("path", pa.string()), ("at", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path, whole, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
                held: list[tuple] = []
                for row in scan(path, start, min(start + split_bytes, whole), whole, store, payloads):
                    held.append(row)
                    if len(held) >= (64 if payloads else 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return splits.mapInArrow(run, RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write `pages` as WARC archives and read them back."""
    folder = scratch_path(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)")
    return read_archives(manifest, folder).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"),
    )


ORACLE = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""
