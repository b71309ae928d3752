"""Legacy archive converter: ARC files of both versions to WARC files.

ARC records are a header line of space-parted fields with a declared length, then so many
bytes. Version 1 has URL, IP, date, type and length; version 2 has URL, IP, date, type,
result code, checksum, location, offset, file name and length. The version is in the first
record, the ``filedesc:``. Files are written with one gzip member for each record, so a
reader can start at any record.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import file_system, hot_keys, join_salted, keep, ship, slice_texts, utf8, work_dir

#: Payloads below so many bytes are never revisits.
REVISIT_BYTES = 100
#: The capture time of pages that have none, as ARC's 14 digits.
CAPTURED = "20000101000000"
#: Level of gzip members.
LEVEL = 1
#: Bytes of an archive at which a task begins the next.
ARCHIVE_BYTES = 128 << 20
_V1 = "URL IP-address Archive-date Content-type Archive-length"
_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"


def member(data: bytes) -> bytes:
    """One gzip member, without a time in it, so that reruns give equal bytes."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def arc_head(name: str, version: int = 1) -> bytes:
    body = f"{version} 0 sparkloom\n{_V1 if version == 1 else _V2}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", CAPTURED, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else [])
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_record(url: str | None, http: bytes, payload: bytes, version: int = 1, date: str = CAPTURED, kind: str = "text/html") -> bytes:
    """One ARC record; white space in a URL is escaped since it parts the fields."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "unknown:"
    fields = [url, "0.0.0.0", date, kind] + (["200", "-", "-", "0", "-"] if version == 2 else [])
    return " ".join([*fields, str(len(http) + len(payload))]).encode() + b"\n" + http + payload + b"\n"


def parse_arc(data: bytes, version: int | None = None):
    """Yields (fields, body) of each record of ARC bytes; ``version`` is needed where the first record isn't a filedesc.

    Lengths are counted as declared; a record cut short or a line with too few fields
    raises ValueError.
    """
    at = 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if parts[0].startswith("filedesc:"):
            version = int(data[end + 1 : end + 2])
        names = ("url", "ip", "date", "type", "length") if version == 1 else ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length")
        if version not in (1, 2) or len(parts) < len(names):
            raise ValueError(f"no ARC header at byte {at}")
        if extra := len(parts) - len(names):  # a media type with parameters, or a URL with spaces
            head = next((k for k, p in enumerate(parts) if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", p)), 1 + extra)
            parts = [" ".join(parts[:head]), *parts[head : head + 2], " ".join(parts[head + 2 : len(parts) - len(names) + 4]), *parts[len(parts) - len(names) + 4 :]]
        fields = dict(zip(names, parts))
        n = int(fields["length"])
        body = data[end + 1 : end + 1 + n]
        if len(body) < n:
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, body
        at = end + 1 + n


def members(source, step: int = 1 << 16):
    """Yields (offset, length, bytes) of each gzip member of a file that is read from its start, a step at a time."""
    at, rest = 0, source.read(step)
    while rest:
        z, out, n = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not rest:
                raise ValueError(f"the member at byte {at} is cut short")
            out.append(z.decompress(rest))
            n += len(rest) - len(z.unused_data)
            rest = z.unused_data if z.eof else source.read(step)
        yield at, n, b"".join(out)
        at, rest = at + n, rest or source.read(step)


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload; a body without a head is all payload."""
    if body.startswith(b"HTTP/"):
        k = body.find(b"\r\n\r\n")
        if k >= 0:
            return body[: k + 4], body[k + 4 :]
    return b"", body


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace") if m else None


def warc_date(date: str) -> str:
    """ARC's 12 or 14 digits as WARC's UTC time; what can't be read becomes the default time."""
    try:
        t = datetime.strptime(date[:14].ljust(14, "0"), "%Y%m%d%H%M%S")
    except ValueError:
        t = datetime.strptime(CAPTURED, "%Y%m%d%H%M%S")
    return t.replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(key: str) -> str:
    """An identifier that reruns repeat: a UUID (version 8) made of a hash of the record's key."""
    h = bytearray(hashlib.sha256(key.encode()).digest()[:16])
    h[6], h[8] = h[6] & 15 | 128, h[8] & 63 | 128
    x = h.hex()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def warc_record(fields: dict, body: bytes, digest: str, first_key: str | None, key: str) -> bytes:
    """The WARC record of an ARC record: a response, or a revisit of the record with ``first_key`` that keeps the HTTP head only."""
    head, payload = split_http(body)
    block = head if first_key else body
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if first_key else 'response'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {warc_date(fields['date'])}",
        f"WARC-Target-URI: {fields['url']}", f"WARC-IP-Address: {fields['ip']}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Type: {'application/http; msgtype=response' if head else fields['type']}", f"Content-Length: {len(block)}", f"X-Payload-Length: {len(payload)}",
    ]
    if first_key:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first_key)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> tuple[dict, bytes]:
    """Fields (names in lower case) and block of one WARC record."""
    k = data.index(b"\r\n\r\n")
    first, *lines = data[:k].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {n.lower(): v.strip() for n, _, v in (x.partition(":") for x in lines)}
    block = data[k + 4 : k + 4 + int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError("a WARC record is cut short")
    return fields, block


class _Files:
    """Writes a task's archives; each appears when whole, under a name that reruns repeat."""

    def __init__(self, out: str, stem: str, head: bytes = b"", suffix: str = "arc.gz"):
        self.out, self.stem, self.head, self.suffix, self.k, self.f, self.place, self.done = out, stem, head, suffix, 0, None, 0, []

    def add(self, data: bytes) -> tuple[str, int, int]:
        from pyspark import TaskContext

        if self.f is None:
            self.uri = f"{self.out}/{self.stem}-{self.k:04d}.{self.suffix}"
            self.store, self.path = file_system(self.uri)
            self.temp = f"{self.path}.{TaskContext.get().taskAttemptId()}.tmp"
            self.f, self.place = self.store.open_output_stream(self.temp, compression=None), 0
            if self.head:
                self.f.write(h := member(self.head))
                self.place = len(h)
        self.f.write(data)
        at, self.place = self.place, self.place + len(data)
        uri = self.uri
        if self.place >= ARCHIVE_BYTES:
            self.close()
        return uri, at, len(data)

    def close(self) -> None:
        if self.f is not None:
            self.f.close()
            self.store.move(self.temp, self.path)
            self.done.append(self.uri)
            self.f, self.k = None, self.k + 1


def write_arc(pages: DataFrame, out: str, page_id: str = "page_id", url: str = "url", html: str = "html", version: int | None = None) -> list[str]:
    """Writes pages as ARC files, an HTTP response each; returns the files' URIs in order.

    Without a ``version`` pages with odd ids go to files of version 2, others to version 1.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("p"), F.col(url).cast("string").alias("u"), F.col(html).alias("h"))

    def run(batches):
        from pyspark import TaskContext

        stem = f"pages-{TaskContext.get().partitionId():06d}"
        both = {v: _Files(out, f"{stem}-v{v}", arc_head(stem, v)) for v in ((1, 2) if version is None else (version,))}
        for b in batches:
            for p, u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), slice_texts(*utf8(b.column(2)))):
                head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(h)}\r\n" + (f"X-Page-Id: {p}\r\n" if p is not None else "") + "\r\n"
                v = version or 1 + (p or 0) % 2
                both[v].add(member(arc_record(u, head.encode(), h, v)))
        for files in both.values():
            files.close()
        if done := [uri for files in both.values() for uri in files.done]:
            yield pa.RecordBatch.from_pydict({"uri": done})

    return sorted(r.uri for r in rows.mapInArrow(run, "uri string").collect())


def _listed(spark, uris: list[str]) -> DataFrame:
    df = spark.createDataFrame([(u,) for u in uris], "uri string")
    return df.repartition(max(1, len(uris))) if uris else df


def _open(uri: str):
    store, path = file_system(uri)
    return store.open_input_stream(path, compression=None)


def index_arc(spark, uris: list[str]) -> DataFrame:
    """One row per record of ARC files: uri, at (number in its file), page_id, digest (SHA-256 of the payload), length."""
    ship(spark)
    shape = pa.schema([("uri", pa.string()), ("at", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("length", pa.int64())])

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                out = []
                with _open(uri) as f:
                    for at, (fields, body) in enumerate(_records(f)):
                        head, payload = split_http(body)
                        p = http_field(head, "X-Page-Id")
                        out.append((uri, at, int(p) if p else None, hashlib.sha256(payload).hexdigest(), len(payload)))
                        if len(out) == 1000:
                            yield _batch(out, shape)
                            out = []
                yield _batch(out, shape)

    return _listed(spark, uris).mapInArrow(run, "uri string, at long, page_id long, digest string, length long")


def _batch(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in rows], shape)


def _records(source):
    """The records after the filedesc of an ARC file with a gzip member for each record, read as a stream."""
    version = None
    for _, _, x in members(source):
        for fields, body in parse_arc(x, version):
            if fields["url"].startswith("filedesc:"):
                version = int(body[:1])
            else:
                yield fields, body


def convert(spark, uris: list[str], out: str, least: int = REVISIT_BYTES) -> list[str]:
    """Converts ARC files to WARC files, one for each, and returns their URIs.

    Of records with equal payloads of at least ``least`` bytes the one with the smallest
    page_id (null last, then by place) is a response and the others revisit it.
    """
    index = keep(index_arc(spark, uris), f"{out}/index")
    place = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "uri", "at")
    long = index.where(F.col("length") >= least).withColumn("k", F.xxhash64("digest"))
    firsts = keep(long.groupBy("k", "digest").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1"), f"{out}/firsts")
    revisits = join_salted(long, firsts.select("k", "digest", "f"), ["k", "digest"], hot_keys(firsts, "k", "c", index.count()), F.xxhash64("uri", "at"))
    revisits = revisits.where((F.col("uri") != F.col("f.uri")) | (F.col("at") != F.col("f.at")))
    told = revisits.select("uri", "at", F.concat_ws("#", F.col("f.uri"), F.col("f.at")).alias("key"))
    rows = index.select("uri", "at", "digest").join(told, ["uri", "at"], "left")
    placed = rows.repartition(max(1, len(uris)), "uri").sortWithinPartitions("uri", "at")

    def run(batches):
        uri = files = source = None
        made = []
        for b in batches:
            for u, at, digest, key in zip(*(c.to_pylist() for c in b.columns)):
                if u != uri:
                    if files:
                        files.close()
                        made += files.done
                    uri, stem = u, u.rsplit("/", 1)[1].split(".")[0]
                    files, source = _Files(out, stem, suffix="warc.gz"), enumerate(_records(_open(u)))
                k, (fields, body) = next(source)
                if k != at:
                    raise ValueError(f"the index of {u} lacks a record")
                files.add(member(warc_record(fields, body, digest, key, f"{u}#{at}")))
        if files:
            files.close()
            made += files.done
        if made:
            yield pa.RecordBatch.from_pydict({"uri": made})

    return sorted(r.uri for r in placed.select("uri", "at", "digest", "key").mapInArrow(run, "uri string").collect())


def read_warc(spark, uris: list[str], out: str) -> DataFrame:
    """One row per record of WARC files, with what its fields say; the digest of a response is checked against its payload.

    What a revisit refers to is found by the identifiers: the page of the record that WARC-Refers-To names.
    """
    ship(spark)
    shape = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("warc_date", pa.string()), ("url", pa.string())])

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = []
                with _open(uri) as source:
                    for _, _, x in members(source):
                        f, block = parse_warc(x)
                        head, payload = split_http(block)
                        digest = f["warc-payload-digest"].partition(":")[2]
                        if f["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"a payload in {uri} isn't what its digest says")
                        page = http_field(head, "X-Page-Id")
                        rows.append((int(page) if page else None, int(f["x-payload-length"]), digest, f["warc-type"], f["warc-record-id"], f.get("warc-refers-to"), f["warc-date"], f["warc-target-uri"]))
                        if len(rows) == 1000:
                            yield _batch(rows, shape)
                            rows = []
                yield _batch(rows, shape)

    read = _listed(spark, uris).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_record string, warc_date string, url string")
    read = keep(read, f"{out}/records")
    responses = read.where("record_type = 'response'").select(F.xxhash64("record_id").alias("k"), F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    revisits = read.where("record_type = 'revisit'").withColumn("k", F.xxhash64("refers_to_record"))
    often = hot_keys(revisits.groupBy("k").agg(F.count(F.lit(1)).alias("c")), "k", "c", read.count())
    told = join_salted(revisits, responses, ["k", "refers_to_record"], often, F.xxhash64("record_id"), "left").drop("k")
    return read.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(told)


def pages_through_warc(pages: DataFrame, version: int | None = None) -> DataFrame:
    """Pages to ARC files (of both versions unless one is named), those to WARC files, and the records of the latter.

    A null html is an empty payload, a null url becomes ``unknown:``, a null page_id stays
    null. Repeated rows make a record each; of equal ids the first in place is the
    response. An empty table gives no records; other columns aren't read.
    """
    spark = ship(pages.sparkSession)
    out = work_dir(spark)
    return read_warc(spark, convert(spark, write_arc(pages, out, version=version), out), out)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    found = pages_through_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
