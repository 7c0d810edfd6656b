"""WARC records in ZIP packages: written by tasks, read back by ranges.

A package is a ZIP file (ZIP64 throughout) with stored members below archive/ - WARC files, one gzip member per record -
and below indexes/ - CDXJ lines with each record's file, offset and length. The reader parses the end record, the ZIP64
locator and the central directory, finds the stored members' data behind their local headers, reads every index (CDXJ
or CDX with a header line, plain or gzipped) and then fetches records by ranges of the package file; nothing is
extracted. Archive members that no index names are read from end to end, one range each.

Records with equal payloads of at least LEAST_BYTES bytes are written once: the one with the largest page_id is a
response, the others revisit it. The target of each digest is a grouped maximum; hot payloads are combined before the
shuffle. Packages are rolled at ROLL_BYTES, so a task holds one small index; a package that a lost task left behind is
never listed, because the list of packages is what the finished tasks returned, kept as a table before any reading.

Defined cases: null html is an empty payload; null url: no target header; equal rows with the largest page_id are all responses;
null page_ids are never the target unless all are null, and then all are responses; empty table: no package, no rows;
other columns are ignored. Of packages made elsewhere: members that are compressed in the ZIP are left out; records other
than responses and revisits have their type, no payload and no page_id; missing digests are taken from the payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from itertools import islice
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_parts, new_path, table

LEAST_BYTES = 1000
ROLL_BYTES = 64 << 20
#: Adjacent records fetched by one read.
RANGE_BYTES = 1 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def with_targets(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses)."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = p.select("page_id", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    first = large.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("copies")).where("copies > 1").select("digest", "target")
    return p.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.coalesce(F.col("page_id") != F.col("target"), F.col("target").isNotNull()), F.col("target")).alias("refers_to"))


def _record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _sort_key(url: str | None) -> str:
    """The host's labels in reverse order and the rest of the url, without blanks."""
    host, _, rest = (url or "").partition("://")[2].partition("/")
    return "".join(quote(f"{','.join(reversed(host.lower().split('.')))})/{rest}", safe=",)/?&=;:@!$*+%-._~").split()) or "-"


class _Package:
    """One ZIP package being written; data is kept in memory until it is rolled (ROLL_BYTES at most, or one record)."""

    def __init__(self):
        self.data, self.index = io.BytesIO(), []

    def add(self, raw: bytes, url: str | None, digest: str) -> None:
        packed, at = gzip.compress(raw, 6, mtime=0), self.data.tell()
        self.data.write(packed)
        self.index.append(f"{_sort_key(url)} 20000101000000 {json.dumps({'url': url, 'digest': f'sha1:{digest}', 'length': str(len(packed)), 'offset': str(at), 'filename': DATA.rpartition('/')[2]})}\n")

    def write(self, folder: str) -> tuple[str, int]:
        name, out = f"{folder}/{uuid.uuid4().hex}.wacz", io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for member, content in ((DATA, self.data.getbuffer()), (INDEX, "".join(sorted(self.index)).encode()), ("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}).encode())):
                with z.open(zipfile.ZipInfo(member), "w", force_zip64=True) as m:
                    m.write(content)
        store, path = _store(name)
        with store.open_output_stream(path) as f:
            f.write(out.getbuffer())
        return name, len(self.index)


def write_packages(records: DataFrame, folder: str, roll: int = ROLL_BYTES) -> DataFrame:
    """package, records: the packages that the tasks wrote into folder, kept as a table."""

    def run(batches):
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        box, done = _Package(), []
        for b in in_parts(batches):
            for row in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]):
                box.add(record(*row), row[1], row[3])
                if box.data.tell() >= roll:
                    done.append(box.write(folder))
                    box = _Package()
        if box.index:
            done.append(box.write(folder))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["package", "records"])

    return cut(records.mapInArrow(run, "package string, records long"), "packages")


def directory(f, size: int) -> dict[str, tuple[int, int]]:
    """member -> (offset of its data, length) of the stored members of an open ZIP or ZIP64 file."""
    tail_at = max(0, size - 22 - 65535 - 20)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    n, _, at = struct.unpack("<HII", tail[end + 10 : end + 20])
    length = struct.unpack("<I", tail[end + 12 : end + 16])[0]
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (end64,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        f.seek(end64)
        head = f.read(56)
        if head[:4] != b"PK\x06\x06":
            raise ValueError("bad ZIP64 end record")
        n, length, at = struct.unpack("<QQQ", head[32:56])
    f.seek(at)
    central, k, out = f.read(length), 0, {}
    for _ in range(n):
        if central[k : k + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        method, = struct.unpack("<H", central[k + 10 : k + 12])
        packed, plain, names, extras, notes = struct.unpack("<IIHHH", central[k + 20 : k + 34])
        (local,) = struct.unpack("<I", central[k + 42 : k + 46])
        name = central[k + 46 : k + 46 + names].decode()
        extra = central[k + 46 + names : k + 46 + names + extras]
        while len(extra) >= 4:  # the ZIP64 field holds, in order, only what didn't fit
            tag, m = struct.unpack("<HH", extra[:4])
            if tag == 1:
                wide = list(struct.unpack(f"<{m // 8}Q", extra[4 : 4 + m // 8 * 8]))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + m :]
        k += 46 + names + extras + notes
        if method == 0:
            f.seek(local)
            head = f.read(30)
            a, b = struct.unpack("<HH", head[26:30])
            out[name] = (local + 30 + a + b, plain)
    return out


def index_lines(raw: bytes) -> list[tuple[str, int, int]]:
    """(file, offset, length) of each line of an index: CDXJ, or CDX by its header's letters."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    out, places = [], None
    for line in raw.decode("utf-8", "replace").splitlines():
        if line.lstrip().startswith("CDX "):
            letters = line.split()[1:]
            places = [letters.index(x) for x in "gVS"] if {"g", "V", "S"} <= set(letters) else None
        elif "{" in line:
            fields = json.loads(line[line.index("{") :])
            if {"filename", "offset", "length"} <= fields.keys():
                out.append((str(fields["filename"]), int(fields["offset"]), int(fields["length"])))
        elif places and len(parts := line.split()) > max(places):
            out.append((parts[places[0]], int(parts[places[1]]), int(parts[places[2]])))
    return out


def ranges(packages: DataFrame, most: int = RANGE_BYTES) -> DataFrame:
    """package, at, length, lengths: runs of adjacent records, from the packages' own indexes; lengths is empty where there is none."""

    def run(batches):
        for b in batches:
            for name in b.column("package").to_pylist():
                store, path = _store(name)
                with store.open_input_file(path) as f:
                    members = directory(f, f.size())
                    archives = {m.removeprefix("archive/"): x for m, x in members.items() if m.startswith("archive/") and not m.endswith("/")}
                    lines = set()
                    for m in sorted(m for m in members if m.startswith("indexes/")):
                        f.seek(members[m][0])
                        lines.update((file.removeprefix("archive/"), at, n) for file, at, n in index_lines(f.read(members[m][1])))
                known = {file for file, _, _ in lines}
                out: list[tuple[int, list[int]]] = []
                for at, n in sorted((archives[file][0] + at, n) for file, at, n in lines if file in archives):
                    if not out or out[-1][0] + sum(out[-1][1]) != at or sum(out[-1][1]) + n > most or len(out[-1][1]) >= 500:
                        out.append((at, []))
                    out[-1][1].append(n)
                whole = [(at, n, []) for file, (at, n) in archives.items() if file not in known]
                out = [(at, sum(ns), ns) for at, ns in out] + whole
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.string()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["package", "at", "length", "lengths"])

    return packages.select("package").mapInArrow(run, "package string, at long, length long, lengths array<long>")


def split_records(raw: bytes):
    """The records of a WARC file, gzipped one by one or plain."""
    while raw:
        if raw[:2] == b"\x1f\x8b":
            unpack = zlib.decompressobj(31)
            yield unpack.decompress(raw) + unpack.flush()
            raw = unpack.unused_data
        else:
            head, _, rest = raw.partition(b"\r\n\r\n")
            n = int(_fields(head).get("content-length", 0))
            yield head + b"\r\n\r\n" + rest[:n]
            raw = rest[n:].lstrip(b"\r\n")


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by their names in lower case."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def parse(raw: bytes) -> dict:
    """Fields of one record: page_id, record_id, url, record_type, refers_to, payload_digest (hex), payload_bytes, payload (of responses only)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    kind, block = fields.get("warc-type"), rest[: int(fields.get("content-length", len(rest)))]
    page = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    out = {"page_id": page(fields.get("warc-record-id")), "record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": page(fields.get("warc-refers-to")), "payload_digest": None, "payload_bytes": None, "payload": None}
    if kind not in ("response", "revisit"):
        return out
    http, _, payload = block.partition(b"\r\n\r\n")
    said, digest = _fields(http).get("content-length"), fields.get("warc-payload-digest", "")
    if digest.lower().startswith("sha1:"):
        text = digest[5:]
        out["payload_digest"] = text.lower() if len(text) == 40 else base64.b32decode(text.upper()).hex()
    if kind == "revisit":
        return out | {"payload_bytes": int(said) if said else None}
    real = hashlib.sha1(payload).hexdigest()
    if out["payload_digest"] not in (None, real) or said and int(said) != len(payload):
        raise ValueError(f"payload of {out['record_id']} doesn't match its digest or length")
    return out | {"payload_digest": real, "payload_bytes": len(payload), "payload": payload}


def read_records(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the packages (package): page_id, record_id, url, payload_bytes, payload_digest, record_type, refers_to(, payload)."""
    names = [("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads

    def run(batches):
        for b in batches:
            for name, at, length, lengths in zip(*[b.column(c).to_pylist() for c in ("package", "at", "length", "lengths")]):
                store, path = _store(name)
                with store.open_input_file(path) as f:
                    f.seek(at)
                    got = f.read(length)
                edges = np.cumsum([0, *lengths]).tolist()
                found = (r for a, z in zip(edges, edges[1:]) for r in split_records(got[a:z])) if lengths else split_records(got)
                while rows := [parse(r) for r in islice(found, 500)]:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in names], [c for c, _ in names])

    found = ranges(packages)
    tasks = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return found.repartition(tasks, "package", "at").mapInArrow(run, "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_packages(with_targets(table(spark, sf_dir, "pages").select("page_id", "url", "html")), new_path(spark, "warc"))
    return read_records(packages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d FROM p),
t AS (SELECT d, max(page_id) AS target FROM q WHERE n >= {LEAST_BYTES} GROUP BY d HAVING count(*) > 1)
SELECT page_id, n::BIGINT AS payload_bytes, q.d AS payload_digest,
  CASE WHEN target IS NOT NULL AND page_id IS DISTINCT FROM target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM target THEN target END AS refers_to
FROM q LEFT JOIN t USING (d)
"""
