"""WARC archives as a Spark data source (``format("warc")``).

Writing: each task streams its rows into gzip-compressed WARC/1.1 files of the
shared folder, one gzip member a record. A member's extra field holds its
packed and plain length, so a reader can step over it. File names are new for
each attempt; the committing driver lists the files of the attempts that count
in an ``index-*.json`` of its own, so lost or repeated tasks leave no records
behind. Readers take the files of all indexes: mode ``append`` adds to an archive,
``overwrite`` replaces its earlier indexes and files.

Reading: partitions are runs of whole files, planned by size. A record's headers
are unpacked first; filters on record_type and on other header columns are
pushed down and decided there, and payloads are unpacked only for records that
pass, and not at all with option ``payload=false``. Option ``verify=true``
compares each unpacked payload with its digest.

A payload equal to that of a ``response`` may be stored as a ``revisit``, which
holds headers only and names the response it refers to. Which payloads repeat is
decided by digest: payloads that certainly occur once go straight to the writer,
and of the others only headers shuffle, and one payload for each digest.

Defined results: a null payload counts as empty; null ids, urls and references
are left out and read as null; an empty table writes an archive without files;
records of equal id, url and payload are written as they come, all but one as
revisits, and of ids that tie the first row is the response; very long payloads
are whole records, written and read one at a time; columns of the input other
than id, url and payload aren't read, so their names can't clash. A file that is
cut short or no gzip raises ``ValueError``; members of other writers (without
lengths, or records without our headers) are read by unpacking them, with what
they lack as null.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from tripweave.llm.common import Scratch, cut, ensure_shared_dir, file_system

SCHEMA = "page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string, payload binary"
HEADER_COLUMNS = ("page_id", "record_type", "refers_to", "target_uri", "payload_bytes", "payload_digest")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER_HEAD = struct.Struct("<BBBBIBBH2sHII")  # gzip header with one extra subfield "sl": packed and plain length
WRITE_ROWS = 64  # made Python objects at once
HEAD_BYTES = 2048  # unpacked at first to find the end of the headers


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, record_type: str, refers_to, uri, payload: bytes | None, size: int | None = None, sha1: str | None = None) -> bytes:
    """A WARC record as one gzip member. A revisit may come without its payload, with that payload's size and hexadecimal digest."""
    if payload is not None or sha1 is None:
        payload = payload or b""
        size, name = len(payload), digest(payload)
    else:
        name = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{name}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(uri)}")
    if record_type == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines += [f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    plain = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = pack.compress(plain) + pack.flush()
    head = MEMBER_HEAD.pack(0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, len(packed), len(plain) & 0xFFFFFFFF)
    return head + packed + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def parse_headers(plain: bytes) -> tuple[dict[str, str], int]:
    """(headers, where the block begins)."""
    end = plain.index(b"\r\n\r\n")
    lines = plain[:end].decode("utf-8", "surrogatepass").split("\r\n")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}, end + 4


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def header_row(h: dict[str, str]) -> dict:
    return {
        "page_id": _page(h.get("warc-record-id")),
        "record_type": h.get("warc-type"),
        "refers_to": _page(h.get("warc-refers-to")),
        "target_uri": h.get("warc-target-uri"),
        "payload_bytes": int(h["x-payload-length"]) if "x-payload-length" in h else None,
        "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
    }


def records(data, size: int, wanted=lambda row: True, payload: bool = True, verify: bool = False) -> Iterator[dict]:
    """Rows of one archive file; ``data`` is a seekable binary file."""
    at = 0
    while at < size:
        data.seek(at)
        first = data.read(MEMBER_HEAD.size + HEAD_BYTES)
        if first[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {at}")
        sized = first[3:4] == b"\x04" and first[12:14] == b"sl" and len(first) >= MEMBER_HEAD.size
        if sized:
            packed_size = MEMBER_HEAD.unpack(first[: MEMBER_HEAD.size])[10]
            if at + MEMBER_HEAD.size + packed_size + 8 > size:
                raise ValueError(f"the member at byte {at} is cut short")
            unpack, body = zlib.decompressobj(-15), first[MEMBER_HEAD.size : MEMBER_HEAD.size + packed_size]
        else:  # another writer's member: its end is known only once it is unpacked
            unpack, body, packed_size = zlib.decompressobj(31), first, None
        plain, rest = unpack.decompress(body, 65536), data
        while b"\r\n\r\n" not in plain:
            more = unpack.unconsumed_tail or (b"" if unpack.eof else rest.read(HEAD_BYTES))
            if not more:
                raise ValueError(f"the member at byte {at} ends within its headers")
            plain += unpack.decompress(more, 65536)
        h, begin = parse_headers(plain)
        row = header_row(h)
        row["payload"] = None
        take = wanted(row)
        if packed_size is not None and not (take and payload and row["record_type"] == "response"):
            at += MEMBER_HEAD.size + packed_size + 8
        else:
            parts = [plain]
            if packed_size is not None:
                data.seek(at + MEMBER_HEAD.size)
                parts = [zlib.decompress(data.read(packed_size), -15)]
                at += MEMBER_HEAD.size + packed_size + 8
            else:
                tail = unpack.unconsumed_tail
                while not unpack.eof:
                    tail = tail or data.read(1 << 16)
                    if not tail:
                        raise ValueError(f"the member at byte {at} is cut short")
                    parts.append(unpack.decompress(tail))
                    tail = unpack.unconsumed_tail
                at = data.tell() - len(unpack.unused_data)
            if payload and row["record_type"] == "response":
                block = b"".join(parts)[begin : begin + int(h["content-length"])]
                row["payload"] = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                if row["payload_bytes"] is None:
                    row["payload_bytes"] = len(row["payload"])
                if verify and (digest(row["payload"]) != row["payload_digest"] or len(row["payload"]) != row["payload_bytes"]):
                    raise ValueError(f"the payload of record {row['page_id']} doesn't match its digest")
        if take:
            yield row


def indexes(where: str) -> list[tuple[str, list[tuple[str, int]]]]:
    """(name, its (file, size)) of all indexes of an archive, in order of their names."""
    system, path = file_system(where)
    out = []
    for info in system.get_file_info(pafs.FileSelector(path, allow_not_found=False)):
        if re.fullmatch(r"index-.*\.json", info.base_name):
            with system.open_input_stream(info.path) as file:
                out.append((info.base_name, [tuple(x) for x in json.loads(file.read())]))
    return sorted(out)


@dataclass
class Files(InputPartition):
    names: list[tuple[str, int]]

    def __init__(self, names):
        super().__init__(None)
        self.names = names


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.options, self.tests = options["path"], dict(options), []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.tests.append((f.attribute[0], values))
            else:
                yield f

    def partitions(self):
        names = sorted(x for _, files in indexes(self.path) for x in files)
        most, runs, held = int(self.options.get("partitionbytes", 64 << 20)), [], 0
        for name, size in names:
            if not runs or held + size > most:
                runs.append([])
                held = 0
            runs[-1].append((name, size))
            held += size
        return [Files(x) for x in runs] or [Files([])]

    def read(self, partition: Files):
        system, path = file_system(self.path)
        payload, verify = self.options.get("payload", "true") == "true", self.options.get("verify", "false") == "true"
        wanted = lambda row: all(row[c] in values and row[c] is not None for c, values in self.tests)
        rows, held = [], 0
        kind = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for name, size in partition.names:
            with system.open_input_file(f"{path}/{name}") as file:
                for row in records(file, size, wanted, payload, verify):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 200
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.most, self.overwrite = options["path"], int(options.get("filebytes", 256 << 20)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        files, out, size, name = [], None, 0, ""
        try:
            for batch in iterator:
                for row in (x for k in range(0, batch.num_rows, WRITE_ROWS) for x in batch.slice(k, WRITE_ROWS).to_pylist()):
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    data = record(row["page_id"], row["record_type"], row["refers_to"], row["target_uri"], row["payload"], row["payload_bytes"], row["payload_digest"])
                    out.write(data)
                    size += len(data)
                    if size >= self.most:
                        out.close()
                        files.append((name, size))
                        out = None
        finally:
            if out is not None:
                out.close()
                files.append((name, size))
        return Written(files)

    def commit(self, messages):
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        old = indexes(self.path) if self.overwrite else []
        names = sorted(tuple(f) for m in messages if m is not None for f in m.files)
        with system.open_output_stream(f"{path}/index-{uuid.uuid4().hex}.json", compression=None) as file:
            file.write(json.dumps(names).encode())
        for name, files in old:
            for gone in [name, *[f for f, _ in files]]:
                system.delete_file(f"{path}/{gone}")

    def abort(self, messages):
        system, path = file_system(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                system.delete_file(f"{path}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def plan_records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Rows to write: of equal payloads of at least ``min_bytes`` the one of the largest id is the response.

    ``df`` must be a stored table, whose rows are numbered alike each time it is read. Payloads shuffle
    only where the row is the response of a digest that repeats (or passes for one in a Bloom filter).
    """
    # Not above: every worker that plans, reads or writes an archive loads this module.
    from tripweave.llm.exact_dedup import maybe_in, maybe_repeated

    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("target_uri"), payload.alias("payload"), F.monotonically_increasing_id().alias("_row"))
    slim = rows.select("page_id", "target_uri", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("_sha"), "_row").filter(F.col("payload_bytes") >= min_bytes)
    tables = Scratch(df.sparkSession)
    try:
        slim = tables.keep(slim.withColumn("_h", F.xxhash64("_sha")))
        maybe = maybe_repeated(slim, "_h", slim.count())
        suspect = tables.keep(slim.filter(maybe).drop("_h"))
        # struct order: null ids below all others, then the first row.
        first = F.max_by(F.struct("page_id", "_row"), F.struct(F.col("page_id").isNotNull(), F.col("page_id"), -F.col("_row")))
        groups = tables.keep(suspect.groupBy("_sha").agg(first.alias("_first")))
        known = suspect.join(groups, "_sha").withColumn("_again", F.col("_row") != F.col("_first._row"))
        revisits = known.filter("_again").select("page_id", F.lit("revisit").alias("record_type"), F.col("_first.page_id").alias("refers_to"), "target_uri", "payload_bytes", F.col("_sha").alias("payload_digest"), F.lit(None).cast("binary").alias("payload"))
        revisits, firsts = cut(revisits), cut(groups.select(F.col("_first._row").alias("_row")))
    finally:
        tables.close()
    once = rows.withColumn("_h", F.xxhash64(F.sha1("payload"))).filter((F.octet_length("payload") < min_bytes) | ~maybe).drop("_h")
    stay = once.unionByName(rows.filter(maybe_in(firsts, "_row")).join(firsts, "_row", "left_semi").select(*rows.columns))
    plain = stay.select(
        "page_id", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "target_uri",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.lit(None).cast("string").alias("payload_digest"), "payload",
    )
    return plain.unionByName(revisits)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(df: DataFrame, path: str, mode: str = "append", **how) -> None:
    """Write ``df`` as an archive under ``path``, a folder that all executors reach; ``mode`` is append or overwrite."""
    register(df.sparkSession)
    plan_records(df, **how).write.format("warc").mode(mode).save(path)


def read_archive(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def scratch_path(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{ensure_shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
