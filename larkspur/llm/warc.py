"""WARC archives: monolithic gzip in, one gzip member per record and a sidecar offset index out.

A writer makes archives of one gzip stream each, as naive tools do. The normaliser inflates such a
stream once, from front to back, cuts it into records, and writes every record as a gzip member of
its own; the sidecar index says where each member lies. A reader then needs only the index and a
seek. All files are written under a temporary name and moved into place, so a task that runs again
replaces its file or leaves another that no manifest names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bounded_batches, filter_bit, has_bit, key_filter, load, scratch, stored

#: A writer starts the next archive beyond so many inflated bytes.
ARCHIVE_BYTES = 64 << 20
CHUNK, LEVEL = 1 << 20, 3
EPOCH = "2020-01-01T00:00:00Z"
VERSION = b"WARC/1.1\r\n"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_id(page_id) -> str:
    return "<urn:page:" + ("none" if page_id is None else str(page_id)) + ">"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record. A revisit has no body of its own; its headers keep the payload's digest and length."""
    body = b"" if revisit else payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", EPOCH),
        ("WARC-Target-URI", "".join((url or "").split()) or "urn:none"),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    head.append(("Content-Length", str(len(body))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    return {k.decode().lower(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines[1:]) if k}


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """A gzip stream of one member or of many, inflated in bounded pieces. A truncated one is an error."""
    z, fed = zlib.decompressobj(31), False
    for data in chunks:
        while data:
            out = z.decompress(data, CHUNK)
            fed = True
            if out:
                yield out
            if z.eof:
                data, z, fed = z.unused_data, zlib.decompressobj(31), False
            else:
                data = z.unconsumed_tail
    if fed and not z.eof:
        while rest := z.decompress(z.unconsumed_tail, CHUNK):
            yield rest
        raise ValueError("the gzip stream ends early")


def split_records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each WARC record; holds one record at a time."""
    buf, done = bytearray(), False

    def more() -> bool:
        for piece in stream:
            buf.extend(piece)
            return True
        return False

    while True:
        while (cut := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                if bytes(buf).strip():
                    raise ValueError("a record's head ends early")
                return
        head = parse_head(bytes(buf[:cut]))
        end = cut + 4 + int(head["content-length"]) + 4
        while len(buf) < end:
            if not more():
                raise ValueError("a record's body ends early")
        yield head, bytes(buf[:end])
        del buf[:end]


def _read_chunks(f) -> Iterator[bytes]:
    while data := f.read(CHUNK):
        yield data


class _Stream:
    """A gzip file under a temporary name; ``close`` moves it into place."""

    def __init__(self, folder: str, suffix: str):
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.fs, at = _open(folder)
        self.fs.create_dir(at, recursive=True)
        self.path, self.temp = f"{at}/{self.name}", f"{at}/.{self.name}.tmp"
        self.file, self.size = self.fs.open_output_stream(self.temp, compression=None), 0

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.temp, self.path)


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def mark_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """Columns ``revisit`` and ``refers_to``: of equal payloads of at least ``least`` bytes the largest
    page_id is the response. Payloads count as equal if SHA-256 and length are.

    Rows that repeat the largest page_id are all responses; a null page_id is a revisit of any that
    isn't null. Digests are summed before they are shuffled. Only pages whose digest may be repeated are
    joined, by a bitmap of the repeated ones; other payloads stay where they were read. AQE splits the join
    where many pages share a digest.
    """
    bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("key"))
    keyed = keyed.withColumn("_hash", F.xxhash64("key"))
    repeated = keyed.groupBy("key", "_hash").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = stored(repeated.select(F.col("key").alias("_key"), "_hash", "top"), "repeated")
    bitmap = key_filter(repeated, "_hash")
    shared = pages.sparkSession.sparkContext.broadcast(bitmap)  # 16 MB at most

    @F.pandas_udf("boolean")
    def may_repeat(bit: pd.Series) -> pd.Series:
        return pd.Series(has_bit(shared.value, bit.to_numpy()))

    keyed = keyed.withColumn("_may", may_repeat(filter_bit(64 * len(bitmap), "_hash")))
    names = ["page_id", "url", "payload"]
    alone = keyed.where(~F.col("_may")).select(*names, F.lit(False).alias("revisit"), F.lit(None).cast(dict(pages.dtypes)["page_id"]).alias("refers_to"))
    joined = keyed.where("_may").join(repeated.drop("_hash"), F.col("key") == F.col("_key"), "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")) & (F.octet_length("payload") >= least)
    return alone.union(joined.select(*names, revisit.alias("revisit"), F.when(revisit, F.col("top")).alias("refers_to")))


def write_monolithic(marked: DataFrame, folder: str) -> DataFrame:
    """Write each task's records as whole-file gzip streams; the manifest of (path, records)."""
    bounded_batches(marked.sparkSession)

    def run(batches):
        out, z, n, size = None, None, 0, 0
        for batch in batches:
            for page_id, url, payload, revisit, refers_to in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "revisit", "refers_to")]):
                if out is None:
                    out, z, n, size = _Stream(folder, ".warc.gz"), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                record = build_record(page_id, url, payload.encode(), refers_to, revisit)
                out.write(z.compress(record))
                n, size = n + 1, size + len(record)
                if size >= ARCHIVE_BYTES:
                    out.write(z.flush())
                    out.close()
                    yield pa.RecordBatch.from_pydict({"name": [out.name], "records": [n]})
                    out = None
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [out.name], "records": [n]})

    return marked.select("page_id", "url", "payload", "revisit", "refers_to").mapInArrow(run, "name string, records long")


def normalise(manifest: DataFrame, source: str, target: str) -> DataFrame:
    """One member per record and a sidecar ``.idx`` of JSON lines (offset, length, id, type) per archive.

    Archives that no manifest row names, such as leftovers of a failed task, aren't read.
    """

    def run(batches):
        for batch in batches:
            for name in batch.column("name").to_pylist():
                at_fs, at = _open(f"{source}/{name}")
                out, index, n = _Stream(target, ".warc.gz"), [], 0
                side = _Stream(target, ".idx")
                with at_fs.open_input_stream(at, compression=None) as f:
                    for head, record in split_records(inflate(_read_chunks(f))):
                        member = _gzip(record)
                        line = json.dumps({"offset": out.size, "length": len(member), "id": head["warc-record-id"], "type": head["warc-type"]})
                        side.write(line.encode() + b"\n")
                        out.write(member)
                        n += 1
                out.close()
                side.close()
                yield pa.RecordBatch.from_pydict({"name": [out.name], "sidecar": [side.name], "records": [n]})

    return manifest.mapInArrow(run, "name string, sidecar string, records long")


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, member_offset long, member_length long"


def read_indexed(normal: DataFrame, folder: str) -> DataFrame:
    """Each record through the sidecar: seek, inflate one member, check length and digest."""
    number = lambda urn: None if urn in (None, "<urn:page:none>") else int(urn[len("<urn:page:") : -1])

    def flush(rows):
        cols = list(zip(*rows))
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "member_offset", "member_length"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    def run(batches):
        for batch in batches:
            for name, sidecar in zip(batch.column("name").to_pylist(), batch.column("sidecar").to_pylist()):
                at_fs, at = _open(f"{folder}/{name}")
                _, side = _open(f"{folder}/{sidecar}")
                rows = []
                with at_fs.open_input_stream(side, compression=None) as index, at_fs.open_input_file(at) as f:
                    rest = b""
                    for data in _read_chunks(index):
                        *lines, rest = (rest + data).split(b"\n")
                        for line in map(json.loads, lines):
                            f.seek(line["offset"])
                            record = zlib.decompress(f.read(line["length"]), 31)
                            cut = record.index(b"\r\n\r\n")
                            head, body = parse_head(record[:cut]), record[cut + 4 : -4]
                            if len(body) != int(head["content-length"]):
                                raise ValueError(f"{name}: wrong length at {line['offset']}")
                            kind, sum_ = head["warc-type"], head["warc-payload-digest"].partition(":")[2]
                            size = int(head["warc-payload-length"])
                            if kind == "response":
                                size, own = len(body), digest(body)
                                if own != sum_:
                                    raise ValueError(f"{name}: wrong digest at {line['offset']}")
                            rows.append((number(head["warc-record-id"]), head["warc-target-uri"], size, sum_, kind, number(head.get("warc-refers-to")), line["offset"], line["length"]))
                            if len(rows) >= 4096:
                                yield flush(rows)
                                rows = []
                if rows:
                    yield flush(rows)

    return normal.mapInArrow(run, READ_SCHEMA)


def _spread(manifest: DataFrame) -> DataFrame:
    """Deal archives out to tasks: one each, or up to eight where there are many."""
    n, lanes = manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.repartition(max(1, min(n, max(lanes, n // 8))))


def archive(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write, normalise and read back ``pages``; archives stay in ``folder``.

    A null html is an empty payload, which counts as any other; a null url becomes ``urn:none``.
    """
    marked = mark_revisits(pages, least)
    mono = stored(write_monolithic(marked, f"{folder}/monolithic"), "manifest")
    spread = _spread(mono)
    normal = stored(normalise(spread, f"{folder}/monolithic", f"{folder}/normal"), "index")
    return read_indexed(_spread(normal), f"{folder}/normal")


def op5_warc_normaliser(spark, sf_dir: str) -> DataFrame:
    out = archive(load(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def sql() -> str:
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    value = "CAST('0x' || substr(h, g * 5 + 1, 5) AS INTEGER)"
    char = f"substr('{digits}', (({value} >> (15 - 5 * j)) & 31) + 1, 1)"
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT *, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
          array_to_string(flatten(list_transform(range(8), lambda g: list_transform(range(4), lambda j: {char}))), '') AS payload_digest,
          CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM q"""
