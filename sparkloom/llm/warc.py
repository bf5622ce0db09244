"""Deterministic sharded writer of web archives (WARC), and a reader.

A first pass over keys and digests alone finds the pages whose payload another
page holds already, and split keys for the shards: a sample by hash, so that the
same table always gives the same shards, however it is partitioned. Each page
then becomes a compressed response record, travels once to its shard, and meets
the mark that makes it a revisit there. Shards are written in order of (page
id, key), in files that roll at a compressed size.

Tasks write under temporary names with a random part. Spark's own commit of the
manifest decides which attempt of a task counts; the files it names get their
final names, by tasks that may be repeated, and a last marker closes the
folder. Files of lost attempts go with the temporary folder.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._base import keep, shared_dir
from sparkloom.shipping import ship

#: Compressed bytes at which a file is closed and the next one begun.
ROLL_BYTES = 256 << 20
#: Payload bytes of a shard while there are few shards, and from then on.
SHARD_BYTES, SHARD_LIMIT = 1 << 20, 1 << 30
FEW_SHARDS, MOST_SHARDS = 200, 20_000
#: Bytes of a task: payload that is written, archives that are read. Small shards and files share tasks.
TASK_BYTES = 8 << 20
#: Sampled keys for each shard, from which the split keys are taken.
SAMPLED = 10
#: Compressed bytes that are read at once.
CHUNK = 64 << 10
#: Payloads of fewer bytes are never revisited.
LEAST_REVISIT = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ROW = "shard int, page_id long, key string, kind int, url string, size long, digest string, member binary, first_id long, first_key string"
MANIFEST = "shard int, part int, file string, temporary string, bytes long, records long, sha256 string"
RECORD = "page_id long, url string, record_type string, record_id string, payload_bytes long, payload_digest string, refers_to long"


def _base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(text: str) -> str:
    """One line of printable ASCII: other bytes are percent-encoded."""
    return "".join(chr(b) if 0x21 <= b <= 0x7E else f"%{b:02X}" for b in text.encode())


def _record_id(page_id: int | None, key: str, occurrence: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{key}|{occurrence}')}>"


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, without a time in its header."""
    lines = [*fields, ("WARC-Block-Digest", "sha1:" + _base32(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in lines) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _named(kind: str, page_id: int | None, url: str | None, record_id: str) -> list[tuple[str, str]]:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    return fields


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def response(page_id: int | None, url: str | None, key: str, payload: bytes, digest: str, occurrence: int = 0) -> bytes:
    fields = _named("response", page_id, url, _record_id(page_id, key, occurrence))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    return _member(fields, _http(len(payload)) + payload)


def revisit(page_id: int | None, url: str | None, key: str, size: int, digest: str, first_id: int, first_key: str, occurrence: int = 0) -> bytes:
    """The HTTP headers alone; their length is the payload's, which the response that is referred to holds."""
    fields = _named("revisit", page_id, url, _record_id(page_id, key, occurrence))
    fields += [
        ("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(first_id, first_key, 0)), ("X-Refers-To-Page-Id", str(first_id)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    return _member(fields, _http(size))


def _file_info(name: str) -> bytes:
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, name, 0)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def members(stream) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time, their checksums tested."""
    rest = b""
    while rest or (rest := stream.read(CHUNK)):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest and not (rest := stream.read(CHUNK)):
                raise ValueError("a record is cut off")
            parts.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
        yield b"".join(parts)


def record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record that a member holds."""
    head, gap, body = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1" or not gap:
        raise ValueError(f"no record where one should start: {member[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if body[size:] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    block = body[:size]
    if fields["WARC-Block-Digest"] != "sha1:" + _base32(block):
        raise ValueError(f"block digest differs in {fields['WARC-Record-ID']}")
    return fields, block


def _located(spark: SparkSession, folder: str) -> str:
    """The folder as a URI that tells its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _shards_for(size: int) -> int:
    return min(MOST_SHARDS, max(1, min(FEW_SHARDS, math.ceil(size / SHARD_BYTES)), math.ceil(size / SHARD_LIMIT)))


def _placed(splits: list[tuple[int, str]], make: bool):
    """Rows of ``_ROW`` from pages (their response made) or from marks."""
    least = -(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("page_id", pa.int64()), ("key", pa.string()), ("kind", pa.int32()), ("url", pa.string()), ("size", pa.int64()), ("digest", pa.string()), ("member", pa.binary()), ("first_id", pa.int64()), ("first_key", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(at, 256).to_pylist():
                    pid, key = r["page_id"], r["key"]
                    row = {"shard": bisect_right(splits, (least if pid is None else pid, key)), "page_id": pid, "key": key, "kind": int(make)}
                    if make:
                        digest = _base32(r["payload"])
                        row |= {"url": r["url"], "size": len(r["payload"]), "digest": digest, "member": response(pid, r["url"], key, r["payload"], digest)}
                    else:
                        row |= {"first_id": r["first_id"], "first_key": r["first_key"]}
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


class _Roll:
    """The file of a shard that is being written."""

    def __init__(self, root: str, shard: int, part: int) -> None:
        self.shard, self.part = shard, part
        self.name = f"part-{shard:06d}-{part:05d}.warc.gz"
        self.temporary = f"_temporary/{uuid.uuid4().hex}-{self.name}"
        store, path = fs.FileSystem.from_uri(root)
        store.create_dir(f"{path}/_temporary", recursive=True)
        self.out, self.hash, self.bytes, self.records = store.open_output_stream(f"{path}/{self.temporary}", compression=None), hashlib.sha256(), 0, -1
        self.add(_file_info(self.name))

    def add(self, member: bytes) -> None:
        self.out.write(member)
        self.hash.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        return {"shard": self.shard, "part": self.part, "file": self.name, "temporary": self.temporary, "bytes": self.bytes, "records": self.records, "sha256": self.hash.hexdigest()}


def _writer(root: str, roll_bytes: int, least_revisit: int):
    """From rows sorted by (shard, page id, key, kind): the files, and a row of ``MANIFEST`` for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("temporary", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])
        roll: _Roll | None = None
        mark, last, occurrence = None, None, 0
        for batch in batches:
            done = []
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    own = (r["page_id"], r["key"])
                    if not r["kind"]:
                        mark = (own, r["first_id"], r["first_key"])
                        continue
                    occurrence = occurrence + 1 if own == last else 0
                    last = own
                    named = (own[0], r["url"], own[1])
                    if mark and mark[0] == own:
                        member = revisit(*named, r["size"], r["digest"], mark[1], mark[2], occurrence)
                    elif not occurrence:
                        member = r["member"]
                    elif own[0] is not None and r["size"] >= least_revisit:
                        member = revisit(*named, r["size"], r["digest"], *own, occurrence)
                    else:
                        block = record(zlib.decompress(r["member"], 31))[1]
                        member = response(*named, block[len(_http(r["size"])) :], r["digest"], occurrence)
                    if roll and (roll.shard != r["shard"] or roll.bytes >= roll_bytes):
                        done.append(roll.close())
                        roll = _Roll(root, r["shard"], roll.part + 1 if roll.shard == r["shard"] else 0)
                    roll = roll or _Roll(root, r["shard"], 0)
                    roll.add(member)
            yield pa.RecordBatch.from_pylist(done, schema)
        if roll:
            yield pa.RecordBatch.from_pylist([roll.close()], schema)

    return run


def _committer(root: str):
    """Gives the manifest's files their final names; a repeated task finds them there already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(root)
        for batch in batches:
            for r in batch.to_pylist():
                if store.get_file_info(f"{path}/{r['temporary']}").type == fs.FileType.File:
                    store.move(f"{path}/{r['temporary']}", f"{path}/{r['file']}")
                if store.get_file_info(f"{path}/{r['file']}").size != r["bytes"]:
                    raise OSError(f"{r['file']} is not as its manifest says")
            yield pa.RecordBatch.from_arrays([batch.column("file")], ["file"])

    return run


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", roll_bytes: int = ROLL_BYTES, least_revisit: int = LEAST_REVISIT, shards: int | None = None
) -> DataFrame:
    """Write a record per row to a new folder that driver and executors share; returns the committed manifest.

    Of rows with equal payloads (null: empty) of at least ``least_revisit``
    bytes the one with the smallest page id is a response and the others
    revisit it; among repeated rows of that id, the first by url and payload.
    Rows with a null id are never referred to; they come first. A null url has
    no target. Control characters, spaces and characters outside ASCII are
    percent-encoded in the target's header. Rows that agree in id, url and
    payload go to one file sequence, as a stream. An empty table has an empty
    manifest. Other columns are ignored.
    """
    spark = pages.sparkSession
    ship(spark)
    root = _located(spark, folder)
    store, path = fs.FileSystem.from_uri(root)
    if store.get_file_info(f"{path}/_COMMITTED").type != fs.FileType.NotFound:
        raise FileExistsError(folder)
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    read = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    sha = F.sha2("payload", 256)
    keyed = read.withColumn("key", F.sha2(F.concat(F.coalesce(F.concat(F.lit("u"), "url"), F.lit("")), F.lit("\n"), sha), 256))
    small = keep(keyed.select("page_id", "key", sha.alias("sha"), F.octet_length("payload").cast("long").alias("size")))
    size, count = small.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    shards = shards or _shards_for(size)
    # A row of at most SAMPLED * MOST_SHARDS keys; the bound does not follow the table.
    sample = small.where(F.pmod(F.xxhash64("key"), F.lit(max(1, count // (SAMPLED * shards)))) == 0) if shards > 1 else small.limit(0)
    ranked = sorted((r[0], r[1]) for r in sample.select(F.coalesce("page_id", F.lit(-(1 << 63))), "key").distinct().collect())
    splits = [ranked[len(ranked) * i // shards] for i in range(1, shards)] if len(ranked) >= shards else ranked[: shards - 1]
    # Apart from the join, so that the copies of a payload can be split over tasks.
    first = keep(
        small.where(F.col("size") >= least_revisit).groupBy("sha")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "key"))).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL").select("sha", F.col("first.page_id").alias("first_id"), F.col("first.key").alias("first_key"))
    )
    marks = small.join(first, "sha").where("NOT (page_id <=> first_id AND key = first_key)").select("page_id", "key", "first_id", "first_key")
    rows = keyed.mapInArrow(_placed(splits, True), _ROW).unionAll(marks.mapInArrow(_placed(splits, False), _ROW))
    # Shards of few bytes are written by one task, one after the other.
    tasks = max(1, min(shards, math.ceil(size / TASK_BYTES)))
    dealt = rows.repartitionById(tasks, (F.col("shard") * tasks / shards).cast("int")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "key", "kind")
    dealt.mapInArrow(_writer(root, roll_bytes, least_revisit), MANIFEST).write.parquet(f"{root}/_manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")
    _spread(manifest, max(roll_bytes, TASK_BYTES)).mapInArrow(_committer(root), "file string").write.format("noop").mode("overwrite").save()
    if store.get_file_info(f"{path}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{path}/_temporary")
    with store.open_output_stream(f"{path}/_COMMITTED") as out:
        out.write(b"")
    return manifest


def _spread(manifest: DataFrame, task_bytes: int) -> DataFrame:
    """The files in tasks of about ``task_bytes``."""
    size, files = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(1, min(MOST_SHARDS, files, math.ceil(size / task_bytes)))
    return manifest.repartition(tasks, "file")


def _reader(root: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
        schema = pa.schema(kinds + ([("payload", pa.binary())] if payloads else []))
        store, path = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for fields, block in map(record, members(stream)):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (len(payload) != size or _base32(payload) != digest):
                            raise ValueError(f"payload differs in {fields['WARC-Record-ID']}")
                        number = lambda name, fields=fields: int(fields[name]) if name in fields else None
                        row = {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "record_id": fields["WARC-Record-ID"], "payload_bytes": size, "payload_digest": digest, "refers_to": number("X-Refers-To-Page-Id")}
                        if payloads:
                            row["payload"] = payload if fields["WARC-Type"] == "response" else None
                            held += len(payload)
                        rows.append(row)
                        if len(rows) >= 4096 or held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of a committed folder, digests checked; ``payload`` is null for revisits.

    Raises where the folder was not committed or a record is not as its digests say.
    """
    ship(spark)
    root = _located(spark, folder)
    store, path = fs.FileSystem.from_uri(root)
    if store.get_file_info(f"{path}/_COMMITTED").type != fs.FileType.File:
        raise FileNotFoundError(f"{folder} was not committed")
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")
    return _spread(manifest, TASK_BYTES).select("file").mapInArrow(_reader(root, payloads), RECORD + (", payload binary" if payloads else ""))


def archive_report(pages: DataFrame) -> DataFrame:
    """Write all pages, and per page what the archives say: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same in DuckDB's SQL; base 32 is five bits to a character.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, from_hex(sha1(html))::BIT::VARCHAR AS bits, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
