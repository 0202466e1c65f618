"""Deterministic sharded WARC writer, and the reader of what it wrote.

Records stand in one order, by page id and payload digest, and a shard begins at every so many payload bytes of it: sums
of the ranges before and a running sum within each range give every record's place, so that reruns make the same files
whatever the number of tasks. What the driver holds is the first key of each shard. Shards are dealt out in ranges.
Within a shard files roll once their compressed size reaches a limit. Every record is a gzip member of its own; headers
and digests are made anew from the payload. A file is written under a temporary name of its task attempt
and moved to its final name when whole; files count only once the manifest, a Parquet table that Spark commits, lists
them, so a lost executor's half-written files are never read. Paths may be in any store that pyarrow can write.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textora.llm._common import drop_saved, save, small

#: Payload bytes of a shard (one task's work), and compressed bytes at which a file is closed.
SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
#: Stands for a null id where records are ordered: such records come first.
NO_ID = -(1 << 63)
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard int, seq int, records long, bytes long, first_id long, last_id long"


def _record_id(page_id, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(page_id, url: str | None, body: bytes, kind: str, refers_to, refers_url: str | None) -> bytes:
    """One gzip member. The block of a revisit has the HTTP head alone, whose length header tells the payload's size."""
    digest = _base32(hashlib.sha1(body).digest())
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + (body if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id, url, digest)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}")]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", _uri(url)))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, refers_url, digest)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", str(refers_to))]
        head += [("WARC-Refers-To-Target-URI", _uri(refers_url))] if refers_url is not None else []
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip head without name and time
    return deflate.compress(raw) + deflate.flush()


class _Rolling:
    """The open file of a shard."""

    def __init__(self, uri: str, roll_bytes: int) -> None:
        self.fs, self.base = pafs.FileSystem.from_uri(uri)
        self.roll, self.mine, self.out, self.shard, self.seq = roll_bytes, uuid.uuid4().hex, None, None, 0

    def put(self, shard: int, page_id, record: bytes) -> Iterator[dict]:
        if self.out and (shard != self.shard or self.bytes >= self.roll):
            yield self.close()
        if shard != self.shard:
            self.shard, self.seq = shard, 0
        if not self.out:
            self.name = f"shard-{shard:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.base}/_temporary/{self.name}.{self.mine}"
            self.fs.create_dir(f"{self.base}/_temporary", recursive=True)
            self.out, self.bytes, self.records, self.first = self.fs.open_output_stream(self.temp), 0, 0, page_id
        self.out.write(record)
        self.bytes, self.records, self.last = self.bytes + len(record), self.records + 1, page_id

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.temp, f"{self.base}/{self.name}")
        self.out, seq = None, self.seq
        self.seq += 1
        return {"file": self.name, "shard": self.shard, "seq": seq, "records": self.records, "bytes": self.bytes, "first_id": self.first, "last_id": self.last}


def _bounds(keys: DataFrame, shard_bytes: int) -> list[tuple[int, int]]:
    """First key (id, payload) of every shard, in order, of keys (id, payload, n_bytes)."""
    ranges = save(keys.repartitionByRange("id", "payload").withColumn("range", F.spark_partition_id()), "warc-ranges")
    sums = sorted(ranges.groupBy("range").agg(F.sum("n_bytes").alias("n")).collect())  # a row a range
    before = np.cumsum([0, *(n for _, n in sums)]).tolist()
    if not sums:
        return []
    start = keys.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(sums, before, strict=False)], "range int, before long")
    running = F.sum("n_bytes").over(Window.partitionBy("range").orderBy("id", "payload").rowsBetween(Window.unboundedPreceding, -1))
    placed = ranges.withColumn("inside", F.coalesce(running, F.lit(0))).join(F.broadcast(start), "range")
    shards = placed.groupBy(F.floor((F.col("before") + F.col("inside")) / shard_bytes).alias("shard")).agg(F.min(F.struct("id", "payload")).alias("first"))
    return [(r["first"]["id"], r["first"]["payload"]) for r in shards.orderBy("shard").collect()]  # 16 bytes a shard


def _shard(bounds: list[tuple[int, int]]):
    """A UDF: the last shard whose first key is at or below a record's (id, payload)."""
    ids, payloads = (np.array(x, dtype=np.int64) for x in zip(*bounds, strict=True))

    @F.pandas_udf("int")
    def place(id_, payload):
        import pandas as pd

        own, key = id_.to_numpy(), payload.to_numpy()
        lo, hi = np.searchsorted(ids, own, side="left"), np.searchsorted(ids, own, side="right")
        at = hi - 1
        for i in np.unique(own[hi > lo]):  # ids at which shards begin: their records lie before, between or after by payload
            mine = own == i
            first, last = np.searchsorted(ids, i, side="left"), np.searchsorted(ids, i, side="right")
            at[mine] = first + np.searchsorted(payloads[first:last], key[mine], side="right") - 1
        return pd.Series(np.maximum(at, 0)).astype("int32")

    return place


def write_warc(pages: DataFrame, uri: str, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes a record per row of pages under uri and returns the manifest.

    Null html counts as empty. Of rows with equal payloads (equal length and SHA-256; SHA-1, which headers carry, can be
    made to collide) of at least `least` bytes the one with the greatest id is a response and the others revisit it; rows
    that tie on that id are all responses, as are rows of a group without ids. A null url or id gives a record without
    that header; null ids come first. Rows that repeat both id and payload stay in one shard. An empty table gives an
    empty manifest and no file. Other columns are not looked at. Rows that repeat id, payload and url make equal records.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("body"))
    keyed = rows.select("*", F.unhex(F.sha2("body", 256)).alias("digest"), F.octet_length("body").alias("n_bytes"))
    keyed = keyed.select("*", F.coalesce("page_id", F.lit(NO_ID)).alias("id"), F.xxhash64("digest").alias("payload"))
    narrow = save(keyed.select("page_id", "url", "digest", "n_bytes", "id", "payload"), "warc-narrow")
    repeats = narrow.where(F.col("n_bytes") >= least).groupBy("digest", "n_bytes").agg(F.count("*").alias("rows"), F.max(F.struct("page_id", "url")).alias("l"))
    repeats = small(save(repeats.where("rows > 1").select("digest", "n_bytes", F.col("l.page_id").alias("last"), F.col("l.url").alias("last_url")), "warc-repeats"))
    bounds = _bounds(narrow.select("id", "payload", "n_bytes"), shard_bytes)
    drop_saved(narrow)
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    kind = [F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("last")).alias("refers_to"), F.when(revisit, F.col("last_url")).alias("refers_url")]
    placed = keyed.join(repeats, ["digest", "n_bytes"], "left").select("page_id", "id", "payload", "url", "body", *kind)
    placed = placed.withColumn("shard", _shard(bounds)("id", "payload") if bounds else F.lit(0))
    sharded = placed.repartitionByRange(max(len(bounds), 1), "shard").sortWithinPartitions("shard", "id", "payload", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, roll = [], _Rolling(uri, roll_bytes)
        for batch in batches:
            for r in zip(*(batch.column(c) for c in ("shard", "page_id", "url", "body", "kind", "refers_to", "refers_url")), strict=True):
                shard, page_id, link, text, kind, refers_to, refers_url = (x.as_py() for x in r)
                files += roll.put(shard, page_id, _record(page_id, link, text.encode(), kind, refers_to, refers_url))
        if roll.out:
            files.append(roll.close())
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_pydict({n: pa.array([f[n] for f in files], pa.string() if n == "file" else pa.int32() if n in ("shard", "seq") else pa.int64()) for n in names})

    sharded.mapInArrow(write, MANIFEST).write.parquet(f"{uri}/manifest")
    fs, base = pafs.FileSystem.from_uri(uri)
    if fs.get_file_info(f"{base}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{base}/_temporary")  # what lost tasks left
    return pages.sparkSession.read.parquet(f"{uri}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an open compressed file, one at a time."""
    import gzip

    with gzip.GzipFile(fileobj=stream) as plain:
        while version := plain.readline():
            if version != b"WARC/1.1\r\n":
                raise ValueError(f"no WARC record begins with {version[:40]!r}")
            head = {}
            while (line := plain.readline()) != b"\r\n":
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[name] = value
            block = plain.read(int(head["Content-Length"]))
            if plain.read(4) != b"\r\n\r\n":
                raise ValueError("a record does not end with two line ends")
            yield head, block


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_warc(spark: SparkSession, uri: str, payload: bool = True) -> DataFrame:
    """A row per record of the files that the manifest lists; digests are checked against the blocks."""
    listed = spark.read.parquet(f"{uri}/manifest").select("file")
    schema = READ if payload else READ.rpartition(",")[0]
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(uri)
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        flush = lambda rows: pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names})
        rows, held = [], 0
        for name in (f for b in batches for f in b.column("file").to_pylist()):
            with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                for head, block in records(stream):
                    if f"sha1:{_base32(hashlib.sha1(block).digest())}" != head["WARC-Block-Digest"]:
                        raise ValueError(f"{name}: a block does not have its digest")
                    http, _, body = block.partition(b"\r\n\r\n")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and _base32(hashlib.sha1(body).digest()) != digest:
                        raise ValueError(f"{name}: a payload does not have its digest")
                    number = lambda k, head=head: int(head[k]) if k in head else None
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    rows.append({"page_id": number("X-Page-ID"), "url": head.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "payload": body if head["WARC-Type"] == "response" else None})
                    held += len(body) if payload else 0
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield flush(rows)
                        rows, held = [], 0
        yield flush(rows)

    spread = max(1, min(listed.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return listed.repartition(spread).mapInArrow(parse, schema)
