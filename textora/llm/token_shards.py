"""Token-id shards with a minimal perfect hash index from document keys to places in them.

Documents stand in one order, by id and text digest. A shard begins at every so many text bytes of that order; one task
encodes a shard and writes two files: `.bin`, the ids of all its documents and nothing else, and `.rec`, the place of each
document in it. The id after each document's last is the end id. A Parquet manifest, which Spark commits, lists the
shards and gives each its first record and first id in the whole corpus. The index then takes the distinct document ids,
dealt by hash into parts, and writes a minimal perfect hash a part (key_index.py): a key's slot, found in constant time,
holds a fingerprint and the first record of that id. A record's place in its `.rec` and `.bin` follows by arithmetic, so
a document is read without a search or a scan. Files are written under names of their task attempt and moved when whole,
and count only once a manifest lists them: tasks of lost executors leave nothing that is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textora.llm import tokens
from textora.llm._common import save
from textora.llm.key_index import KeyIndex
from textora.llm.warc import NO_ID, _bounds, _shard

#: Text bytes of a shard (one task's work), and keys of an index part.
SHARD_BYTES, PART_KEYS = 32 << 20, 1 << 18
#: Keys of a part below which no further part is made for the sake of more tasks.
LEAST_KEYS = 1 << 12
RECORD = np.dtype([("id", "<i8"), ("null", "u1"), ("end", "<u8")])
SHARDS = "shard int, records long, ids long, width int"
FOUND = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _store(uri: str, name: str, data: list[bytes]) -> None:
    """Writes a file under a name of its own, then moves it to its final name."""
    fs, base = pafs.FileSystem.from_uri(uri)
    fs.create_dir(f"{base}/_temporary", recursive=True)
    with fs.open_output_stream(temp := f"{base}/_temporary/{name}.{uuid.uuid4().hex}") as out:
        for part in data:
            out.write(part)
    fs.move(temp, f"{base}/{name}")


def _clean(uri: str) -> None:
    fs, base = pafs.FileSystem.from_uri(uri)
    if fs.get_file_info(f"{base}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{base}/_temporary")  # what lost tasks left


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the ids of all texts under uri, in ascending order of ids (null first), and returns the manifest.

    Null text counts as empty: the end id alone. Texts of rows that repeat an id follow each other by digest, rows that
    repeat both id and text stay in one shard. Long texts are encoded in parts and are never cut. No rows give an empty
    manifest. Other columns are not looked at. tokenizer: the path of its file, on every executor.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("*", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("payload"))
    bounds = _bounds(rows.select("id", "payload", (F.octet_length("text") + 16).alias("n_bytes")), shard_bytes)
    placed = rows.select("doc_id", "id", "payload", "text", (_shard(bounds)("id", "payload") if bounds else F.lit(0)).alias("shard"))
    dealt = placed.repartitionById(max(len(bounds), 1), F.col("shard")).sortWithinPartitions("shard", "id", F.col("doc_id").asc_nulls_first(), "payload", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, made = tokens.encoder(tokenizer), []
        end, kind = struct.pack("<H" if encode.width == 2 else "<I", end_id), pa.schema([("shard", pa.int32()), ("records", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())])
        out = None

        def close() -> None:
            stream.close()
            fs.move(temp, f"{base}/{name}.bin")
            records = np.zeros(len(ends), RECORD)
            records["id"], records["null"], records["end"] = [i or 0 for i in ids], [i is None for i in ids], ends
            _store(uri, f"{name}.rec", [records.tobytes()])
            made.append({"shard": out, "records": len(ends), "ids": ends[-1], "width": encode.width})

        for batch in batches:
            bodies = (x.as_py() for x in batch.column("text"))
            for shard, doc_id, encoded in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), encode.encode_all(bodies), strict=True):
                if shard != out:
                    if out is not None:
                        close()
                    out, name, ends, ids, at = shard, f"shard-{shard:06d}", [], [], 0
                    fs, base = pafs.FileSystem.from_uri(uri)
                    fs.create_dir(f"{base}/_temporary", recursive=True)
                    stream = fs.open_output_stream(temp := f"{base}/_temporary/{name}.bin.{uuid.uuid4().hex}")
                stream.write(encoded)
                stream.write(end)
                at += len(encoded) // encode.width + 1
                ids.append(doc_id)
                ends.append(at)
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(made, kind)

    written = save(dealt.select("shard", "doc_id", "text").mapInArrow(write, SHARDS), "token-shards")
    listed = sorted(written.collect())  # a row a shard
    before = np.cumsum([[0, 0], *([r.records, r.ids] for r in listed)], axis=0).tolist()
    table = spark.createDataFrame([(*r, *b) for r, b in zip(listed, before, strict=False)], f"{SHARDS}, first_record long, first_id long")
    table.coalesce(1).write.parquet(f"{uri}/manifest")
    _clean(uri)
    return spark.read.parquet(f"{uri}/manifest")


class Shards:
    """What the manifest says, as arrays, for tasks: 40 bytes a shard."""

    def __init__(self, manifest: DataFrame, uri: str) -> None:
        rows = sorted(manifest.select("first_record", "first_id", "shard", "records", "ids", "width").collect())
        self.uri, self.width = uri, rows[0].width if rows else 4
        self.first, self.base, self.shard = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.total = (rows[-1].first_record + rows[-1].records) if rows else 0

    @cached_property
    def place(self) -> tuple:
        return pafs.FileSystem.from_uri(self.uri)

    def of(self, record: np.ndarray) -> np.ndarray:
        """Which entry of the manifest holds each record."""
        return np.searchsorted(self.first, record, side="right") - 1

    def held(self, k: int) -> int:
        """How many records the k-th shard holds."""
        return int((self.first[k + 1] if k + 1 < len(self.first) else self.total) - self.first[k])

    def records(self, k: int, first: int, n: int) -> tuple[np.ndarray, int]:
        """(n records of the k-th shard from its first-th on, the id place at which they begin in it)."""
        fs, base = self.place
        with fs.open_input_file(f"{base}/shard-{self.shard[k]:06d}.rec") as f:
            lead = 1 if first else 0
            f.seek((first - lead) * RECORD.itemsize)
            held = np.frombuffer(f.read((n + lead) * RECORD.itemsize), RECORD)
        return held[lead:], int(held["end"][0]) if lead else 0

    def payload(self, k: int):
        fs, base = self.place
        return fs.open_input_file(f"{base}/shard-{self.shard[k]:06d}.bin")


def records_of(spark: SparkSession, uri: str) -> DataFrame:
    """(id, record): the document id (null as NO_ID) of every record, by its number in the whole corpus."""
    manifest = spark.read.parquet(f"{uri}/manifest")
    held = Shards(manifest, uri)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in zip(batch.column("first_record").to_pylist(), batch.column("records").to_pylist(), strict=True):
                k = int(held.of(np.array([first]))[0])
                for at in range(0, n, 1 << 16):
                    rows, _ = held.records(k, at, min(1 << 16, n - at))
                    ids = np.where(rows["null"] == 1, NO_ID, rows["id"])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.arange(first + at, first + at + len(rows)))], ["id", "record"])

    spread = max(1, min(len(held.first), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("first_record", "records").repartition(spread).mapInArrow(read, "id long, record long")


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 20), F.lit(parts)).cast("int")


def build_index(spark: SparkSession, uri: str, part_keys: int = PART_KEYS) -> DataFrame:
    """Writes the index of the distinct ids and returns its manifest (part, keys, parts). No records give no part.

    A part holds about part_keys keys; few keys are dealt to more parts, so that all tasks have work. An id of many
    records is one key: records of an id follow each other, so a slot holds the first and their number.
    """
    spans = records_of(spark, uri).groupBy("id").agg(F.min("record").alias("first"), F.count("*").alias("rows"))
    spans = save(spans.select(F.xxhash64("id").alias("key"), "first", "rows"), "token-keys")
    n = spans.count()
    parts = max(1, -(-n // part_keys), min(n // LEAST_KEYS, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def build(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        column = lambda c: table.column(c).to_numpy()
        made = KeyIndex.build(column("key").view(np.uint64), column("first"), column("rows"))
        _store(uri, f"index-{part:06d}.mph", [made.to_bytes()])
        return pa.table({"part": pa.array([part], pa.int32()), "keys": pa.array([len(made.slots)], pa.int64()), "parts": pa.array([parts], pa.int32())})

    dealt = spans.withColumn("part", _part(F.col("key"), parts)).groupBy("part")
    dealt.applyInArrow(build, "part int, keys long, parts int").write.parquet(f"{uri}/index")
    _clean(uri)
    return spark.read.parquet(f"{uri}/index")


def _load(fs, base: str, part: int) -> KeyIndex:
    with fs.open_input_stream(f"{base}/index-{part:06d}.mph", compression=None) as f:
        return KeyIndex.from_bytes(f.read())


def find(keys: DataFrame, uri: str, id_col: str = "doc_id", cut: Callable | None = None, schema: str = "id long, first long, rows long") -> DataFrame:
    """(id, first, rows) of every distinct key that the index holds, null a key like others (id is then NO_ID).

    A key that was never written passes for another one once in 2^32; fetch() compares the stored id. cut: what the task
    makes of the three arrays, columns by the schema.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    spark = keys.sparkSession
    have = {r.part for r in spark.read.parquet(f"{uri}/index").select("part").collect()}  # a row for so many keys
    parts = index_parts(spark, uri) or 1
    asked = keys.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id")).distinct()
    asked = asked.select("id", F.xxhash64("id").alias("key")).withColumn("part", _part(F.col("key"), parts))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(uri)
        now, index = None, None
        for batch in batches:
            part, ids, key = (batch.column(c).to_numpy() for c in ("part", "id", "key"))
            for p in np.unique(part):
                if p not in have:
                    continue
                if p != now:
                    now, index = p, _load(fs, base, p)
                mine = part == p
                held, slots = index.find(key[mine].view(np.uint64))
                out = ids[mine][held], slots["first"].astype(np.int64), slots["rows"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cut(*out) if cut else out)], names)

    dealt = asked.repartition(max(1, min(parts, 10 * int(spark.conf.get("spark.sql.shuffle.partitions")))), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(look, schema)


def fetch(keys: DataFrame, uri: str, id_col: str = "doc_id", ids: bool = False) -> DataFrame:
    """Every record of the keys: doc_id, start (ids of all records before it), n_tokens, ids_crc32, and the ids if asked for.

    Keys are looked up in the index, each id's records are split at shard ends, and a task reads the places of its shards
    in order. Keys that were never written give no row, null ids those of rows without an id, repeated keys nothing more.
    """
    spark = keys.sparkSession
    held = Shards(spark.read.parquet(f"{uri}/manifest"), uri)

    def cut(ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple:
        """Records first to first + rows of each id, cut where a shard ends: (id, shard entry, first record, records)."""
        low, high = held.of(first), held.of(first + rows - 1)
        n = high - low + 1
        of = np.repeat(np.arange(len(ids)), n)
        k = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        start, end = np.maximum(first[of], held.first[k]), np.minimum((first + rows)[of], np.append(held.first, held.total)[k + 1])
        return ids[of], k, start, end - start

    pieces = find(keys, uri, id_col, cut, "id long, k long, first long, n long")
    spread = max(1, min(len(held.first), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    pieces = pieces.repartition(spread, "k").sortWithinPartitions("k", "first")
    schema = f"{FOUND}, ids array<long>" if ids else FOUND

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.list_(pa.int64()) if c == "ids" else pa.int64()) for i, c in enumerate(names)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stream, rows, size = None, None, [], 0
        for batch in batches:
            for key, k, first, n in zip(*(batch.column(c).to_pylist() for c in ("id", "k", "first", "n")), strict=True):
                if k != now:
                    now, stream = k, held.payload(k)
                    records, _ = held.records(k, 0, held.held(k))
                for r in range(first - int(held.first[k]), first - int(held.first[k]) + n):
                    doc_id = None if records["null"][r] else int(records["id"][r])
                    if (NO_ID if doc_id is None else doc_id) != key:
                        continue  # a key that was never written
                    begin, end = int(records["end"][r - 1]) if r else 0, int(records["end"][r])
                    stream.seek(begin * held.width)
                    got = np.frombuffer(stream.read((end - begin) * held.width), f"<u{held.width}")
                    rows.append((doc_id, int(held.base[k]) + begin, end - begin, zlib.crc32(got.astype("<u4").tobytes()), got.astype(np.int64) if ids else None))
                    size += len(got) if ids else 1
                    if size >= 1 << 20 or len(rows) >= 10_000:
                        yield flush(rows)
                        rows, size = [], 0
        yield flush(rows)

    return pieces.mapInArrow(read, schema)


def index_parts(spark: SparkSession, uri: str) -> int:
    """How many parts the index was made for; 0 without one."""
    found = spark.read.parquet(f"{uri}/index").agg(F.max("parts")).first()
    return found[0] or 0


class TokenReader:
    """Keyed access from one process: a document's ids in a fixed number of small reads."""

    def __init__(self, spark: SparkSession, uri: str) -> None:
        self.shards = Shards(spark.read.parquet(f"{uri}/manifest"), uri)
        self.parts = index_parts(spark, uri)
        self.index: dict[int, KeyIndex] = {}

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each record of doc_id, without a search; none if it was never written."""
        import xxhash

        key = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42)
        part = (key >> 20) % self.parts if self.parts else 0
        if not self.parts or part not in self.index and not self._opened(part):
            return []
        held, slots = self.index[part].find(np.array([key], np.uint64))
        out = []
        for record in range(int(slots["first"][0]), int(slots["first"][0] + slots["rows"][0])) if held[0] else ():
            k = int(self.shards.of(np.array([record]))[0])
            rows, begin = self.shards.records(k, record - int(self.shards.first[k]), 1)
            if rows["null"][0] or rows["id"][0] != doc_id:
                return []
            with self.shards.payload(k) as f:
                f.seek(begin * self.shards.width)
                out.append(np.frombuffer(f.read((int(rows["end"][0]) - begin) * self.shards.width), f"<u{self.shards.width}"))
        return out

    def _opened(self, part: int) -> bool:
        fs, base = self.shards.place
        if fs.get_file_info(f"{base}/index-{part:06d}.mph").type == pafs.FileType.NotFound:
            return False
        self.index[part] = _load(fs, base, part)
        return True
