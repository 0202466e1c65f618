"""Audits of a folder that read only what has changed: versions of a manifest of digests, and outputs kept by content.

Each run lists the folder without reading it. Files that stand in the last version with the same size and time keep their
digest; the others are read. Work is done once for each content that no version has seen, and its rows are kept in the
outputs of this version; the new manifest, which Spark commits last, says for every file which version's outputs hold its
rows. A run that dies leaves the last version as it was. A run that changes nothing still makes a version.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textora.sources.decoding import read_text

MANIFEST = "path string, bytes long, modified timestamp, digest string, format string, skipped string, detail string, version int"
READ = "path string, bytes long, modified timestamp, digest string, format string, text string, skipped string, detail string"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, modified) of the files below a folder; nothing of them is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def contents(files: DataFrame) -> DataFrame:
    """The rows of listed() with SHA-256, text, and a reason where there is none; a file that is gone has a reason too."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            rows = []
            for path in b.column("path").to_pylist():
                try:
                    fs, at = pafs.FileSystem.from_uri(path)
                    with fs.open_input_stream(at, compression=None) as f:
                        raw = f.read()
                    rows.append({"digest": hashlib.sha256(raw).hexdigest()} | read_text(raw, path))
                except OSError as e:
                    rows.append({"digest": None, "format": None, "text": None, "skipped": "unreadable", "detail": str(e)[:200]})
            new = [pa.array([r[c] for r in rows], pa.string()) for c in ("digest", "format", "text", "skipped", "detail")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("path", "bytes", "modified")), *new], ["path", "bytes", "modified", "digest", "format", "text", "skipped", "detail"])

    return files.select("path", "bytes", "modified").mapInArrow(read, READ)


def versions(spark: SparkSession, store: str) -> list[int]:
    """The committed versions of a store, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/manifests")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    whole = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(s.getPath().getName().removeprefix("v")) for s in fs.listStatus(path) if s.isDirectory() and whole(s.getPath()))


def audit(spark: SparkSession, folder: str, store: str, work: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(manifest, results) of a folder: results are the rows of work for each file, with its path.

    work: from (digest, text), a row for each content, to rows with that digest. Files of equal content share their rows;
    files without text have none.
    """
    done = versions(spark, store)
    n = done[-1] + 1 if done else 1
    before = spark.read.parquet(f"{store}/manifests/v{done[-1]}") if done else spark.createDataFrame([], MANIFEST)
    now, same = listed(spark, folder), ["path", "bytes", "modified"]
    kept = now.join(before, same).select(before.columns)
    contents(now.join(before, same, "left_anti")).write.mode("overwrite").parquet(f"{store}/read/v{n}")
    read = spark.read.schema(READ).parquet(f"{store}/read/v{n}")
    known = before.where("version is not null").select("digest", "version").distinct()
    fresh = read.where("skipped is null").groupBy("digest").agg(F.min("text").alias("text")).join(known, "digest", "left_anti")
    work(fresh).write.mode("overwrite").parquet(f"{store}/outputs/v{n}")
    placed = read.drop("text").join(known, "digest", "left").withColumn("version", F.when(F.col("skipped").isNull(), F.coalesce("version", F.lit(n))))
    kept.unionByName(placed.select(before.columns)).write.mode("overwrite").parquet(f"{store}/manifests/v{n}")
    return latest(spark, store)


def latest(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, results) of the last committed version."""
    n = versions(spark, store)[-1]
    manifest = spark.read.parquet(f"{store}/manifests/v{n}")
    needed = sorted(r.version for r in manifest.select("version").where("version is not null").distinct().collect())  # a row a version
    outputs = None
    for v in needed or [n]:
        part = spark.read.parquet(f"{store}/outputs/v{v}").withColumn("version", F.lit(v))
        outputs = part if outputs is None else outputs.unionByName(part)
    return manifest, manifest.select("path", "digest", "version").join(outputs, ["digest", "version"]).drop("version")
