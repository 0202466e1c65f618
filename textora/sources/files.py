"""Folders of files as tables, items of loaders as documents, and reports and texts as files.

Reading and writing are Spark's: binaryFile for folders, JSON lines a table for reports. Only decoding a mail is Python,
an Arrow function of batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metadata keys that name an item's document, in order of precedence, and those that give its page.
DOCUMENT_KEYS = ("source", "file_path", "filename", "file_name")
PAGE_KEYS = ("page", "page_number", "page_label")
TEXT_FORMATS = ("txt", "md", "csv", "log", "rst")


def directory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, format, bytes, modified, content) of the files of a folder and its subfolders whose names fit the glob."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("format"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")


def texts(files: DataFrame, formats: tuple[str, ...] = TEXT_FORMATS) -> DataFrame:
    """(path, name, format, text) of files of text; bytes that are not UTF-8 become replacement characters, line ends \\n."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"\r\n?", "\n")
    return files.where(F.col("format").isin(*formats)).select("path", "name", "format", text.alias("text"))


def mails(files: DataFrame) -> DataFrame:
    """(path, name, subject, sender, text, attachments) of e-mail files; a message that cannot be read has a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from email import message_from_bytes, policy

        for b in batches:
            rows = []
            for content in b.column("content").to_pylist():
                m = message_from_bytes(content or b"", policy=policy.default)
                try:
                    body = m.get_body(("plain", "html"))
                    rows.append((m["subject"], m["from"], body.get_content() if body else "", sum(1 for _ in m.iter_attachments())))
                except (LookupError, ValueError, KeyError):
                    rows.append((m["subject"], m["from"], None, 0))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("name"), *(pa.array([None if v is None else str(v) for v in c], pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int64())], names=["path", "name", "subject", "sender", "text", "attachments"])

    return files.where("format = 'eml'").select("path", "name", "content").mapInArrow(decode, "path string, name string, subject string, sender string, text string, attachments long")


def first_of(metadata: Column, keys: tuple[str, ...]) -> Column:
    """The first of these keys that a map has a value for."""
    return F.coalesce(*[F.nullif(F.element_at(metadata, k), F.lit("")) for k in keys])


def as_documents(items: DataFrame, n: str = "n") -> DataFrame:
    """(document, pages, text) of loader items (n, metadata, text): items of one document in order of page, then of n.

    Items whose metadata name no document are one document without a name.
    """
    page = first_of(F.col("metadata"), PAGE_KEYS).try_cast("long")
    each = items.select(first_of(F.col("metadata"), DOCUMENT_KEYS).alias("document"), F.struct(page.alias("page"), F.col(n).alias("n"), F.coalesce("text", F.lit("")).alias("text")).alias("i"))
    return each.groupBy("document").agg(F.count("*").alias("pages"), F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda x: x["text"]), "\n").alias("text"))


def metadata_values(items: DataFrame, key: str = "doc_id", least: int = 4) -> DataFrame:
    """(key, name, value): each metadata value of `least` letters or digits once a document, to be scanned like text."""
    each = items.select(key, F.explode("metadata").alias("name", "value")).distinct()
    return each.where(F.length(F.regexp_replace("value", r"[^\p{L}\p{N}]", "")) >= least)


def added_keys(before: DataFrame, after: DataFrame, key: str = "item") -> DataFrame:
    """(key, added): metadata keys that an item has after a stage and had not before, sorted."""
    both = after.select(key, F.map_keys("metadata").alias("a")).join(before.select(key, F.map_keys("metadata").alias("b")), key)
    return both.select(key, F.array_sort(F.array_except("a", "b")).alias("added")).where(F.size("added") > 0)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a report as JSON lines in a folder of its name; null fields are kept."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def write_diff(diff: DataFrame, path: str) -> None:
    """What differs between two reports (area, document, subject, change, ...) as JSON lines: changes, and counts by area and change."""
    write_report({"changes": diff, "counts": diff.groupBy("area", "change").agg(F.count("*").alias("n"))}, path)


def read_report(spark: SparkSession, path: str, schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables of a report, by the names of its folders; a table without a schema has the one its rows show."""
    found = schemas or dict.fromkeys(_folders(spark, path))
    return {name: (spark.read.schema(schema) if schema else spark.read).json(f"{path}/{name}") for name, schema in found.items()}


def _folders(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def write_texts(rows: DataFrame, path: str) -> None:
    """A file of text for each row (path, text), under the same relative path; written by the tasks, through pyarrow.

    A file is written under a name of its own and then moved, so a task that runs twice leaves one whole file.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, base = pafs.FileSystem.from_uri(path)
        for b in batches:
            for name, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                parts = [x for x in name.split("/") if x not in ("", ".", "..")]
                folder = "/".join([base, *parts[:-1]])
                fs.create_dir(folder, recursive=True)
                temp = f"{folder}/.{parts[-1]}.{uuid.uuid4().hex}"
                with fs.open_output_stream(temp) as out:
                    out.write((text or "").encode())
                fs.move(temp, f"{folder}/{parts[-1]}")
            yield pa.RecordBatch.from_arrays([b.column("path")], names=["path"])

    rows.select("path", "text").mapInArrow(put, "path string").write.format("noop").mode("overwrite").save()


def routing_manifest(routed: DataFrame, key: str = "doc_id", page: str = "page") -> DataFrame:
    """(key, pages): each document with its pages in order, as structs of page, route and reason; JSON is df.write.json."""
    return routed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), "route", "reason"))).alias("pages"))


def changed_since(files: DataFrame, seen: DataFrame) -> DataFrame:
    """The files whose content differs from what was read before under their path, with its digest; seen: path, digest."""
    return files.withColumn("digest", F.sha2("content", 256)).join(seen.select("path", "digest"), ["path", "digest"], "left_anti")


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with the columns of labels, null where a document has none; of several rows of labels for a key the least counts."""
    more = [c for c in labels.columns if c != key]
    one = labels.groupBy(key).agg(F.min(F.struct(*more)).alias("l")).select(key, *(F.col(f"l.{c}").alias(c) for c in more))
    return docs.join(one, key, "left")
