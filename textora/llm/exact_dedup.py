"""Exact dedup as a stateful stream: disk-backed keyed state without expiry.

The state, one entry per distinct normalised text, lives in RocksDB under the query's checkpoint in the shared folder. It
retains the digest (the key), the stable identifier of the row that stays (smallest id), a content locator (file and row
index of that row) and the number of rows seen. Later batches, and later runs on the same checkpoint, go on from it.
A hit is a row whose digest the state holds for another row; the text at the locator is read again and every hit's full
text is held against it, combined before any shuffle; rows whose texts differ in spite of equal digests are put apart. Only DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textora.llm._common import BLANK, BROADCAST_BYTES, new_path, save, small

#: Bytes of new files that one micro-batch takes at most.
BATCH_BYTES = 64 << 30
#: Native memory of all RocksDB instances of one executor, MB.
ROCKSDB_MB = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANK}]+", " ")


def _literal(path: str) -> str:
    """A glob that fits just this path: the file source takes single files only as globs."""
    head, _, last = path.rstrip("/").rpartition("/")
    return f"{head}/[{last[0]}]{last[1:]}"


def _rows(table: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc_id, digest and content locator of every row, and more columns; the text itself stays behind."""
    text = normalised(F.col(text_col))
    return table.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"), *more,
    )


def _keeper() -> Column:
    """Order of rows of one text: smallest id first, null ids last, then by locator."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("at"))


def advance(spark: SparkSession, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> None:
    """Feeds all files of path that the checkpoint has not seen yet into the keyed state."""
    session = spark.newSession()
    for k, v in {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # each instance would reserve megabytes of disk for its logs
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(ROCKSDB_MB),
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }.items():
        session.conf.set(k, v)
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    stream = session.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(_literal(path))
    state = _rows(stream, id_col, text_col).groupBy("digest").agg(F.min(_keeper()).alias("keeper"), F.count("*").alias("n"))
    query = state.writeStream.format("noop").outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    query.awaitTermination()


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keyed state as a table: digest, keeper (struct), n."""
    state = spark.read.format("statestore").option("path", checkpoint).load()
    keeper, n = state.schema["value"].dataType.names
    return state.select("key.digest", F.col(f"value.{keeper}").alias("keeper"), F.col(f"value.{n}").alias("n"))


def _collisions(table: DataFrame, hits: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digests of hits (digest, located) whose full texts are not all the located one, combined before the shuffle."""
    full = _rows(table, id_col, text_col, normalised(F.col(text_col)).alias("full"))
    located = F.max(F.when(F.col("at") == F.col("located"), F.col("full"))).alias("text")
    same = full.join(hits, "digest").groupBy("digest").agg(F.min("full").alias("a"), F.max("full").alias("b"), located)
    return same.where("text is null or a <> text or b <> text").select("digest")


def dedup(spark: SparkSession, path: str, checkpoint: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of the Parquet table at path: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of blanks became one space; null counts as empty. Of equal texts the
    row with the smallest id stays; null ids come last; of repeated rows with one id exactly one stays, the first by file
    and row. An empty table gives no rows. Other columns are not looked at.
    """
    checkpoint = checkpoint or new_path(spark, "dedup")
    advance(spark, path, checkpoint, id_col, text_col)
    table = spark.read.parquet(path)
    state = save(held(spark, checkpoint), "dedup-state")
    hits = small(save(state.where("n > 1").select("digest", F.col("keeper.at").alias("located")), "dedup-hits"), 4 * BROADCAST_BYTES)
    apart = save(_collisions(table, hits, id_col, text_col), "dedup-apart")
    rows = _rows(table, id_col, text_col)
    out = rows.join(state, "digest").select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("keeper.at") == F.col("at")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
    if apart.limit(1).count() == 0:
        return out
    # Texts that share a digest: the same by full text, for these rows alone.
    odd = table.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("full"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))
    odd = save(odd.withColumn("digest", F.unhex(F.sha2("full", 256))).join(apart, "digest", "left_semi"), "dedup-odd")
    by_text = odd.groupBy("full").agg(F.min(_keeper()).alias("keeper"), F.count("*").alias("n"))
    again = odd.join(by_text, "full").select("doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("keeper.at") == F.col("at")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return out.join(apart.select(F.lower(F.hex("digest")).alias("text_sha256")), "text_sha256", "left_anti").select(again.columns).union(again)
