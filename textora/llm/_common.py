"""Helpers shared by the training-data operators: shared storage, saved tables, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What separates words everywhere: space and the controls U+0009 to U+000D.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"
#: Bytes up to which a table is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local session (tests)
    gets a folder of its own, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textora-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/textora-{tag}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Deletes the files of a table from save() that nothing reads any more, and has Spark delete those of the shuffles behind it.

    Spark deletes the files of a shuffle once the driver's collector finds it unused, which can take longer than the job.
    """
    spark = df.sparkSession
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, a saved table, with a broadcast hint if its values take at most so many bytes; else df, to be shuffled.

    Strings, binaries and arrays of fixed-width values count by their lengths, other values as 8 bytes.
    """
    parts = {"string": F.octet_length, "binary": F.octet_length}
    sizes = [parts[k](F.col(f"`{c}`")) if k in parts else F.size(F.col(f"`{c}`")) * 8 * (k.count(",") + 1) if k.startswith("array") else None for c, k in df.dtypes]
    long = [F.coalesce(x, F.lit(0)) for x in sizes if x is not None]
    if not long:  # as many bytes in each row: a count, of which the driver keeps one plan
        return F.broadcast(df) if df.count() * (16 + 8 * len(sizes)) <= most else df
    total = reduce(add, long, F.lit(16 + 8 * (len(sizes) - len(long))))
    return F.broadcast(df) if (df.agg(F.sum(total.cast("long"))).first()[0] or 0) <= most else df


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"_{name}{i}" for i in range(len(taken) + 1)) if n not in taken)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
