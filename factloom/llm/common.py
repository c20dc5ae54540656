"""Shared helpers: table reading, lineage cuts in the shared folder, hash columns."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where a session of one machine (tests) names none, a temporary one that ends with the
    process; on a cluster that is an error, for executors do not see each other's folders."""
    global _own_dir
    if named := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-factloom-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


#: Spark's own switch: the shuffle files of a statement go when it ends, since nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there, lost executors cost no recomputation
    beyond their running tasks, and the shuffle files behind it are freed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def values(column: pa.Array) -> Iterator:
    """The Python values of a column one by one, so that a batch of texts is not held twice."""
    return (v.as_py() for v in column)


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts whose strings in the column have about so many bytes together (one row at least)."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if b.num_rows else np.zeros(0, int)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield b.slice(lo, hi - lo)


#: Into how many tasks the rows of one key are dealt by dealt_lookup().
SALTS = 64


def dealt_lookup(rows: DataFrame, table: DataFrame, key: str, by: list[str]) -> DataFrame:
    """rows joined with table on key, where one key may be that of a third of all rows: these are dealt to SALTS tasks by a hash of the columns by, and table
    meets one row for each key and task. rows is read twice."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)))
    some = salted.select(key, "__salt").distinct().join(table, key)
    return salted.join(some, [key, "__salt"]).drop("__salt")


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % mod


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_hash() -> Column:
    """th: with the id it names a row's text where ids repeat."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")


def rows_named(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, th) is in named."""
    right = named.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    return docs.join(right, docs["doc_id"].eqNullSafe(right["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == right["__th"]), "left_semi")


def carried(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with all its columns under names that clash with none, beside text; and those names."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    return docs.select(*(docs[c].alias(n) for c, n in zip(docs.columns, names)), docs["text"]), names
