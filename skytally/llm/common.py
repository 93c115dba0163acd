"""Shared helpers: the shared work folder, written intermediate tables, seeded hashing and small numeric tools."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Space, tab, line feed, vertical tab, form feed, carriage return: what separates words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is made and set, in local mode alone; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="skytally-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/skytally/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote; nothing that is still to run may read them."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(wanted: str, *taken: DataFrame) -> str:
    """``wanted``, or with underscores after it a name that no column of ``taken`` has in any case."""
    have = {c.lower() for df in taken for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows and about so many bytes, so that the Python objects of one slice alone are alive."""
    for batch in batches:
        if batch.num_rows <= rows and batch.nbytes <= size:
            yield batch
            continue
        texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type)]
        ends = np.cumsum(sum((np.asarray(pc.fill_null(pc.binary_length(c), 0), np.int64) for c in texts), np.zeros(batch.num_rows, np.int64)))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            n = max(1, min(rows, upto - at))
            yield batch.slice(at, n)
            at += n


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: list[StructField]) -> DataFrame:
    """``df.mapInArrow`` for any column names: ``work`` goes by position."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    made = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, made.names)

    return plain.mapInArrow(renamed, made).toDF(*(f.name for f in fields))


def give_back() -> None:
    """At a task's end: return freed memory to the system, since Python workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps what it has
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall in fold crc32('') = 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def blank_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, *, folds: int, held: int, rows: dict[int, int], max_chars: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """At most ``rows[v]`` documents (text, label) of each label ``v``, chosen by a hash of the id, for fitting on the driver.

    Ids in fold ``held``, null ids and labels, and texts over ``max_chars`` characters are left out; of several labels of one id
    the largest counts. The chosen ids are as few as ``rows`` says, so they are broadcast, and no text is shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col(label_col).alias("label")).where("i IS NOT NULL AND label IS NOT NULL")
    known = known.where(fold_of(F.col("i"), folds) != held).groupBy("i").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("text")).where(F.length("text") <= max_chars)
    parts = []
    for value, n in rows.items():
        ids = known.where(F.col("label") == value).orderBy(F.xxhash64("i")).limit(n)
        found = texts.join(F.broadcast(ids), "i")
        parts.append(found.orderBy(F.xxhash64("i"), "text").limit(n).select("text", F.col("label").cast("int").alias("label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
