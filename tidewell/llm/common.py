"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import is_remote

#: A word is a maximal run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent (tests, notebooks in local mode) is a temporary folder
    used instead; on any other master its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/tidewell-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a
    lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing will read them again, and let the
    shuffle files of the jobs before go."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._table_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    free_shuffles(frames[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Let shuffle files of finished jobs go now and not at the next collection of the driver's heap.
    Only disk space depends on it; a session without a JVM at hand skips it."""
    if not is_remote():
        spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that a finished task's worker no longer uses back to the system, as far as that can be
    done: idle workers stay beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or the first of ``name_1``, ``name_2``, ... that no column bears (case aside)."""
    low, n, out = {c.lower() for c in taken}, 0, name
    while out.lower() in low:
        n += 1
        out = f"{name}_{n}"
    return out


def words_of(text: Column) -> Column:
    """The words of a text; null and blank texts give an empty array.

    Blanks become spaces first, as splitting at one plain character needs no pattern matching."""
    t = F.coalesce(text, F.lit(""))
    for blank in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(blank), F.lit(" "))
    return F.filter(F.split(t, " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, as bigint; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(WORD)).cast("bigint")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
