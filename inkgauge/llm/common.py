"""What the operators of this subpackage share: reading, staging and word rules."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of anything but these six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_made: dict[str, str] = {}


#: Rows of texts that go to a Python worker at once, unless the session sets its own number.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_MANY = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def small_batches(spark: SparkSession) -> None:
    """Whole texts are large rows: Spark's 10,000 in an Arrow batch would fill a worker's memory.

    Staged tables are often small: partitions are put together by size, not spread over all cores, so that
    no small table is many files.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if spark.conf.get(_MANY) == "true":
        spark.conf.set(_MANY, "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode (tests) where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = "file://" + tempfile.mkdtemp(prefix="inkgauge-")
    return _made[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts lineage so that an executor lost later costs a re-read, not a recomputation.
    The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/inkgauge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


#: What a Python worker keeps from one task to the next, by name; Spark uses a worker again for later stages.
_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """The worker's one large state: what make() gives, kept until a task asks for another or forgets it."""
    if name not in _kept:
        forget()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    if _kept:
        _kept.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Freed pages that Arrow's and C's allocators hold go back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator], keep: bool = False) -> Callable[[Iterator], Iterator]:
    """run over a task's batches, without what the worker kept (unless keep); freed pages go back at its end."""

    def task(batches: Iterator) -> Iterator:
        if not keep:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def text_of(column: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have, one for each stem."""
    taken = {c.lower() for c in df.columns}
    found = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
