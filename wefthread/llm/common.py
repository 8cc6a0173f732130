"""What the corpus operators share: cut lineage, distributed components, columns that can't clash."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder, as in tests on one machine.
LOCAL_FOLDER = "/tmp/checkpoints/wefthread"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; on one machine it may be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return LOCAL_FOLDER
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


#: What a query of ``cut`` runs with: it deletes its shuffle files when it is over, not when the driver happens to
#: collect its garbage; and few rows and bytes at a time go to Python, as texts and sets of words are long.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}
#: Of every open ``dropping``, the folders cut since.
_FOLDERS: list[list[str]] = []


@contextmanager
def sparing(spark: SparkSession) -> Iterator[None]:
    was = {key: spark.conf.get(key) for key in _SETTINGS}
    try:
        for key, value in _SETTINGS.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def dropping(spark: SparkSession) -> Iterator[None]:
    """At the end, what ``cut`` wrote within goes: for a result that is written by then."""
    folders: list[str] = []
    _FOLDERS.append(folders)
    try:
        yield
    finally:
        _FOLDERS[:] = [f for f in _FOLDERS if f is not folders]
        for path in folders:
            delete(spark, path)


def _release() -> None:
    """Give freed memory back to the system: a Python worker is kept for the tasks after, and what it holds adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run):
    """A function for mapInArrow that leaves no freed memory behind in its worker."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def rest(spark: SparkSession) -> None:
    """Executors collect their garbage and give its memory back: a heap once filled stays with its JVM, beside the Python workers of the step after.

    A task for each core that the session has; an executor that gets none keeps its heap as it is.
    """
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: no lineage, and safe from lost executors.

    Its shuffle files go at once, the files written at the end of ``dropping`` around it or else when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    if _FOLDERS:
        _FOLDERS[-1].append(path)
    with sparing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame from ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = file.rsplit("/", 1)[0]
        if path.rsplit("/", 1)[-1].startswith("cut-"):
            delete(spark, path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Alternating large-star and small-star steps, all joins and aggregates. The
    smallest neighbour comes from an aggregate with map-side combination and is
    joined back, so a node with very many edges is split like any skewed join
    key. Nodes may be of any ordered type. Null ends and loops are ignored.
    """

    def starred(e: DataFrame, large: bool) -> DataFrame:
        # e holds u > v. large: every neighbour above u goes to the least one of u's neighbourhood; small: those below.
        hood = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = hood.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = hood.join(least, "u")
        if large:
            moved = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = moved.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return moved.where(F.col("u") > F.col("v")).distinct()

    x, y = F.col(a), F.col(b)
    e = cut(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    sign = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = sign(e)
    while was[0]:
        after = cut(starred(starred(e, True), False))
        now = sign(after)
        drop_cut(e)
        e = after
        if now == was:
            break
        was = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def need(df: DataFrame, *columns: str) -> list[Column]:
    """The named columns; extra ones, even of clashing names, are left behind."""
    return [F.col(c) for c in columns if df.columns.count(c) == 1 or _clash(c)]


def _clash(name: str) -> bool:
    raise ValueError(f"column {name} is missing or there twice")


def words(text: Column) -> Column:
    """The words of a text: runs of characters other than 0x20 and 0x09-0x0D; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
