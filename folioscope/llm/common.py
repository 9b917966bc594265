"""What the operators of this package share: table access, scratch space, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where one machine runs all and names no folder, as in tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints/folioscope"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def table(df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut, lost executors cost nothing."""
    path = scratch(df.sparkSession, label)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Collects the driver's garbage and gives its freed memory back.

    Spark deletes shuffle files and broadcasts when the driver's JVM finds that nothing refers to them, which with a large
    heap may take half an hour; until then the files of every step stay on the executors' disks.
    """
    gc.collect()
    jvm = spark._jvm
    jvm.System.gc()
    with contextlib.suppress(Py4JError):  # where this JVM has no such command
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(name, "systemTrimNativeHeap", None, None)


def delete(spark: SparkSession, df: DataFrame) -> None:
    """Removes the files of a table made by ``table`` that no later step reads."""
    jvm = spark._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


Batches = Iterator[pa.RecordBatch]
#: What tasks of this process keep for later ones of the same operator.
_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """A dict that lasts from task to task of this process, until one of another operator begins."""
    return _kept.setdefault(owner, {})


def trim() -> None:
    """Gives what was freed back to the system, by Arrow's pool too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def begin(owner: str | None) -> None:
    """Lets go what operators other than ``owner`` keep in this process."""
    others = [k for k, v in _kept.items() if v and k != owner]
    for k in others:
        _kept[k].clear()
    if others:
        trim()


def light(run: Callable[[Batches], Batches], owner: str | None = None) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``, with memory for the tasks that share a worker: what other operators than ``owner``
    keep goes before it, and what it freed goes back to the system after it."""

    def wrapped(batches: Batches) -> Batches:
        begin(owner)
        yield from run(batches)
        trim()

    return wrapped


def unused(df: DataFrame, n: int) -> list[str]:
    """Names for ``n`` helper columns that ``df`` hasn't."""
    taken = {c.lower() for c in df.columns}
    return list(itertools.islice((x for x in (f"_helper_{i}" for i in itertools.count()) if x not in taken), n))


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, a table of narrow rows, with the hint to broadcast it if a count finds at most ``rows``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crc_fold(column: str = "doc_id") -> F.Column:
    """crc32(doc_id as text) mod 5; rows of remainder 0 are held out from every training. Null ids count as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as (id, component): component is the least id.

    Alternates the large-star and small-star steps, each an aggregate and a join, until no edge
    changes. Stars of any size are spread over tasks: the least neighbour comes from a partial
    aggregate and is joined back, never from a collected neighbour list. Empty edges give no rows.
    """
    spark = edges.sparkSession
    now = table(_directed(edges), f"{label}-cc")
    mark = _mark(now)
    while True:
        # large star: every greater neighbour of u moves to the least of u's neighbourhood
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the lesser neighbours of u and u itself move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new = table(small.union(least.select("a", F.col("m").alias("b"))).distinct(), f"{label}-cc")
        delete(spark, now)
        now, was, mark = new, mark, _mark(new)
        if mark == was:
            break
    # a fixed point of both steps is a set of stars: every id points at its component's least id
    ids = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _directed(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Tells two edge sets apart without fetching them: their count and two order-free hash sums."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.sum(F.xxhash64(h, F.lit(1)).cast("decimal(20,0)"))).first())
