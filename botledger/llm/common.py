"""Shared pieces of the training-data operators: scratch tables, words, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every contract of this package (Java and RE2 syntax alike).
SPACE_CLASS = r"\x20\x09-\x0D"

_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application that driver and executors share: under spark.checkpoint.dir, or a temporary one in local mode.

    On a cluster the setting is required: a machine-local folder would lose data. The folder goes when the driver ends.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _SCRATCH:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared:
            _SCRATCH[app] = f"{shared.rstrip('/')}/botledger/{app}"
            path, files = _hadoop(spark, _SCRATCH[app])
            files.mkdirs(path)
            files.deleteOnExit(path)
        elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            folder = tempfile.mkdtemp(prefix="botledger-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _SCRATCH[app] = "file://" + folder
    return _SCRATCH[app]


def _hadoop(spark: SparkSession, name: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables now, once the results that read them have been used."""
    path, files = _hadoop(spark, scratch_dir(spark))
    files.delete(path, True)


#: Paths staged in the scopes that are open, innermost last.
_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def scratch_scope():
    """Tables staged inside are dropped at its end, but for those handed to the function it yields; their readers must be done by then."""
    paths: list[str] = []
    kept: set[str] = set()
    _SCOPES.append(paths)
    try:
        yield lambda df: kept.update(_bare(f.rsplit("/", 1)[0]) for f in df.inputFiles())
    finally:
        _SCOPES.pop()
        spark = SparkSession.getActiveSession()
        for p in paths:
            if _bare(p) not in kept and spark is not None:
                path, files = _hadoop(spark, p)
                files.delete(path, True)


def table_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage_out(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends, a lost executor costs nothing."""
    path = table_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a stage_out() table whose rows nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if _bare(scratch_dir(spark)) in _bare(name):
            path, files = _hadoop(spark, name)
            files.delete(path, True)


def _bare(name: str) -> str:
    """A path without scheme and leading slashes."""
    return name.split(":", 1)[-1].lstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = "_" + name
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def lean(run):
    """A batch function that hands its worker's free memory back to the system once it has run.

    Workers stay for the next stage, so what one left unused in its heap would count beside what that stage needs.
    """
    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def words(text: Column) -> Column:
    """The words of a text, in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+", -1), "")


def connected_components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges(a, b)`` (longs, a != b); root is the least node it reaches.

    Alternating large-star and small-star passes: each pass joins the edge list with one
    minimum per node, so only (node, neighbour) rows move, never a node's whole list, and
    a hub is a skewed join that adaptive execution splits. Rounds grow with log(size).
    Ends when a round leaves the edge set as it was; at the end every edge points to its root.
    """
    cur = stage_out(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{label}-cc"
    )
    mark = _fingerprint(cur)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(low2, "u")
        small = kept.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            low2.select("u", F.col("m").alias("v"))
        )
        nxt = stage_out(small.distinct(), f"{label}-cc")
        new_mark = _fingerprint(nxt)
        drop_table(cur)
        cur = nxt
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"components of {label} did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return int(row["n"]), row["h"]
