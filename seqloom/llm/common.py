"""What the corpus operators share: the cluster's shared folder, row packing, star-contraction components."""

from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset a local one in local mode (tests), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "seqloom-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/seqloom-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows in a written file, about, where a bound on their number is known: of numbers, and of texts.
FILE_ROWS, FILE_TEXTS = 1 << 14, 1 << 11


def few(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """df in no more partitions than so many rows need and than keep all cores busy. rows: a bound on what it has, and on what its last step reads.

    Spark merges small partitions only where adaptive coalescing is on. Without Hadoop's native library a file on a
    local path costs two child processes (chmod of it and of its checksums); until it runs its own program, such a
    child shares all of the executor's memory, and a watcher that adds up processes counts that twice.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, 1 + rows // each))


#: Text that a worker encodes at once, longer rows aside.
BATCH_BYTES = 16 << 20


def by_bytes(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text each, or a single row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def take_lists(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists at index, one after another, and their offsets; lists lie in flat between offsets."""
    sizes = offsets[index + 1] - offsets[index]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return flat[np.arange(ends[-1]) + np.repeat(offsets[index] - ends[:-1], sizes)], ends


def kept_in_worker(key, make):
    """make(), once for each key in a Python worker: what it gives stays for the worker's later tasks."""
    store = sys.modules.setdefault("_seqloom_kept", types.ModuleType("_seqloom_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def ref(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(name: str) -> Column:
    return F.coalesce(ref(name), F.lit(""))


#: Edges in a written part of a round, about.
EDGES = 1 << 16


def components(edges: DataFrame, max_rounds: int = 64, nodes: int | None = None) -> DataFrame:
    """Connected components of (u, v) long edges by alternating large-star and small-star steps.

    Returns (node, root) for every node of an edge, root being the smallest node of
    its component. Each round shuffles the edges only and is written to the shared
    folder; hot nodes are pre-aggregated by min() and joined, never gathered.
    No edges: an empty result. Null nodes are dropped. nodes: how many there are at most, if known.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = stage(e if nodes is None else few(e, nodes), "edges")
    parts = max(1, e.count() // EDGES)  # a round has no more edges than the one before
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = stage(small.coalesce(parts), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
