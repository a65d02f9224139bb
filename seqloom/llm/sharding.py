"""Contiguous shards of near-equal bytes from global prefix sums; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import ref, stage


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row, shards being runs of ascending doc_id.

    Rows are range-partitioned and sorted once, without their texts; each partition's
    total gives its offset, a running sum inside the partition the rest. The shard is
    where a row's first byte falls among equal targets, so a shard's size misses the
    target by one row at most at either end. slot counts a shard's rows from 0.
    size is the text's UTF-8 bytes plus 1.

    Null text: size 1, crc32 of nothing. Null ids come first. Ties and repeated rows
    are ordered by their place in the input, so one hot id spreads over partitions.
    An empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(ref(text_col), F.lit(""))
    slim = docs.select(ref(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("place"))
    laid = stage(slim.repartitionByRange("doc_id", "place").withColumn("part", F.spark_partition_id()), "shard-sizes")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))  # a row for each partition
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"), F.sum("bytes").over(Window.partitionBy()).alias("total"))

    inside = Window.partitionBy("part").orderBy("doc_id", "place")
    placed = laid.withColumn("first", F.sum("size").over(inside) - F.col("size")).withColumn("nth", F.row_number().over(inside) - 1)
    placed = placed.join(F.broadcast(totals), "part")
    placed = placed.select("doc_id", "size", "text_crc32", F.expr(f"cast((byte0 + first) * {shards} div total as int)").alias("shard"), (F.col("row0") + F.col("nth")).alias("rank"))
    starts = placed.groupBy("shard").agg(F.min("rank").alias("start"))  # a row for each shard
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("start")).alias("slot"))
