"""Sharding by rendezvous hashing: each record goes to the shard that scores highest for its key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citewright.llm.common import table, text_of, without

RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Buckets within a shard, by which slots are numbered in parallel.
BUCKETS = 512


def _unit(key: Column, salt: str) -> Column:
    """A number in (0, 1) from 52 bits of the key's MD5; the same everywhere."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{salt}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the greatest -weight / ln(u), u from key and shard; ties go to the lower shard.

    A shard's share is its weight's. A new shard takes records only into itself,
    and a shard that leaves gives up only its own: the other scores never change.
    """
    scores = [F.struct((F.lit(-float(w)) / F.log(_unit(key, str(i)))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return -(F.greatest(*scores)["shard"] if len(scores) > 1 else scores[0]["shard"])


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 8, grown: float | None = 1.0) -> DataFrame:
    """df with size, text_crc32, law, shard, slot and grown_shard.

    A null key counts as empty text, so all such rows share a shard; a null text has
    size 1. ``slot`` numbers the rows of a shard from 0 without gaps, ordered by a
    hash bucket, then key, CRC and size; rows equal in these are numbered in any
    order. ``grown_shard`` is the shard with one more of weight ``grown``. Only
    counts by (shard, bucket) are gathered, so no task numbers a whole shard. Input
    columns named like a result are replaced. An empty table gives no rows.
    """
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    rows = without(df, *RESULTS).withColumns(
        {
            "size": (F.octet_length(text_of(text)) + 1).cast("bigint"),
            "text_crc32": F.crc32(text_of(text).cast("binary")),
            "law": F.lit("key"),
            "shard": rendezvous(name, weights).cast("int"),
            "grown_shard": (rendezvous(name, [*weights, grown]) if grown else F.lit(None)).cast("int"),
        }
    )
    rows = rows.withColumn("__bucket", F.floor(_unit(F.concat_ws(":", name, "text_crc32"), "slot") * BUCKETS).cast("int"))
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col("shard").alias("__s"), F.col("__bucket").alias("__b")).agg(F.count("*").alias("__n"))
    offsets = counts.select("__s", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # len(weights) * BUCKETS rows at most
    placed = rows.join(F.broadcast(offsets), (rows["shard"] == offsets["__s"]) & (rows["__bucket"] == offsets["__b"]))
    rank = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy(key, "text_crc32", "size"))
    return placed.withColumn("slot", (F.col("__before") + rank - 1).cast("bigint")).drop("__s", "__b", "__before", "__bucket")


def write_shards(df: DataFrame, path: str, **how) -> None:
    """The sharded rows as Parquet, one folder for each shard."""
    shard(df, **how).write.partitionBy("shard").parquet(path)


def op3_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards by key, with the shard that each has among nine."""
    rows = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *RESULTS)

