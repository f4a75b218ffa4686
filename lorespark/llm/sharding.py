"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass 1 scatters every record, whole, into memory-sized buckets by a seeded hash. Pass 2 holds one bucket at a time, puts it in
a canonical order, applies Spark's own seeded Fisher-Yates (``shuffle``) and writes it to the shared folder. A bucket's records follow those of the buckets before it, so
each record gets a global position; position p goes to shard ``p mod n``, slot ``p div n``: every shard is a uniform random sample and row
counts differ by one at most (law ``rows``).

The shuffled table is written before positions are read from it, so recomputation after a lost executor cannot mix two orders.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SEED = 29
#: Text bytes of one bucket; a bucket is held in memory once.
BUCKET_BYTES = 8 << 20
BUCKETS_PER_TASK = 4


def _map_free(docs: DataFrame) -> list[str]:
    return [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]


def external_shuffle(docs: DataFrame, n_shards: int, scratch: C.Scratch, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text and any further columns) with shard and slot, written in shuffled order.

    Null ids and texts are values like others; a long text stands in one bucket whole; repeated rows are kept and get slots of their own. Columns named
    shard or slot in docs are replaced. An empty table stays empty. Rows behind a shuffle are written first, as a lost task must deal them alike.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    docs = C.settled(docs.select(*names), scratch)
    stat = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.lit(64)).alias("b")).first()
    tasks = max(C.shuffle_partitions(spark), math.ceil((stat.b or 0) / (BUCKET_BYTES * BUCKETS_PER_TASK)))
    buckets = tasks * BUCKETS_PER_TASK
    # rows that are equal in id and text differ in this salt, so that repeated rows cannot fill one bucket; docs come in the same order whenever a task is run again
    key = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed))
    salt = F.xxhash64(key, F.monotonically_increasing_id())
    put = docs.withColumn("__h", key).withColumn("__bucket", F.pmod(F.xxhash64(salt, F.lit(seed)), F.lit(buckets)).cast("int"))
    row = F.struct(F.col("__h"), F.struct(*_map_free(docs)).alias("r"), *[F.col(c) for c in names if c not in _map_free(docs)])
    held = put.repartition(tasks, "__bucket").groupBy("__bucket").agg(F.collect_list(row).alias("rows"))
    order = lambda x, y: F.when(x["__h"] < y["__h"], -1).when(x["__h"] > y["__h"], 1).otherwise(0)
    lists = F.array_sort("rows") if len(_map_free(docs)) == len(names) else F.array_sort("rows", order)
    mixed = held.select("__bucket", F.posexplode(F.shuffle(lists, F.lit(seed))).alias("__at", "__row"))
    mixed = mixed.select("__bucket", "__at", "__row.r.*", *[F.col(f"__row.`{c}`") for c in names if c not in _map_free(docs)])
    mixed = scratch.put("shuffled", mixed.select("__bucket", "__at", *names))
    # one row a bucket: at 8 MB a bucket, 100 TB make some ten million of them, summed in one pass
    count = mixed.groupBy("__bucket").agg(F.count("*").alias("n"))
    base = count.select("__bucket", (F.sum("n").over(Window.orderBy("__bucket")) - F.col("n")).alias("__base"))
    placed = mixed.join(C.maybe_broadcast(base, buckets), "__bucket").withColumn("__p", F.col("__base") + F.col("__at"))
    return placed.select(*names, F.pmod("__p", F.lit(n_shards)).cast("int").alias("shard"), F.expr(f"__p div {int(n_shards)}").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write a sharded table as one folder per shard, each in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
