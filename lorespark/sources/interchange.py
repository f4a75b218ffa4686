"""Interchange files: JSON lines in one order, with tags and evidence folded into each record, so that equal libraries make equal files; read back with the number of any record that cannot be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lifecycle import export_records
from .readers import EXPORT, exists

#: Rows a file of an export holds, about.
ROWS_PER_FILE = 1 << 20


def records(mem: DataFrame, tags: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """``lifecycle.export_records`` with the columns of an interchange record (those that mem lacks are null); evidence (memory_id and a link's columns) as an array by event, name and number."""
    out = export_records(mem, tags)
    if evidence is not None:
        link = F.struct("evidence_id", "event_uid", "archive_hash", "raw_locator", "grade", "seq", "occurred_at_ns")
        place = F.struct(F.coalesce("event_uid", F.lit("")), F.coalesce("evidence_id", F.lit("")), F.coalesce("seq", F.lit(0)), link.alias("l"))
        folded = evidence.groupBy(F.col("memory_id").alias("id")).agg(F.transform(F.array_sort(F.collect_set(place)), lambda x: x["l"]).alias("evidence"))
        out = out.drop("evidence").join(folded, "id", "left")
    target = F.col("superseded_by") if "superseded_by" in out.columns else F.lit(None)
    out = out.withColumn("superseded_by_id", target)
    fields = out.sparkSession.createDataFrame([], EXPORT).schema.fields
    have = set(out.columns)
    return out.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def write(recs: DataFrame, path: str) -> None:
    """Write records in the order of (content_hash, project, id), range by range: the files in the order of their names are the export, and equal records make equal bytes, whatever partitions they came in."""
    order = ["content_hash", "project", "id"]
    n = max(1, -(-recs.count() // ROWS_PER_FILE))
    recs.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def read(spark: SparkSession, path: str, schema: str = EXPORT) -> DataFrame:
    """Records of JSON lines (blank lines are none), each with ``record``, its number in its file from 1 across all splits, and ``file``. A record that cannot be read is an error that names file and number. A missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumns({"file": F.lit(""), "record": F.lit(0).cast("bigint")})
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).where(F.trim("value") != "")
    at = lines.withColumn("mid", F.monotonically_increasing_id())
    # a split is read by one task in order: its records are numbered from its first, behind those of the splits before it
    split = at.groupBy("file", "start").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = split.select("file", "start", (before - F.col("first") + 1).alias("base"))
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    numbered = at.join(F.broadcast(base) if base.count() < 1 << 16 else base, ["file", "start"]).select("file", (F.col("mid") + F.col("base")).alias("record"), parsed.alias("r"))
    bad = numbered.where("r is null or r._bad is not null").orderBy("file", "record").select("file", "record").first()
    if bad is not None:
        raise ValueError(f"{bad.file}: record {bad.record} cannot be read")
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    return numbered.select(*[F.col(f"r.{c}").alias(c) for c in names], "file", "record")
