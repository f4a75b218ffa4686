"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with target share w of the output and size s gets the repetition rate ``w * budget / s``. Each document's
count is the inverse of the Poisson distribution with that mean at a uniform number hashed from the seed, the document's
id and text; the document is repeated so often, and the copies are put in a global random order by a second hash.
The result depends on the seed and the rows alone, not on how the input is partitioned, so a lost task is recomputed alike.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Weights follow size ** ALPHA where none are given; SEED seeds every hash.
ALPHA = 0.7
SEED = 11
#: Rates above this are drawn as sums of independent counts with means of at most this; hashes give 52 random bits.
CHUNK = 16.0
_TERMS = 80
#: Copies that one task of the shuffle takes (256 MB at 2 KB a row).
ROWS_PER_TASK = 1 << 17
#: At most this many sources (some 0.7 KB each, 7 MB in all) have their rates broadcast.
BROADCAST_SOURCES = 10_000


def unit(seed: int, salt: str, *cols) -> F.Column:
    """A uniform number in (0, 1) from 52 bits of an MD5 over the seed and the columns."""
    key = F.concat_ws("|", F.lit(f"{seed}:{salt}"), *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) if isinstance(c, str) else c for c in cols])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = 1.0) -> DataFrame:
    """(source_key, size, rate, parts, cdf) of each source; size in rows. A null source is a source of its own.

    weights: a target share for each source (others get none); without it shares follow size ** alpha.
    """
    key = F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("n"))
    size = docs.groupBy(key.alias("source_key")).agg(F.count("*").alias("size"))
    if weights is None:
        share = F.pow(F.col("size").cast("double"), F.lit(float(alpha)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit("n" if k is None else f"s:{k}"), F.lit(float(v)))]
        share = F.coalesce(F.create_map(*pairs)[F.col("source_key")] if pairs else F.lit(None).cast("double"), F.lit(0.0))
    size = size.withColumn("share", share)
    total = size.agg(F.sum("share").alias("all_share"), F.sum("size").alias("all_size"))  # one row
    out = size.join(F.broadcast(total)).where("all_share > 0")
    out = out.withColumn("rate", F.col("share") / F.col("all_share") * F.col("all_size") * F.lit(float(epochs)) / F.col("size"))
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(CHUNK))).cast("int"))
    mean = F.col("rate") / F.col("parts")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    step = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * mean / k)).alias("cdf"))
    return out.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), start, step)["cdf"]).select("source_key", "size", "rate", "parts", "cdf")


def _with_rates(rows: DataFrame, r: DataFrame) -> DataFrame:
    """``rows`` joined to their sources' rates (``r``: __key, __size, ...) so that no task takes a whole hot source.

    Up to BROADCAST_SOURCES sources are broadcast and no text is moved. Of more sources at most that many hold one row in BROADCAST_SOURCES or more;
    those are broadcast, and the rest, none of them hot, are joined by a shuffle.
    """
    one = r.agg(F.count("*").alias("n"), F.sum("__size").alias("all")).first()
    if one.n <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(r), "__key")
    hot = r.where(F.col("__size") * BROADCAST_SOURCES >= one["all"])
    rest = rows.join(F.broadcast(hot.select("__key")), "__key", "left_anti").join(r.where(F.col("__size") * BROADCAST_SOURCES < one["all"]), "__key")
    return rows.join(F.broadcast(hot), "__key").unionByName(rest)


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source and any further columns) with each row repeated by its Poisson count.

    Adds mix_rate, mix_copies, mix_copy (from 0) and mix_key (a random number that orders the global shuffle). Rows with equal
    id and text draw equal counts. Null ids, texts and sources are values like others. Columns of these names in docs are replaced.
    """
    names = [c for c in docs.columns if c not in ("mix_rate", "mix_copies", "mix_copy", "mix_key")]
    r = rates(docs, weights, alpha, epochs).select(F.col("source_key").alias("__key"), F.col("size").alias("__size"), F.col("rate").alias("mix_rate"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    r = C.Scratch(docs.sparkSession, "mixing").put("rates", r)
    rows = docs.select(*names).withColumn("__key", F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("n")))
    rows = _with_rates(rows, r).withColumn("__id", F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit("")))))
    # the number of cdf entries up to u; u stands in the fold's start, so that it is hashed once
    below = lambda u: F.aggregate("__cdf", F.struct(u.alias("u"), F.lit(0).alias("n")), lambda s, c: F.struct(s["u"].alias("u"), (s["n"] + (c <= s["u"]).cast("int")).alias("n")), lambda s: s["n"])
    many = F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda n, i: n + below(unit(seed, "n", "__id", i.cast("string"))))
    rows = rows.withColumn("mix_copies", F.when(F.col("__parts") == 1, below(unit(seed, "n", "__id", F.lit("1")))).otherwise(many))
    rows = rows.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    rows = rows.withColumn("mix_key", unit(seed, "o", "__id", F.col("mix_copy").cast("string")))
    return rows.select(*names, "mix_rate", "mix_copies", "mix_copy", "mix_key")


def shuffled(mixed: DataFrame, rows: int | None = None) -> DataFrame:
    """The global shuffle: copies are dealt to partitions by the hash of their random key and sorted by it (ties by id and copy).

    rows: how many there are, about; a partition takes ROWS_PER_TASK. No range boundaries are sampled, so texts are read and moved once.
    """
    n = max(C.shuffle_partitions(mixed.sparkSession), -(-(rows or 0) // ROWS_PER_TASK))
    return mixed.repartition(n, "mix_key").sortWithinPartitions("mix_key", "doc_id", "mix_copy")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """``replicate`` and ``shuffled``. Null and empty texts are repeated like others, an empty table stays empty, equal keys stand in the order of id and copy."""
    n = math.ceil(docs.count() * epochs)  # Parquet answers it from its footers
    return shuffled(replicate(docs, weights, alpha, epochs, seed), n)


def oracle(alpha: float = ALPHA, seed: int = SEED) -> str:
    """DuckDB SQL for op2's rows, for rates of at most CHUNK (sources of size ** alpha shares at one epoch)."""
    assert math.isfinite(CHUNK)
    u = lambda salt, n: f"(('0x' || substr(md5('{seed}:{salt}|' || id || '|' || {n}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"
    return f"""
WITH sized AS (SELECT coalesce('s:' || source, 'n') AS k, count(*) AS size FROM documents GROUP BY 1),
rated AS (SELECT k, pow(size::DOUBLE, {alpha}) / sum(pow(size::DOUBLE, {alpha})) OVER () * sum(size) OVER () / size AS rate FROM sized),
terms AS (SELECT k, rate, unnest(range(0, {_TERMS + 1})) AS i FROM rated),
cdf AS (SELECT k, rate, i, sum(exp(-rate + i * ln(rate) - lgamma(i + 1))) OVER (PARTITION BY k ORDER BY i) AS c FROM terms),
docs AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) AS n_bytes, coalesce('s:' || source, 'n') AS k, coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, '')) AS id FROM documents),
drawn AS (SELECT d.doc_id, d.source, d.n_bytes, d.id, any_value(c.rate) AS rate, count(*) FILTER (WHERE c.c <= {u("n", "'1'")}) AS copies
          FROM docs d JOIN cdf c USING (k) GROUP BY ALL),
out AS (SELECT *, unnest(range(0, copies)) AS copy FROM drawn WHERE copies > 0)
SELECT doc_id, source, n_bytes::BIGINT AS n_bytes, round(rate, 9) AS mix_rate, copies::INTEGER AS mix_copies, copy::INTEGER AS mix_copy, {u("o", "copy::VARCHAR")} AS mix_key FROM out
"""
