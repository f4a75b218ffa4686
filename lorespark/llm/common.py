"""Shared parts of the training-data operators: scratch tables, tokenising, hashing.

Intermediate tables live in the folder that the cluster names in ``spark.checkpoint.dir``; every executor
and the driver see it, so losing an executor never loses an intermediate result.
"""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset a local run (tests) gets a folder of our own; on a cluster that is an error,
    as every executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lorespark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Folders of intermediate tables that this driver has made and not released.
_made: list[str] = []


class Scratch:
    """Named intermediate Parquet tables in the shared folder; ``drop`` deletes one that is no longer read.

    A result is read from these tables lazily, so they stay until its reader has written it: ``mark`` before and ``release`` after.
    tidy: have Spark remove a write's shuffle files once it is done, where the session leaves that open.
    """

    def __init__(self, spark: SparkSession, label: str, tidy: bool = False):
        self.tidy = tidy
        self.spark, self.base = spark, f"{shared_dir(spark)}/lorespark/{label}-{uuid.uuid4().hex}"
        _made.append(self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        if self.tidy:
            self.spark.conf.set(key, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            if self.tidy:
                self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mark() -> int:
    return len(_made)


def release(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Delete the intermediate tables made after ``mark`` returned ``since``, once what was read from them has been written elsewhere."""
    for base in _made[since:]:
        if base not in keep:
            _delete(spark, base)
    _made[since:] = [b for b in _made[since:] if b in keep]


def settled(df: DataFrame, scratch: Scratch, name: str = "settled") -> DataFrame:
    """``df`` itself if it is a scan with projections and filters only, whose rows come in the same order whenever a task is run again; else written first.

    What numbers rows by their place (``monotonically_increasing_id``) must stand on this: rows behind a shuffle may come back in another order.
    """
    plan, fixed = df._jdf.queryExecution().optimizedPlan(), True
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        fixed &= node.nodeName() in ("Project", "Filter") or node.nodeName().startswith(("Relation", "LogicalRelation", "LogicalRDD", "LocalRelation"))
        kids = node.children()
        nodes += [kids.apply(i) for i in range(kids.size())]
    return df if fixed else scratch.put(name, df)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pow2_at_least(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))


#: The largest number of rows of one long column that is broadcast on purpose (about 16 MB).
BROADCAST_ROWS = 1_000_000


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only if the counted rows stay under the bound; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def heavy_keys(rows: DataFrame, key: str, scratch: Scratch, tag: str) -> DataFrame | None:
    """Keys that over one in ``parts`` rows hold, each with as many cuts as it has such shares; None without any.

    There are fewer than ``parts`` (the shuffle partitions) of them and fewer than twice that many cuts, whatever the copies, so they may be broadcast.
    """
    parts = shuffle_partitions(rows.sparkSession)
    total = max(1, rows.count())
    count = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") * parts > total)
    heavy = scratch.put(f"heavy-{tag}", count.select(key, F.ceil(F.col("__n") * parts / total).alias("__cuts")))
    return None if heavy.isEmpty() else heavy


def cut_join(rows: DataFrame, facts: DataFrame, key: str, heavy: DataFrame | None, spread: F.Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` (one row a key) on ``key``; the rows of ``heavy`` keys are dealt over their cuts by the hash ``spread``, and the fact is repeated for each."""
    if heavy is None:
        return rows.join(facts, key, how)
    heavy, cuts = F.broadcast(heavy), F.coalesce("__cuts", F.lit(1).cast("bigint"))
    rows = rows.withColumn("__at", spread).join(heavy, key, "left").withColumn("__cut", F.pmod("__at", cuts)).drop("__cuts", "__at")
    facts = facts.join(heavy, key, "left").withColumn("__cut", F.explode(F.sequence(F.lit(0).cast("bigint"), cuts - 1))).drop("__cuts")
    return rows.join(facts, [key, "__cut"], how).drop("__cut")


def by_place(*cols: str) -> F.Column:
    """A hash of columns and the row's place, for ``cut_join`` of a written table, whose rows keep their places."""
    return F.xxhash64(*[F.col(c) for c in cols], F.monotonically_increasing_id())


_holders: dict[str, object] = {}
_holding: list[str] = [""]


def hold(name: str, drop=None) -> None:
    """Say which operator a Python worker now serves: what others have kept in it (tables of pieces, powers) is dropped and handed back.

    Spark reuses workers from stage to stage, so that without this their memory would be the sum of all stages'.
    """
    if drop is not None:
        _holders[name] = drop
    if _holding[0] == name:
        return
    _holding[0] = name
    for other, clear in _holders.items():
        if other != name:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


# ---- Arrow and numpy -------------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, vectorised."""
    x = x.astype(U, copy=True)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, size: int):
    """Row ranges (i, j) of at most about ``size`` bytes each; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_pows: dict[str, np.ndarray] = {"p": np.ones(1, U), "i": np.ones(1, U)}


def forget_powers() -> None:
    _pows.update(p=np.ones(1, U), i=np.ones(1, U))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    for key, base in (("p", _P), ("i", _PINV)):
        have = _pows[key]
        while len(have) < n:
            step = np.full(1, pow(base, len(have), 1 << 64), dtype=U)
            have = np.concatenate([have, have * step])
        _pows[key] = have
    return _pows["p"], _pows["i"]


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and each row's first word, n+1 of them.

    Separators are single bytes, so UTF-8 bytes split where code points would. Words never cross rows.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    word = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    p, pi = _powers(n + 1)
    acc = np.zeros(n + 1, U)
    np.cumsum((_LOWER[raw] + U(1)) * p[:n], out=acc[1:])
    h = (acc[e] - acc[s]) * pi[s] + (e - s).astype(U) * U(0xA0761D6478BD642F)
    return mix64(h), np.searchsorted(s, off)


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct k-word shingles; with 1 to k-1 words the whole sequence; without words nothing."""
    w, first = word_hashes(raw, off)
    out: list[np.ndarray] = []
    mult = [U(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64)) for j in range(k)]
    if len(w) >= k:
        all_h = w[: len(w) - k + 1] * mult[0]
        for j in range(1, k):
            all_h = all_h + w[j : len(w) - k + 1 + j] * mult[j]
        all_h = mix64(all_h)
    for i in range(len(off) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            x = np.sort(all_h[a : b - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            x = np.full(1, b - a, U)
            for j in range(a, b):
                x = mix64(x * mult[0] + w[j])
            out.append(x)
        else:
            out.append(np.zeros(0, U))
    return out


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def group_cuts(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of every run of equal keys, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])
