"""Best-fit packing with certified bin counts.

Pieces are scattered over partitions of bounded size. A partition is packed from its length histogram alone (equal lengths
are interchangeable, so at most ``capacity`` counts describe it) by best-fit decreasing, and dual-feasible functions give a lower
bound of its bin count. Where both are equal the partition is certified and done. Partitions with a gap exchange their
pieces: those of a block (MERGE partitions in the first round, MERGE times as many in each further one) pool their histograms and are packed again from the pool; a pool that
saves nothing is undone. When the largest block has been tried, what the last bins of certified partitions waste is exchanged in the same way. Rounds end as soon as the whole
reaches its own lower bound. Which group a partition is in is a table, one row a partition; the driver sees sums only. Pieces then look their place up by their rank among
the pieces of their length, so no task ever holds the pieces of a group.
"""

from __future__ import annotations

import bisect
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import SLICE, default_vocabulary, encoder

CAPACITY = 2048
PIECES_PER_PART = 20_000
MERGE = 8


def best_fit_decreasing(lengths: np.ndarray, counts: np.ndarray, cap: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, items, first bin, items per bin, offset) and the number of bins.

    Items of a length are taken in rank order; the fullest open bin that still fits takes as many as it can, as it would one by one.
    """
    keys: list[int] = []
    bins: dict[int, list[tuple[int, int]]] = {}
    runs, nxt = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in bins:
                bisect.insort(keys, room)
                bins[room] = []
            bins[room].append((first, n))

    order = np.argsort(-lengths)
    for size, left in zip(lengths[order].tolist(), counts[order].tolist(), strict=True):
        rank = 0
        while left:
            at = bisect.bisect_left(keys, size)
            if at < len(keys):
                room = keys[at]
                first, n = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    keys.pop(at)
            else:
                room, first, n = cap, nxt, -(-left // (cap // size))
                nxt += n
            per = room // size
            use = min(n, left // per)
            if use:
                runs.append((size, rank, use * per, first, per, cap - room))
                put(room - per * size, first, use)
                rank, left, first, n = rank + use * per, left - use * per, first + use, n - use
            if n and left and left < per:
                runs.append((size, rank, left, first, left, cap - room))
                put(room - left * size, first, 1)
                left, first, n = 0, first + 1, n - 1
            put(room, first, n)
    return runs, nxt


def lower_bound(lengths: np.ndarray, counts: np.ndarray, cap: int) -> int:
    """The largest bound of the dual-feasible functions f_eps (eps up to cap/2) and u_k (k up to 30), all in exact integers."""
    x, c = lengths.astype(np.int64), counts.astype(np.int64)
    hist = np.zeros(cap + 2, np.int64)
    np.add.at(hist, x, c)
    number, volume = np.cumsum(hist), np.cumsum(hist * np.arange(cap + 2))
    best = -(-int(volume[-1]) // cap)
    eps = np.arange(1, cap // 2 + 1)
    value = (number[-1] - number[cap - eps]) * cap + volume[cap - eps] - volume[eps - 1]
    best = max(best, int(np.max(-(-value // cap), initial=0)))
    for k in range(1, 31):
        whole = (k + 1) * x % cap == 0
        value = int((c * np.where(whole, k * x, (k + 1) * x // cap * cap)).sum())
        best = max(best, -(-value // (k * cap)))
    return best


def pieces_of(n: int, cap: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole if it fits, else a shorter first piece and full ones."""
    if n <= cap:
        return [(0, n)]
    first = n % cap
    return ([(0, first)] if first else []) + [(s, cap) for s in range(first, n, cap)]


def tokenised(docs: DataFrame, keep: list[str], path: str | None = None, end_id: int = 0, cap: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every row of ``docs``: the columns ``keep``, piece, start, length, ids_crc32, salt and, if asked for, ids (little-endian u32)."""
    path = path or default_vocabulary()
    end = int(end_id).to_bytes(4, "little")
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    schema += "piece int, start bigint, length bigint, ids_crc32 bigint, salt int" + ", ids binary" * with_ids
    names = [*keep, "piece", "start", "length", "ids_crc32", "salt", *["ids"] * with_ids]

    def run(batches):
        enc, seen = encoder(path), 0
        seed = TaskContext.get().partitionId() * 0x9E3779B97F4A7C15
        for batch in batches:
            text = batch.column("__text")
            _, off = C.utf8(text)
            for i, j in C.slices(off, SLICE):
                row, cols = [], [[], [], [], [], []]
                for k, e in enumerate(enc.encode([t or "" for t in text[i:j].to_pylist()])):
                    e += end
                    for p, (s, n) in enumerate(pieces_of(len(e) // 4, cap)):
                        raw = e[4 * s : 4 * (s + n)]
                        row.append(i + k)
                        for c, v in zip(cols, (p, s, n, zlib.crc32(raw), raw if with_ids else None), strict=True):
                            c.append(v)
                salt = (C.mix64(np.arange(seen, seen + len(row)).astype(C.U) + C.U(seed & C.M64)) >> C.U(33)).astype(np.int32)
                seen += len(row)
                out = [batch.column(c).take(pa.array(row, pa.int64())) for c in keep]
                out += [pa.array(c, t) for c, t in zip(cols[:4], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] + [pa.array(salt)]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(cols[4], pa.binary())] if with_ids else []), names=names)

    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


_PACKED = "grp bigint, bins bigint, bound bigint, length bigint, rank_from bigint, items bigint, bin_from bigint, per_bin bigint, at bigint"
#: A sequence's number is its group's first partition and its bin: 24 bits of partitions (of 20,000 pieces and more) and 39 of bins.
BIN_BITS = 39


def _pack_group(cap: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf.groupby("length")["n"].sum()
        x, c = h.index.to_numpy(np.int64), h.to_numpy(np.int64)
        runs, bins = best_fit_decreasing(x, c, cap)
        out = pd.DataFrame(runs, columns=["length", "rank_from", "items", "bin_from", "per_bin", "at"], dtype="int64")
        out.insert(0, "bound", lower_bound(x, c, cap))
        out.insert(0, "bins", bins)
        out.insert(0, "grp", int(pdf.grp.iloc[0]))
        return out

    return run


def pack(pieces: DataFrame, scratch: C.Scratch, cap: int = CAPACITY, per_part: int = PIECES_PER_PART) -> tuple[DataFrame, dict[str, int]]:
    """``pieces`` (length 1 to cap, salt and any further columns; a written table) with sequence_id and offset, and the bin counts.

    An empty table gives no rows. Pieces of equal length take places in no set order among themselves.
    """
    spark = pieces.sparkSession
    n = pieces.count()
    parts = max(1, math.ceil(n / max(per_part, n >> (63 - BIN_BITS))))
    pieces = pieces.withColumn("part", F.pmod("salt", F.lit(parts)).cast("bigint"))
    hist = scratch.put("hist", pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    whole = hist.groupBy("length").agg(F.sum("n").alias("n")).toPandas()  # at most ``cap`` rows
    if not len(whole):
        return pieces.drop("part", "salt").withColumn("sequence_id", F.lit(None).cast("bigint")).withColumn("offset", F.lit(None).cast("bigint")).where("false"), {"bins": 0, "bound": 0}
    least = lower_bound(whole.length.to_numpy(np.int64), whole.n.to_numpy(np.int64), cap)

    def packed(members: DataFrame, rnd: int) -> DataFrame:
        """Pack the groups of ``members`` (part, grp); (grp, bins, bound) of each."""
        h = hist.join(C.maybe_broadcast(members, parts), "part").groupBy("grp", "length").agg(F.sum("n").alias("n"))
        t = scratch.put(f"pack{rnd}", h.groupBy("grp").applyInPandas(_pack_group(cap), _PACKED))
        return t.groupBy("grp").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"))

    # where: the group of each partition and the round that packed it; groups: one row each
    where = scratch.put("where0", hist.select("part").distinct().select("part", F.lit(0).alias("rnd"), F.col("part").alias("grp")))
    groups = scratch.put("groups0", packed(where.select("part", "grp"), 0).select(F.lit(0).alias("rnd"), "grp", F.col("grp").alias("first"), "bins", "bound"))
    levels = math.ceil(math.log(parts, MERGE) - 1e-9) if parts > 1 else 0
    bins, rnd, tried = groups.agg(F.sum("bins")).first()[0], 0, [0]
    for everyone in (False, True):
        for level in range(1, levels + 1):
            if bins <= least:
                break
            pick = groups if everyone else groups.where("bins > bound")
            pick = pick.withColumn("blk", F.expr(f"first div {MERGE**level}"))
            pool = pick.groupBy("blk").agg(F.count("*").alias("c"), F.sum("bins").alias("old")).where("c > 1").select("blk", "old")
            rnd += 1
            moved = where.join(pick.select("rnd", "grp", "blk"), ["rnd", "grp"]).join(pool, "blk").select("part", F.col("blk").alias("grp"), "old")
            moved = scratch.put(f"moved{rnd}", moved)
            if moved.isEmpty():
                continue
            tried.append(rnd)
            old = moved.groupBy("grp").agg(F.first("old").alias("old"), F.min("part").alias("first"))
            better = packed(moved.select("part", "grp"), rnd).join(old, "grp").where("bins < old")  # where nothing is saved the members keep their own packing
            better = scratch.put(f"better{rnd}", better.select(F.lit(rnd).alias("rnd"), "grp", "first", "bins", "bound"))
            to = moved.select("part", "grp").join(better.select("grp"), "grp").select("part", F.col("grp").alias("to"))
            where = where.join(to, "part", "left").select("part", F.when(F.col("to").isNull(), F.col("rnd")).otherwise(rnd).alias("rnd"), F.coalesce("to", "grp").alias("grp"))
            where = scratch.put(f"where{rnd}", where)
            groups = scratch.put(f"groups{rnd}", groups.join(where.select("rnd", "grp").distinct(), ["rnd", "grp"], "left_semi").unionByName(better))
            bins = groups.agg(F.sum("bins")).first()[0]
    runs = None
    for r in tried:
        t = spark.read.schema(_PACKED).parquet(scratch.path(f"pack{r}")).withColumn("rnd", F.lit(r))
        runs = t if runs is None else runs.union(t)
    runs = runs.join(groups.select("rnd", "grp", "first"), ["rnd", "grp"])
    runs = runs.groupBy("rnd", "grp", "length").agg(F.array_sort(F.collect_list(F.struct("rank_from", "items", "bin_from", "per_bin", "at", "first"))).alias("runs"))
    before = Window.partitionBy("rnd", "grp", "length").orderBy("part")
    places = hist.join(C.maybe_broadcast(where, parts), "part").withColumn("before", F.sum("n").over(before) - F.col("n"))
    mine = F.filter("runs", lambda r: (r["rank_from"] < F.col("before") + F.col("n")) & (r["rank_from"] + r["items"] > F.col("before")))
    places = scratch.put("places", places.join(runs, ["rnd", "grp", "length"]).select("part", "length", "before", mine.alias("runs")))
    rank = F.row_number().over(Window.partitionBy("part", "length").orderBy("salt")) - 1
    # pieces stand by (part, length) for their ranks: places, as many as histogram rows, are sorted to them and not broadcast
    out = pieces.withColumn("rank", rank).join(places.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    hit = F.filter("runs", lambda r: (F.col("rank") >= r["rank_from"]) & (F.col("rank") < r["rank_from"] + r["items"]))[0]
    out = out.withColumn("run", hit).withColumn("k", F.col("rank") - F.col("run.rank_from"))
    out = out.withColumn("sequence_id", F.shiftleft("run.first", BIN_BITS) + F.col("run.bin_from") + F.expr("k div run.per_bin"))
    out = out.withColumn("offset", F.col("run.at") + F.expr("k % run.per_bin") * F.col("length"))
    return out.drop("runs", "run", "k", "rank", "before", "part", "salt"), {"bins": bins, "bound": least}


def pack_documents(docs: DataFrame, path: str | None = None, cap: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text; null text: empty, one token).

    Repeated rows and null ids are packed like any others; a text of any length is cut whole into pieces; pieces of equal length take places in no set order; further
    columns are ignored; an empty table gives no rows.
    """
    scratch = C.Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pieces = scratch.put("pieces", tokenised(rows, ["doc_id"], path, 0, cap))
    out, _ = pack(pieces, scratch, cap)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): packed pieces that carry ``ids``, put end to end in offset order; a sequence holds at most ``cap`` ids."""
    row = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(row.alias("rows")).select("sequence_id", F.aggregate("rows", F.lit(b"").cast("binary"), lambda s, r: F.concat(s, r["ids"])).alias("ids"))
