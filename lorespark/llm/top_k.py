"""Exact top-k inner products over norm-sorted blocks with Cauchy-Schwarz pruning.

Vectors become integers. Candidates are range-partitioned by descending length and cut into blocks. The longest block is searched first, for all queries: a query's
k-th score there, over its own length, is the least length that a candidate must have to enter. Queries are sorted by that length and form blocks of their own, and a query
block is sent only to the ranges whose longest vector reaches it; the others are never read for it. A task takes a group of query blocks through one range, longest block first.
After rotation by the right singular vectors of a sample, the leading coordinates carry most of each product, so a product is at most the partial sum over them plus the product
of the two residual lengths; only candidates whose bound reaches the query's k-th best score so far are multiplied out, in integers. A block
whose longest vector cannot reach any query's score ends at the first bound. Each task keeps k results a query and the last step merges them.

The rotation only steers pruning; scores are exact and ties go to the smaller id. The sample has at most about SAMPLE vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .vectors import lists, matrix, usable

SAMPLE = 4000
BLOCK = 2048
QUERY_BLOCK = 512
RANGE_ROWS = 1 << 17
LEADING = 16
#: Query blocks that go through a range together, so that its vectors are moved once for all of them.
QUERY_GROUP = 16

_BLOCKS = "part int, blk int, ids binary, vecs binary, width int, longest double"
_ASKED = _BLOCKS + ", least binary, need double"


def _load(ids: bytes, vecs: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer vectors of a block; components take four bytes where all of the block's fit."""
    i = np.frombuffer(ids, "<i8")
    small = len(vecs) == 4 * len(i) * width
    return i, np.frombuffer(vecs, "<i4" if small else "<i8").reshape(len(i), width).astype(np.int64)


def _blocks(rows: int, asked: bool = False):
    """Rows (vec_id, q and, of queries, least and need) in blocks of ``rows``."""
    from pyspark import TaskContext

    def run(batches):
        part, blk, ids, vecs, least, need = TaskContext.get().partitionId(), 0, [], [], [], []

        def flush():
            m = np.zeros((len(ids), max(map(len, vecs))), "<i8")
            for i, v in enumerate(vecs):
                m[i, : len(v)] = v
            long = float(np.sqrt((m.astype(float) ** 2).sum(axis=1)).max())
            low = m.astype("<i4")
            cols = [[part], [blk], [np.array(ids, "<i8").tobytes()], [(low if (low == m).all() else m).tobytes()], [m.shape[1]], [long]]
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.float64()]
            if asked:
                cols += [[np.array(least, "<f8").tobytes()], [min(need)]]
                types += [pa.binary(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in (_ASKED if asked else _BLOCKS).split(", ")])

        for batch in batches:
            more = [batch.column(c).to_pylist() for c in ("least", "need")] if asked else [[0.0] * batch.num_rows] * 2
            for i, v, a, b in zip(batch.column("vec_id").to_pylist(), lists(batch.column("q")), *more, strict=True):
                ids.append(i)
                vecs.append(v)
                least.append(a)
                need.append(b)
                if len(ids) == rows:
                    yield flush()
                    blk, ids, vecs, least, need = blk + 1, [], [], [], []
        if ids:
            yield flush()

    return run


def products(q: np.ndarray, c: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """q[x] . c[y], exact; what does not fit 64 bits is the nearest number that does."""
    most = int(np.abs(q.astype(float)).max(initial=0)) * int(np.abs(c.astype(float)).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 62:
        return np.einsum("ij,ij->i", q[x], c[y])
    ends = np.iinfo(np.int64)
    exact = (q[x].astype(object) * c[y].astype(object)).sum(axis=1)
    return np.array([min(max(int(v), ends.min), ends.max) for v in exact], np.int64)


def _padded(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(c.shape[1], q.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, wide - m.shape[1]))) if m.shape[1] < wide else m for m in (q, c))


def _thresholds(head: tuple[bytes, bytes, int], k: int):
    """Queries (vec_id, q) with least, their k-th score in the block ``head`` (minus infinity if it holds fewer others), and need, the length that reaches it."""

    def run(batches):
        cids, c0 = _load(*head)
        for batch in batches:
            ids, qs = batch.column("vec_id").to_numpy(), lists(batch.column("q"))
            least, need = np.full(len(ids), -np.inf), np.full(len(ids), -np.inf)
            for i, v in enumerate(qs):
                q, c = _padded(np.asarray(v, np.int64)[None, :], c0)
                other = np.flatnonzero(cids != ids[i])
                if len(other) < k:
                    continue
                score = products(q, c, np.zeros(len(other), np.int64), other)
                least[i] = float(np.partition(score, len(score) - k)[len(score) - k])
                size = float(np.sqrt((q.astype(float) ** 2).sum()))
                need[i] = least[i] / size if size > 0 else -np.inf
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.array(least), pa.array(need)], names=["vec_id", "q", "least", "need"])

    return run


def _reach(parts: np.ndarray, longest: np.ndarray):
    """The ranges that a query block has to see."""

    def run(frames):
        for pdf in frames:
            hit = [parts[longest * (1 + 1e-9) + 1e-6 >= n] for n in pdf.need]
            size = list(map(len, hit))
            yield pdf[["qpart", "qblk"]].loc[np.repeat(pdf.index, size)].assign(part=np.concatenate(hit) if hit else np.zeros(0, int))

    return run


class Best:
    """The k best (score, id) of each query of a block, ties to the smaller id."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.query, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = least.copy()

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        cuts = C.group_cuts(q)
        rank = np.arange(len(q)) - np.repeat(cuts[:-1], np.diff(cuts))
        keep = rank < self.k
        self.query, self.score, self.ids = q[keep], s[keep], i[keep]
        full = rank == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], s[full])


def _search(rotation: np.ndarray, k: int):
    def rotated(m: np.ndarray):
        r = m.astype(float)
        if r.shape[1] == len(rotation):
            r = r @ rotation
        lead, rest = r[:, :LEADING], r[:, LEADING:]
        return np.ascontiguousarray(lead), np.sqrt((rest**2).sum(axis=1)), np.sqrt((r**2).sum(axis=1))

    def run(batches):
        state: dict = {}

        def results():
            if state:
                b, ids = state["best"], state["ids"]
                return pa.RecordBatch.from_arrays([pa.array(ids[b.query]), pa.array(b.ids), pa.array(b.score)], names=["query_id", "vec_id", "score"])
            return None

        for batch in batches:
            for row in batch.to_pylist():
                if state.get("key") != (row["qpart"], row["qblk"], row["part"]):
                    if (out := results()) is not None:
                        yield out
                    ids, raw = _load(row["qids"], row["qvecs"], row["qwidth"])
                    state = {"key": (row["qpart"], row["qblk"], row["part"]), "ids": ids, "raw": raw, "best": Best(np.frombuffer(row["least"], "<f8"), k), "rot": rotated(raw)}
                q, best, qids = state["raw"], state["best"], state["ids"]
                qlead, qrest, qlen = state["rot"]
                cids, c = _load(row["ids"], row["vecs"], row["width"])
                slack = 1e-9 * qlen * row["longest"] + 1e-3
                rows = np.flatnonzero(qlen * row["longest"] + slack >= best.least)
                if not len(rows):
                    continue
                near = np.zeros((len(q), len(c)), bool)
                if c.shape[1] != q.shape[1]:
                    q, c = _padded(q, c)
                    near[rows] = True
                else:
                    clead, crest, _ = rotated(c)
                    near[rows] = qlead[rows] @ clead.T + qrest[rows][:, None] * crest >= (best.least - slack)[rows][:, None]
                near &= qids[:, None] != cids
                a, b = np.nonzero(near)
                small = max(int(np.abs(q).max(initial=0)), int(np.abs(c).max(initial=0))) < 1 << 20
                for i in range(0, len(a), 1 << 18):
                    x, y = a[i : i + (1 << 18)], b[i : i + (1 << 18)]
                    if small and len(a) > 0.1 * near.size:
                        score = (q.astype(float) @ c.astype(float).T)[x, y].astype(np.int64)  # exact: below 2**53
                    else:
                        score = products(q, c, x, y)
                    ok = score >= best.least[x]
                    best.add(x[ok], score[ok], cids[y[ok]])
        if (out := results()) is not None:
            yield out

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products with the rows of ``vectors``, its own id left out.

    vectors, queries: vec_id, embedding; further columns are ignored. Each component x becomes floor(scale * x), x as double. Vectors that are null or
    hold null or non-finite components, and rows without an id, take no part; of rows that repeat a query's id one asks, while as
    candidates repeated rows count one each. Shorter and empty vectors are padded with zeros. Components and scores beyond 64 bits are the nearest number within them.
    Ties go to the smaller id. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    scratch = C.Scratch(spark, "topk")
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))
    whole = lambda df: df.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(empty=True)).select("vec_id", ints.alias("q"))
    base = whole(vectors).withColumn("len", F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = base.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    share = min(1.0, SAMPLE / n)
    sample = base.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("q").toPandas()
    wide = max([1, *map(len, sample.q)])
    fit = np.array([v for v in sample.q if len(v) == wide], float).reshape(-1, wide)
    rotation = np.eye(wide) if not len(fit) else np.linalg.svd(fit, full_matrices=True)[2].T if len(fit) <= wide else np.linalg.eigh(fit.T @ fit)[1][:, ::-1]

    ranges = max(C.shuffle_partitions(spark), math.ceil(n / RANGE_ROWS))
    long_first = [F.col("len").desc(), F.col("vec_id")]
    cand = scratch.put("cand", base.repartitionByRange(ranges, *long_first).sortWithinPartitions(*long_first).mapInArrow(_blocks(BLOCK), _BLOCKS))
    long = cand.groupBy("part").agg(F.max("longest").alias("longest")).toPandas()  # one number a range
    head = cand.where((F.col("part") == int(long.part.min())) & (F.col("blk") == 0)).first()
    ask = whole(queries).dropDuplicates(["vec_id"]).mapInArrow(_thresholds((bytes(head.ids), bytes(head.vecs), head.width), k), "vec_id bigint, q array<bigint>, least double, need double")
    ask = scratch.put("asked", ask)
    n_ask = max(1, math.ceil(ask.count() / QUERY_BLOCK))
    ask = ask.repartitionByRange(n_ask, "need", "vec_id").sortWithinPartitions("need", "vec_id").mapInArrow(_blocks(QUERY_BLOCK, True), _ASKED)
    ask = scratch.put("ask", ask).select(F.col("part").alias("qpart"), F.col("blk").alias("qblk"), F.col("ids").alias("qids"), F.col("vecs").alias("qvecs"), F.col("width").alias("qwidth"), "least", "need")
    # a row is a block: every query block meets the ranges it may find something in, and all blocks of a range stay in order
    reach = ask.select("qpart", "qblk", "need").mapInPandas(_reach(long.part.to_numpy(), long.longest.to_numpy()), "qpart int, qblk int, part int")
    groups = math.ceil(n_ask / QUERY_GROUP)
    reach = scratch.put("reach", reach.withColumn("grp", F.pmod(F.xxhash64("qpart", "qblk"), F.lit(groups))))
    cand = cand.join(reach.select("part", "grp").distinct(), "part")
    met = cand.join(ask.drop("need").join(reach, ["qpart", "qblk"]), ["part", "grp"]).sortWithinPartitions("qpart", "qblk", "part", "blk")
    found = met.select("qpart", "qblk", "part", "qids", "qvecs", "qwidth", "least", "ids", "vecs", "width", "longest").mapInArrow(_search(rotation, k), "query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
