"""Embedding near-dedup on a robust-pruned flat graph.

Equal unit vectors of one label are one class, of which only the least id is searched: copies at distance 0 would fill each other's lists.
Vectors of one label are dealt to overlapping cluster shards, the OVERLAP nearest cells of a tree: a cell of more than SHARD_ROWS vectors is split into at most FAN, on centres that an
executor fits to a bounded sample of the cell, level by level, so shards keep their size however many vectors there are and no task or driver holds all centres. Centres within
range of each other are one, and a cell whose vectors mostly stand in range of each other is not split: its pairs are links. Every shard
builds a robust-pruned graph, and a vector's adjacency lists from all its shards are united. Every vector then searches its home shard, that of its nearest
centre: greedily from the shard's medoid and a few spread nodes, and from each hit and its own node on through the graph for as long as
vectors in range turn up, so a range of any size is walked to its end. A link is found if either end's nearest centre is among the
other's OVERLAP nearest; searching the other shards too would find nearly every link again. Hits are verified by cosine in double
precision. Recall is audited against brute force on a stated query set, for each vector, and averaged by label, so one large range does not
outweigh the rest. If a label is below the target, it and every label not shown to reach it are searched exactly, all pairs of each shard, with
twice the overlap; a label that is then still below it is searched exactly as a whole, which is quadratic in its rows. If a label is below the target even then, that is an error.

A shard of more than SHARD_ROWS vectors (a large group of near copies cannot be clustered apart) is cut into blocks by hash, and all pairs of
blocks are searched, so no task grows with the group and none of its vectors is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components
from .vectors import matrix, usable

#: Parameters. A cell is split into one for every CLUSTER_ROWS vectors, at most FAN, on SAMPLE_PER_CENTRE sampled vectors each; ASSIGN vectors are dealt in one task.
CLUSTER_ROWS = 256
FAN = 64
SAMPLE_PER_CENTRE = 24
ASSIGN = 4096
OVERLAP = 4
SHARD_ROWS = 1200
DEGREE, POOL, ALPHA, BEAM, SLACK = 24, 48, 1.2, 24, 0.05
AUDIT, AUDIT_ROWS = 200, 8192
ENTRIES, FILL = 8, 12
RECALL = 0.95


def centres_of(x: np.ndarray, k: int, least: float) -> np.ndarray:
    """At most k centres of unit vectors by spherical k-means; of centres within range of each other that of the most vectors is left."""
    c = x[np.random.default_rng(7).permutation(len(x))[:k]]
    for _ in range(6):
        near = np.argmax(x @ c.T, axis=1)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        n = np.linalg.norm(s, axis=1)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1e-12)[:, None], c)
    size = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
    kept: list[int] = []
    for i in np.argsort(-size, kind="stable"):
        if not kept or float((c[kept] @ c[i]).max()) < least:
            kept.append(int(i))
    return c[kept]


def robust_graph(x: np.ndarray) -> np.ndarray:
    """Adjacency padded with -1: robust-pruned neighbours from the nearest and some random vectors, the FILL nearest, and reverse edges.

    Pruning alone leaves the members of a ball tied only to its centre, whose list cannot hold them all; the nearest tie them to each other.
    """
    n = len(x)
    if n < 2:
        return np.full((n, 1), -1)
    dist = np.maximum(0, 2 - 2 * (x @ x.T))
    np.fill_diagonal(dist, np.inf)
    near = np.argpartition(dist, min(POOL, n - 1) - 1, axis=1)[:, : min(POOL, n - 1)]
    pool = np.concatenate([near, np.random.default_rng(n).integers(0, n, (n, 16))], axis=1)
    d = np.take_along_axis(dist, pool, axis=1)
    rows, adj = np.arange(n), np.full((n, 2 * DEGREE), -1)
    for r in range(DEGREE):
        best = np.argmin(d, axis=1)
        ok = np.isfinite(d[rows, best])
        if not ok.any():
            break
        pick = pool[rows, best]
        adj[ok, r] = pick[ok]
        covered = ALPHA * dist[pick[:, None], pool] <= d
        d = np.where(covered | (pool == pick[:, None]), np.inf, d)
    order = np.argsort(np.take_along_axis(dist, near, axis=1), axis=1)[:, :FILL]
    adj = np.concatenate([np.take_along_axis(near, order, axis=1), adj], axis=1)
    at = adj.shape[1] - DEGREE
    src, dst = np.nonzero(adj >= 0)[0], adj[adj >= 0]
    order = np.random.default_rng(n + 1).permutation(len(src))
    src, dst = src[order], dst[order]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    cuts = C.group_cuts(dst)
    rank = np.arange(len(dst)) - np.repeat(cuts[:-1], np.diff(cuts))
    ok = rank < DEGREE
    adj[dst[ok], at + rank[ok]] = src[ok]
    return adj


def range_search(x: np.ndarray, adj: np.ndarray, q: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, cosine) in range. x: graph vectors, adj: padded with -1, own: each query's node or -1.

    The greedy walk starts from the medoid and ENTRIES - 1 evenly spread nodes, never from the query's own node: a few near copies tied only to
    each other would keep a walk from there to themselves. The own node is one more start of the range expansion.
    """
    n, m = len(x), len(q)
    seen = np.zeros((m, n), bool)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    starts = np.unique(np.concatenate([[medoid], np.linspace(0, n - 1, ENTRIES - 1).astype(int)]))
    beam = np.full((m, BEAM), -1)
    sim = np.full((m, BEAM), -np.inf)
    open_ = np.zeros((m, BEAM), bool)
    every, k = np.arange(m), len(starts)
    beam[:, :k], sim[:, :k], open_[:, :k] = starts, q @ x[starts].T, True
    seen[:, starts] = True
    hits_q, hits_n, hits_s = [np.repeat(every, k)], [np.tile(starts, m)], [sim[:, :k].ravel()]
    while open_.any():
        act = np.flatnonzero(open_.any(axis=1))
        at = np.argmax(np.where(open_[act], sim[act], -np.inf), axis=1)
        open_[act, at] = False
        nb = adj[beam[act, at]]
        ok = nb >= 0
        ok[ok] &= ~seen[np.repeat(act, ok.sum(axis=1)), nb[ok]]
        qi, ni = np.repeat(act, ok.sum(axis=1)), nb[ok]
        key = np.unique(qi * n + ni)
        qi, ni = key // n, key % n
        if not len(qi):
            continue
        seen[qi, ni] = True
        s = np.einsum("ij,ij->i", q[qi], x[ni])
        hits_q.append(qi), hits_n.append(ni), hits_s.append(s)
        cuts = C.group_cuts(qi)
        who, width = qi[cuts[:-1]], int(np.diff(cuts).max())
        col = np.arange(len(qi)) - np.repeat(cuts[:-1], np.diff(cuts))
        grown = [np.full((len(who), width), v) for v in (-1, -np.inf, False)]
        line = np.repeat(np.arange(len(who)), np.diff(cuts))
        for g, v in zip(grown, (ni, s, True), strict=True):
            g[line, col] = v
        both = [np.concatenate([a[who], g], axis=1) for a, g in zip((beam, sim, open_), grown, strict=True)]
        top = np.argsort(-both[1], axis=1)[:, :BEAM]
        beam[who], sim[who], open_[who] = (np.take_along_axis(b, top, axis=1) for b in both)
    alone = np.flatnonzero(own >= 0)
    alone = alone[~seen[alone, own[alone]]]
    seen[alone, own[alone]] = True
    hits_q.append(alone), hits_n.append(own[alone]), hits_s.append(np.einsum("ij,ij->i", q[alone], x[own[alone]]))
    fq, fn, fs = np.concatenate(hits_q), np.concatenate(hits_n), np.concatenate(hits_s)
    out = [(fq[fs >= least], fn[fs >= least], fs[fs >= least])]
    keep = fs >= least - SLACK
    fq, fn = fq[keep], fn[keep]
    while len(fq):  # the range expands through every vector in or near it
        nxt = []
        for i in range(0, len(fq), 1 << 17):
            a, nb = fq[i : i + (1 << 17)], adj[fn[i : i + (1 << 17)]]
            ok = nb >= 0
            a, nb = np.repeat(a, ok.sum(axis=1)), nb[ok]
            new = ~seen[a, nb]
            key = np.unique(a[new] * n + nb[new])
            a, nb = key // n, key % n
            seen[a, nb] = True
            s = np.concatenate([np.einsum("ij,ij->i", q[a[j : j + 65536]], x[nb[j : j + 65536]]) for j in range(0, len(a), 65536)] or [np.zeros(0)])
            hit = s >= least
            out.append((a[hit], nb[hit], s[hit]))
            go = s >= least - SLACK
            nxt.append((a[go], nb[go]))
        fq, fn = (np.concatenate([x[k] for x in nxt]) for k in (0, 1))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def _search_group(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        idx, ask = pdf[pdf.role != 2].reset_index(drop=True), pdf[pdf.role != 1]
        if not len(idx) or not len(ask):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        order = np.argsort(idx.vec_id.to_numpy())
        idx = idx.iloc[order]
        ids = idx.vec_id.to_numpy()
        x, q = matrix(idx.vec.tolist(), "<f8"), matrix(ask.vec.tolist(), "<f8")
        local = [np.searchsorted(ids, v) for v in (np.asarray(nb, np.int64) for nb in idx.nbrs)]
        local = [p[(p < len(ids))][ids[p[p < len(ids)]] == np.asarray(nb, np.int64)[p < len(ids)]] for p, nb in zip(local, idx.nbrs, strict=True)]
        adj = np.full((len(ids), max([1, *map(len, local)])), -1)
        for i, p in enumerate(local):
            adj[i, : len(p)] = p
        at = np.searchsorted(ids, ask.vec_id.to_numpy())
        own = np.where((at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == ask.vec_id.to_numpy()), at, -1)
        qi, ni, _ = range_search(x, adj, q, own, least)
        a, b = ask.vec_id.to_numpy()[qi], ids[ni]
        ok = a != b
        return pd.DataFrame({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok]}).drop_duplicates()

    return run


def _graph_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id")
    ids = pdf.vec_id.to_numpy()
    adj = robust_graph(matrix(pdf.vec.tolist(), "<f8"))
    return pd.DataFrame({"vec_id": ids, "nbrs": [ids[row[row >= 0]] for row in adj]})


def _fit(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = matrix(pdf.vec.tolist(), "<f8")
        c = centres_of(x, int(pdf.k.iloc[0]), least)
        return pd.DataFrame({"cell": [int(pdf.cell.iloc[0])], "wide": [c.shape[1]], "centres": [c.tobytes()], "n": [int(pdf.n.iloc[0])]})

    return run


def _assign(overlap: int):
    """A block of a cell's vectors with the centres of the cell: the nearest ``overlap`` cells below it of each, with the cosines."""

    def run(rows: pd.DataFrame, split: pd.DataFrame) -> pd.DataFrame:
        if not len(split):  # no vector was drawn: the cell stays as it is, and is not split again
            return rows[["vec_id", "label", "cell"]].assign(sim=0.0, above=1)
        if not len(rows):
            return pd.DataFrame({"vec_id": [], "label": [], "cell": [], "sim": [], "above": []})
        wide = int(split.wide.iloc[0])
        c = np.frombuffer(split.centres.iloc[0], "<f8").reshape(-1, wide)
        x = matrix(rows.vec.tolist(), "<f8", wide)
        sims = x @ np.pad(c, ((0, 0), (0, x.shape[1] - wide))).T
        k = min(overlap, len(c))
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        below = C.mix64(np.full(1, int(split.cell.iloc[0])).view(C.U) + (near.astype(C.U) + C.U(1)) * C.U(0x9E3779B97F4A7C15))
        out = rows[["vec_id", "label"]].loc[rows.index.repeat(k)]
        return out.assign(cell=below.view(np.int64).ravel(), sim=np.take_along_axis(sims, near, axis=1).ravel(), above=int(split.n.iloc[0]))

    return run


def _cells(vecs: DataFrame, overlap: int, least: float, scratch: C.Scratch, tag: str) -> DataFrame:
    """(vec_id, label, vec, cell, home): every vector in its ``overlap`` nearest cells, home in the nearest. overlap 0: a label is one cell."""
    at = vecs.select("vec_id", "label", F.xxhash64("label").alias("cell"), F.lit(0.0).alias("sim"), F.lit(None).cast("bigint").alias("above"), F.lit(True).alias("home"))
    dense, level = math.sqrt(least), 0
    while overlap:
        size = at.where("home").groupBy("cell").agg(F.count("*").alias("n"), F.avg("sim").alias("mean"), F.max("above").alias("above"))
        # a cell that its last split has hardly shrunk would go on for ever
        big = size.where((F.col("n") > SHARD_ROWS) & (F.col("above").isNull() | (F.col("n") < 0.9 * F.col("above")) & (F.col("mean") < dense)))
        k = F.least(F.lit(FAN), F.ceil(F.col("n") / CLUSTER_ROWS))
        big = scratch.put(f"big{tag}-{level}", big.select("cell", "n", k.cast("int").alias("k")))
        n_big = big.count()
        if not n_big:
            break
        some = C.maybe_broadcast(big, n_big)
        rows = at.join(some, "cell").join(vecs.select("vec_id", "vec"), "vec_id")
        drawn = F.pmod(F.xxhash64("vec_id", F.lit(level + 1)), F.lit(1 << 40)) < F.lit(float(1 << 40)) * SAMPLE_PER_CENTRE * F.col("k") / F.col("n")
        split = scratch.put(f"split{tag}-{level}", rows.where(F.col("home") & drawn).select("cell", "k", "n", "vec").groupBy("cell").applyInPandas(_fit(least), "cell bigint, wide int, centres binary, n bigint"))
        blocks = at.join(some, "cell").groupBy("cell").agg(F.ceil(F.count("*") / ASSIGN).cast("int").alias("nb"))
        blocks = scratch.put(f"nb{tag}-{level}", blocks)
        split = split.join(blocks, "cell").withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        rows = rows.join(C.maybe_broadcast(blocks, n_big), "cell").withColumn("blk", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("nb")).cast("int")).select("vec_id", "label", "vec", "cell", "blk")
        below = rows.groupBy("cell", "blk").cogroup(split.groupBy("cell", "blk")).applyInPandas(_assign(overlap), "vec_id bigint, label string, cell bigint, sim double, above bigint")
        every = at.join(some, "cell", "left_anti").select("vec_id", "label", "cell", "sim", "above").unionByName(below)
        rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("sim"), "cell"))
        at = scratch.put(f"cells{tag}-{level}", every.withColumn("r", rank).where(F.col("r") <= overlap).withColumn("home", F.col("r") == 1).drop("r"))
        level += 1
    return vecs.select("vec_id", "vec").join(at.select("vec_id", "label", "cell", "home"), "vec_id")


def _blocks(vecs: DataFrame, overlap: int, least: float, scratch: C.Scratch, tag: str) -> DataFrame:
    """Every vector in its shards, with the shard's number of blocks (nb) and its own (blk)."""
    dealt = scratch.put(f"dealt{tag}", _cells(vecs, overlap, least, scratch, tag))
    size = dealt.groupBy("label", "cell").agg(F.count("*").alias("n")).withColumn("nb", F.ceil(F.col("n") / SHARD_ROWS).cast("int"))
    return dealt.join(size.select("label", "cell", "nb"), ["label", "cell"]).withColumn("blk", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("nb")).cast("int"))


def _exact_group(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = pdf[pdf.blk == pdf.i], pdf[pdf.blk == pdf.j]
        if not len(p) or not len(q):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        wide = max(map(len, pdf.vec)) // 8
        i, j = np.nonzero(matrix(p.vec.tolist(), "<f8", wide) @ matrix(q.vec.tolist(), "<f8", wide).T >= least)
        a, b = p.vec_id.to_numpy()[i], q.vec_id.to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(a, b)[a != b], "b": np.maximum(a, b)[a != b]}).drop_duplicates()

    return run


def _exact_links(vecs: DataFrame, overlap: int, least: float, scratch: C.Scratch, tag: str) -> DataFrame:
    """All links of vectors that share a shard, by all pairs of its blocks. With overlap 0 a label is one shard."""
    pair = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda b: F.struct(F.least("blk", b).alias("i"), F.greatest("blk", b).alias("j")))
    put = _blocks(vecs, overlap, least, scratch, tag).withColumn("to", F.explode(pair)).select("label", "cell", "to.i", "to.j", "blk", "vec_id", "vec")
    return put.groupBy("label", "cell", "i", "j").applyInPandas(_exact_group(least), "a bigint, b bigint")


def _links(vecs: DataFrame, overlap: int, least: float, scratch: C.Scratch, tag: str) -> DataFrame:
    dealt = _blocks(vecs, overlap, least, scratch, tag)
    graph = dealt.select("label", "cell", "blk", "vec_id", "vec").groupBy("label", "cell", "blk").applyInPandas(_graph_group, "vec_id bigint, nbrs array<bigint>")
    graph = scratch.put(f"graph{tag}", graph.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs")))
    # a row serves block pair (i, j) as part of the graph if it is in block i, as a query if it is in block j and at home
    both = F.array(F.struct(F.col("blk").alias("i"), F.col("blk").alias("j"), F.when(F.col("home"), 0).otherwise(1).alias("role")))
    others = F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda b: b != F.col("blk"))
    as_graph = F.transform(others, lambda b: F.struct(F.col("blk").alias("i"), b.alias("j"), F.lit(1).alias("role")))
    as_query = F.transform(others, lambda b: F.struct(b.alias("i"), F.col("blk").alias("j"), F.lit(2).alias("role")))
    as_query = F.when(F.col("home"), as_query).otherwise(F.filter(as_query, lambda b: F.lit(False)))
    put = dealt.join(graph, "vec_id").withColumn("to", F.explode(F.concat(both, as_graph, as_query)))
    put = put.select("label", "cell", "to.i", "to.j", "to.role", "vec_id", "vec", F.when(F.col("to.role") == 2, F.array().cast("array<bigint>")).otherwise(F.col("nbrs")).alias("nbrs"))
    found = put.groupBy("label", "cell", "i", "j").applyInPandas(_search_group(least), "a bigint, b bigint")
    return scratch.put(f"links{tag}", found.distinct())


def _audit(vecs: DataFrame, links: DataFrame, least: float, n: int) -> dict[str | None, float]:
    """The labels in which ``links`` hold less than RECALL of the true links of some AUDIT vectors (by hash) each that have any, with that mean share; under None the least of all labels.

    Every label is audited, however many there are: its audited vectors meet its others in cuts of AUDIT_ROWS, so the work grows with the vectors.
    """
    size = vecs.groupBy("label").agg(F.count("*").alias("in_label")).withColumn("cuts", F.ceil(F.col("in_label") / AUDIT_ROWS).cast("int"))
    rows = vecs.join(C.maybe_broadcast(size, n // 2), "label")
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(1 << 40)) < F.lit(float(1 << 40)) * AUDIT / F.col("in_label")
    asked = rows.where(drawn).select(F.col("label").alias("of"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.col("vec_id").alias("v"), F.col("vec").alias("x"))
    every = rows.select("label", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("cuts")).cast("int").alias("cut"), "vec_id", "vec")

    def run(q: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(pdf):
            return pd.DataFrame({"label": [], "v": [], "a": [], "b": []})
        wide = max(*map(len, q.x), *map(len, pdf.vec)) // 8
        i, j = np.nonzero(matrix(q.x.tolist(), "<f8", wide) @ matrix(pdf.vec.tolist(), "<f8", wide).T >= least)
        v, w = q.v.to_numpy()[i], pdf.vec_id.to_numpy()[j]
        return pd.DataFrame({"label": q.of.iloc[0], "v": v, "a": np.minimum(v, w), "b": np.maximum(v, w)})[v != w]

    true = asked.groupBy("of", "cut").cogroup(every.groupBy("label", "cut")).applyInPandas(run, "label string, v bigint, a bigint, b bigint")
    hit = true.join(links.withColumn("hit", F.lit(1)), ["a", "b"], "left").groupBy("label", "v").agg((F.count("hit") / F.count("*")).alias("r"))
    by_label = hit.groupBy("label").agg(F.avg("r").alias("r"))
    found = by_label.groupBy(F.when(F.col("r") < RECALL, F.col("label")).alias("label")).agg(F.min("r").alias("r")).collect()
    return {r.label: r.r for r in found} | ({None: min(r.r for r in found)} if found else {})


def _class_links(vectors: DataFrame, least: float, scratch: C.Scratch | None) -> tuple[DataFrame, DataFrame, DataFrame, float, C.Scratch]:
    """Members (vec_id, label, vec), classes (label, vec, rep, size), links (a, b), a < b, of the classes' reps, the audited recall (the least of a label)."""
    spark = vectors.sparkSession
    scratch = scratch or C.Scratch(spark, "embdedup")
    double = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable()).groupBy("vec_id").agg(F.min(F.struct("label", double.alias("x"))).alias("r")).select("vec_id", "r.label", "r.x")

    def unit(frames):
        for pdf in frames:
            vec, keep = [], []
            for x in pdf.x:
                big = np.abs(x).max()
                v = x / big if big > 0 else x
                norm = math.sqrt(float(v @ v))
                keep.append(norm > 0)
                vec.append((v / norm + 0.0).astype("<f8").tobytes() if norm > 0 else b"")  # -0.0 and 0.0 alike
            yield pdf.assign(vec=vec)[keep][["vec_id", "label", "vec"]]

    members = scratch.put("vecs", rows.mapInPandas(unit, "vec_id bigint, label string, vec binary"))
    classes = scratch.put("classes", members.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")))
    vecs = classes.select(F.col("rep").alias("vec_id"), "label", "vec")
    n = vecs.count()
    links = _links(vecs, OVERLAP, least, scratch, "0")
    recall = _audit(vecs, links, least, n)
    for step, overlap in enumerate((2 * OVERLAP, 0), 1):
        poor = [(k,) for k, r in recall.items() if k is not None and r < RECALL]
        if not poor:
            break
        again = vecs.join(spark.createDataFrame(poor, "label string"), "label", "left_semi").select(*vecs.columns)
        exact = _exact_links(again, overlap, least, scratch, f"-exact{step}")
        links = scratch.put(f"links-exact{step}", links.union(exact).distinct())
        recall = _audit(vecs, links, least, n)
    if any(r < RECALL for r in recall.values()):
        raise RuntimeError(f"recall below {RECALL} after an exact search: {recall}")
    recall = min(recall.values(), default=1.0)
    return members, classes, links, recall, scratch


def _of_members(members: DataFrame, classes: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Every member's vec_id with its class's columns. Members of classes that hold over a task's share of all are cut, and such a class's row is repeated for each cut; nothing else is."""
    key = F.xxhash64("label", "vec")
    rows = members.withColumn("__k", key)
    heavy = C.heavy_keys(rows.select("__k"), "__k", scratch, "members")
    facts = classes.withColumn("__k", key).withColumnsRenamed({"label": "__label", "vec": "__vec"})
    out = C.cut_join(rows, facts, "__k", heavy, F.xxhash64("vec_id"))
    return out.where((F.col("label") == F.col("__label")) & (F.col("vec") == F.col("__vec"))).drop("__k", "__label", "__vec", "label", "vec")


def near_links(vectors: DataFrame, least: float = 0.93, scratch: C.Scratch | None = None) -> tuple[DataFrame, float, C.Scratch]:
    """Links (a, b), a < b, of vectors with equal non-null labels and cosine >= least, and the audited recall."""
    members, classes, links, recall, scratch = _class_links(vectors, least, scratch)
    of = _of_members(members, classes.select("label", "vec", "rep"), scratch).select("vec_id", "rep")
    both = links.union(classes.where("size > 1").select("rep", "rep"))
    pairs = both.join(of.toDF("x", "a"), "a").join(of.toDF("y", "b"), "b").where("a <> b or x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), recall, scratch


def dedup(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept and audit_recall for every row of ``vectors`` (vec_id, embedding, label). Labels may be of any type; they are compared as text.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing and are kept. Rows that
    repeat an id share one result (their least label and vector counts). A row without an id has 0 links, a null component and is kept. An empty table gives no rows.
    """
    members, classes, links, recall, scratch = _class_links(vectors, least, None)
    size = classes.select("rep", "size")
    ends = links.union(links.select("b", "a")).join(size.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("others"))
    comp = connected_components(links, scratch, "cc")
    low = comp.groupBy("root").agg(F.min("node").alias("component_id"))
    comp = comp.join(low, "root").select(F.col("node").alias("rep"), "component_id")
    facts = classes.join(ends, "rep", "left").join(comp, "rep", "left")
    n_links = F.coalesce("others", F.lit(0)) + F.col("size") - 1
    facts = facts.select("label", "vec", "size", n_links.alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    of = _of_members(members, scratch.put("facts", facts.drop("size")), scratch)
    out = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id")).join(of, "vec_id", "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"), F.lit(recall).alias("audit_recall"))
