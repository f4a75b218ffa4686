"""Signatures of one guard held against each other block by block: what the tasks of ``dedup`` run. A block pair is all that a task holds, and no candidate pair is ever written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells (bytes) of a strip of rows x columns, pairs verified at a time, rows of an output batch.
STRIP, VERIFIED, OUT = 1 << 17, 1 << 14, 1 << 16
RATIO = 3


def _groups(batches: Iterator[pa.RecordBatch]):
    """(ids, lengths, signatures, sketches) of the left rows and of the right ones (None: the same rows), guard by guard. A sketch has a byte of each place: equal places have equal bytes."""
    t = pa.Table.from_batches(list(batches))
    if not t.num_rows:
        return
    ids, n, guard, x, p, q = (t[c].to_numpy() for c in ("id", "n", "guard", "x", "p", "q"))
    sig = t["sig"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    sketch = (sig.astype(np.uint32) * np.uint32(2654435769) >> np.uint32(24)).astype(np.uint8)
    order = np.argsort(guard, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(guard[order])) + 1):
        sides = [rows] if p[rows[0]] == q[rows[0]] else [rows[x[rows] == p[rows[0]]], rows[x[rows] == q[rows[0]]]]
        left, right = (tuple(c[s] for c in (ids, n, sig, sketch)) for s in (sides[0], sides[-1]))
        yield left, right if len(sides) == 2 else None


def _strips(left: tuple, right: tuple | None, need: int):
    """(i, j): rows whose sketches agree in ``need`` places and whose lengths are near, a strip of left rows at a time. Sketches agree wherever signatures do, so no pair is lost."""
    (_, n, _, a), (_, m, _, b) = left, right or left
    cols = np.ascontiguousarray(b.T)
    at = 0
    while at < len(a):
        first = at if right is None else 0
        width = len(b) - first
        rows = a[at : at + max(1, STRIP // max(1, width))]
        same, eq = np.zeros((len(rows), width), np.uint8), np.empty((len(rows), width), bool)
        for k in range(a.shape[1]):
            np.equal(rows[:, k, None], cols[None, k, first:], out=eq)
            np.add(same, eq.view(np.uint8), out=same)
        i, j = np.nonzero(same >= need)
        i, j = i + at, j + first
        ok = np.maximum(n[i], m[j]) <= RATIO * np.minimum(n[i], m[j])
        if right is None:
            ok &= i < j
        yield i[ok], j[ok]
        at += len(rows)


def _agree(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many places the signatures of each pair agree."""
    parts = [(a[i[s : s + VERIFIED]] == b[j[s : s + VERIFIED]]).sum(axis=1) for s in range(0, len(i), VERIFIED)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def pairs(need: int):
    """(a, b, sim), a < b, of every pair whose signatures agree in ``need`` places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            a, b, sim = (np.concatenate(c) for c in zip(*held, strict=True)) if held else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sim)], names=["a", "b", "sim"])

        for left, right in _groups(batches):
            other = right or left
            for i, j in _strips(left, right, need):
                same = _agree(left[2], other[2], i, j)
                ok = same >= need
                held.append((left[0][i[ok]], other[0][j[ok]], same[ok] / left[2].shape[1]))
                size += int(ok.sum())
                if size >= OUT:
                    yield out()
                    held, size = [], 0
        yield out()

    return run


def links(need: int):
    """(a, b), a < b, a the least: a star of links for each component of the pairs of ``pairs`` in a block pair. Pairs that one component holds already are not verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros((2, 0), np.int64)]
        for left, right in _groups(batches):
            other, base = right or left, len(left[0]) if right else 0
            ids = np.concatenate([left[0], right[0]]) if right else left[0]
            root = np.arange(len(ids))
            for i, j in _strips(left, right, need):
                new = root[i] != root[j + base]
                i, j = i[new], j[new]
                ok = _agree(left[2], other[2], i, j) >= need
                i, j = i[ok], j[ok] + base
                for row in np.unique(i):
                    meet = np.unique(root[np.append(j[i == row], row)])
                    if len(meet) > 1:
                        to = np.arange(len(ids))
                        to[meet] = meet[0]
                        root = to[root]
            low = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(low, root, ids)
            found.append(np.stack([low[root], ids])[:, low[root] != ids])
        a, b = np.concatenate(found, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run
