import contextlib
import io
import random

import numpy as np
import pyarrow as pa
import pytest

from lorespark.functions import minhash as M
from lorespark.operators import dedup, near


def _long_texts(n):
    """Long texts of one vocabulary: most share bands of places, few are near."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    base = [[r.choice(words) for _ in range(r.choice((60, 300)))] for _ in range(n // 3)]
    return [" ".join(w if r.random() < keep else r.choice(words) for w in b) for b in base for keep in (1.0, 0.9, 0.5)]


@pytest.mark.parametrize("crowd", [7, 1 << 14])
def test_texts_that_share_places_meet_without_candidate_pairs(spark, monkeypatch, crowd):
    texts = _long_texts(90)
    mem = spark.createDataFrame([(i, t, "pq"[i % 7 == 0]) for i, t in enumerate(texts)], "id bigint, content string, project string")
    monkeypatch.setattr(dedup, "CROWD", crowd)
    got = dedup.near_pairs(mem)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        got.explain()
    assert "band" not in plan.getvalue()
    sig = [M.signature(t) for t in texts]
    want = {(i, j): (sig[i] == sig[j]).sum() / 64 for j in range(90) for i in range(j) if (i % 7 == 0) == (j % 7 == 0) and (sig[i] == sig[j]).sum() >= 45 and max(len(texts[i]), len(texts[j])) <= 3 * min(len(texts[i]), len(texts[j]))}
    assert {(r.a, r.b): r.sim for r in got.collect()} == want and len(want) > 20
    links = dedup.near_links(mem)
    assert sorted(map(tuple, dedup.components(links).collect())) == sorted(map(tuple, dedup.components(got.select("a", "b")).collect()))


@pytest.mark.parametrize("sides", [1, 2])
def test_blocks_equal_brute_force(monkeypatch, sides):
    r = np.random.default_rng(3)
    monkeypatch.setattr(near, "STRIP", 50)
    monkeypatch.setattr(near, "OUT", 3)
    n = 60
    sig = r.integers(0, 2**31 - 1, (n, 64))
    for i in range(0, n, 2):  # near, at the bound, and below it
        sig[i + 1] = np.where(np.arange(64) < 43 + i // 2 % 5, sig[i], sig[i + 1])
    sig[10:20] = np.where(r.random((10, 64)) < 0.9, sig[8], sig[10:20])
    ids, length, guard = r.permutation(n) + 100, r.choice([10, 29, 31], n), np.repeat([5, 9], n // 2)
    x = r.integers(0, 2, n) if sides == 2 else np.zeros(n, int)
    t = pa.table({"id": ids, "n": length, "guard": guard, "x": x, "p": np.zeros(n, int), "q": np.full(n, sides - 1), "sig": list(sig.astype(np.int32))})
    same = lambda i, j: guard[i] == guard[j] and (sides == 1 or x[i] != x[j]) and max(length[i], length[j]) <= 3 * min(length[i], length[j]) and (sig[i] == sig[j]).sum() >= 45
    want = sorted((min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(n) for j in range(i) if same(i, j))
    out = [b for b in near.pairs(45)(iter(t.to_batches()))]
    assert sorted((a, b) for o in out for a, b in zip(o["a"].to_pylist(), o["b"].to_pylist(), strict=True)) == want and len(want) > 10 and len(out) > 2

    def components(links):
        root = {i: i for i in ids}
        for _ in ids:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    stars = pa.Table.from_batches(list(near.links(45)(iter(t.to_batches()))))
    links = list(zip(stars["a"].to_pylist(), stars["b"].to_pylist(), strict=True))
    assert components(links) == components(want) and len(links) < n
