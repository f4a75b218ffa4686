import os
import random

from lorespark.streaming import arrival


def rows(df):
    return sorted(tuple(r[c] for c in ("ord", "kind", "source_id", "generation", "seq", "state")) for r in df.collect())


def log(seed=3, n=240):
    """Events of three sources with gaps, repeats, other generations, blank uids and places, issues and rotations."""
    r, out = random.Random(seed), []
    for i in range(n):
        s = r.choice("abc")
        kind = r.choices(["event", "issue", "rotate"], [8, 2, 1])[0]
        g, last, _ = by_hand(out)[1].get(s, (1, 0, 0))
        if kind == "event":
            seq = last + 1 if r.random() < 0.8 else r.randrange(-1, 6)
            uid = r.choice(["", None, f"u{i}", f"u{i}", f"u{r.randrange(n)}"])
            source = s if r.random() < 0.9 else r.choice(["", None])
            out.append((i, kind, uid, source, g if r.random() < 0.95 else g + 1, seq))
        else:
            out.append((i, kind, None, s, g, last if r.random() < 0.8 else last + 1))
    return out


def by_hand(data):
    seen, at, out = set(), {}, []
    for i, kind, uid, s, g, n in sorted(data):
        if kind == "event" and uid:
            if uid in seen:
                out.append((i, kind, s, g, n, "known"))
                continue
            seen.add(uid)
        if not s or kind == "event" and n < 1:
            out.append((i, kind, s, g, n, "accepted" if kind == "event" else "refused"))
            continue
        gen, last, cur = at.get(s, (1, 0, 0))
        if kind == "rotate":
            state = "done" if cur >= last else "refused"
            gen, last, cur = (gen + 1, 0, 0) if state == "done" else (gen, last, cur)
        elif kind == "issue":
            state = "issued" if g == gen and cur <= n <= last else "refused"
            cur = n if state == "issued" else cur
        else:
            state = "generation" if g != gen else "accepted" if n == last + 1 else "gap"
            last += state == "accepted"
        at[s] = gen, last, cur
        out.append((i, kind, s, g, n, state))
    return sorted(out, key=lambda r: r[0]), at


def test_batch_equals_one_by_one(spark):
    data = log()
    got = rows(arrival.captured_batch(spark.createDataFrame(data, arrival.INPUT).repartition(5)))
    want = by_hand(data)[0]
    assert got == want and {r[-1] for r in want} == {"known", "accepted", "gap", "generation", "done", "refused", "issued"}


def test_stream_equals_batch_however_it_is_cut(spark, tmp_path):
    """Batches, a stop between them, and rotation accepted and refused; the state of the sources does not grow."""
    data = log(5, 200)
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    size = []
    for a in range(0, 200, 50):
        spark.createDataFrame(data[a : a + 50], arrival.INPUT).coalesce(1).write.mode("append").parquet(src)
        take = arrival.capture_stream(spark.readStream.schema(arrival.INPUT).parquet(src), str(tmp_path / "out"), cp)
        take()
        q = spark.read.format("statestore").option("path", f"{cp}/ledger").option("stateVarName", "at").load()
        size.append(q.count())
    take()  # nothing new
    got = rows(spark.read.schema(arrival.OUTPUT).parquet(str(tmp_path / "out" / "ledger")))
    assert got == by_hand(data)[0] and size[-1] == 3 and os.path.isdir(cp)
