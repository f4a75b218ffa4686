import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorespark.operators import index, retrieval
from lorespark.operators.index import Index


def _found(block, docs):
    """What a search sends on of one segment of two shards, documents as lists of terms."""
    rows = []
    for shard in (0, 1):
        mine = pa.table({"shard": pa.array([shard] * len(docs), pa.int32()), "id": list(range(len(docs))), "plain": pa.array(["" if "été" in d else " ".join(d) for d in docs]), "terms": pa.array([d if "été" in d else None for d in docs], pa.list_(pa.string()))})
        t = index._invert(None, mine)
        rows.append(t.filter(pa.compute.is_valid(t.column("term"))))
    t = pa.concat_tables(rows).append_column("seq", pa.array([3] * sum(r.num_rows for r in rows), pa.int32())).combine_chunks()
    return pa.Table.from_batches(list(index._asked_for(block)(t.to_batches())))


def test_a_word_of_very_many_terms_is_one_row_a_shard():
    block = index.Words()
    block.add("a", [(0, "w", True), (1, "w7", True), (2, "w7", False), (3, "rare", False), (4, "é", True)])
    docs = [[f"w{i % 97}" for i in range(d, d + 40)] + ["rare"] * (d == 5) + ["été"] for d in range(150)]
    got = _found(block, docs)
    assert got.num_rows == 2 * 5  # before: a row a block of a term
    for r in got.to_pylist():
        (w,), place, count = r["words"], np.frombuffer(r["places"], "<u4"), np.frombuffer(r["counts"], "<u4")
        term, prefix = block.words[w]
        want = {d: n for d, ts in enumerate(docs) if (n := sum(t.startswith(term) if prefix else t == term for t in ts))}
        assert r["seq"] == 3 and dict(zip(place.tolist(), count.tolist(), strict=True)) == want


@pytest.mark.parametrize("cells", [None, 64])
def test_tables_of_few_cells_give_the_same(spark, tmp_path, monkeypatch, cells):
    """Queries and scores go through tables of CELLS cells, ADDED scores at a time; a segment whose documents were all written again is not read."""
    if cells:  # set here, where tasks do not see it: the reducer is called by itself below
        monkeypatch.setattr(index, "CELLS", cells)
        monkeypatch.setattr(index, "ADDED", 7)
    block = index.Words()
    asked = [[(0, "w1", True), (1, "rare", False)], [(0, "w", True), (0, "rare", False)], [(0, "w2", False), (1, "w2", False), (2, "w", True)], [(0, "none", True)]]
    for q, p in enumerate(asked):
        block.add(q, p)
    docs = [[f"w{(i * i) % 31}" for i in range(d, d + 9)] + ["rare"] * (d % 11 == 5) for d in range(90)]
    found = _found(block, docs)
    found = found.filter(pa.compute.equal(found.column("shard"), 0))
    known = pa.table({"place": pa.array(range(90), pa.int32()), "id": pa.array(range(90), pa.int64()), "len": pa.array(list(map(len, docs)), pa.int32()), "ok": [d % 4 > 0 for d in range(90)]})
    idf = np.array([1.5, 3.0, 0.2, 2.0, 4.0])[: len(block.words)]
    for n in (None, 3):
        got = {}
        for r in index._score(block, idf, 9.5, n, 0, pa.int64())(found, known).to_pylist():
            got.setdefault(r["qid"], []).append((r["bm25"], r["id"], r["whole"]))
        for q, p in enumerate(asked):
            want = []
            for d in (d for d in range(90) if d % 4):
                f = {(t, pre): sum(x.startswith(t) if pre else x == t for x in docs[d]) for _, t, pre in p}
                norm = 1.2 * (0.25 + 0.75 * len(docs[d]) / 9.5)
                score = sum(idf[block.words.index((t, pre))] * f[t, pre] * 2.2 / (f[t, pre] + norm) for _, t, pre in p)
                whole = any(all(f[t, pre] for k, t, pre in p if k == g) for g in {k for k, _, _ in p})
                want += [(-round(score, 9), d, int(whole))] if score else []
            keep = want if n is None else sorted({*sorted(want)[:n], *sorted(x for x in want if x[2])[:n]})
            assert [(round(a, 7), i, w) for a, i, w in sorted(got.get(q, []))] == [(round(a, 7), i, w) for a, i, w in sorted(keep)]


def test_a_segment_without_live_documents_is_not_read(spark, tmp_path, monkeypatch):
    rows = spark.range(60).select("id", F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), F.col("id").cast("string"))).alias("content"))
    queries = spark.createDataFrame([(1, "all w1"), (2, "w59")], "qid long, query string")
    out = Index(spark, str(tmp_path / "index"))
    out.append(rows.withColumn("content", F.lit("all draft")))
    out.append(rows)
    read, real = [], Index._union
    monkeypatch.setattr(Index, "_union", lambda self, segments: read.append([s["seq"] for s in segments]) or real(self, segments))
    key = lambda df: sorted((r.qid, r.id, round(r.bm25, 9), r.whole) for r in df.collect())
    assert key(out.search(queries)) == key(retrieval.ranked(rows, queries))
    assert read == [[1, 2], [2]]


def test_terms_are_cut_as_the_jvm_cuts_them(spark, tmp_path):
    """Plain texts are cut by bytes, others by the pattern: the index has the terms of ``index_terms``, text by text."""
    odd = ["", "Plain words, 2nd TRY_again", "x", "Crème brûlée – déjà vu", "“quoted” — dash…", "naïve İstanbul ﬁne ½ ² Ⅷ", "日本語 and 〇 々", "ΑΒΓ abc", "a\u0301b\u0308c", "tab\tnew\nline\u2028sep\u0085x", "٣٤ 12", "x🙂y", "ß ẞ Straße", "end9", "9start", "K\u212A \u017fharp", "ÉCOLE Ǆ Ÿ€5 ™ x\u0345y ª º µ", "\u0301", "end\u0301", "\u0301start ŁÓDŹ", "ÅNGSTRÖM ệ Ệ", "nul\0nul", "٠१", "²³¹ ½"] + ["".join(chr(i) + "a" * (i % 3 == 0) for i in range(k, k + 64) if not 0xD800 <= i < 0xE000) for k in range(0, 0x3100, 64)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "id long, content string")
    out = Index(spark, str(tmp_path / "index"))
    out.append(rows)
    terms = {r.id: r.t for r in rows.select("id", index.T.index_terms(F.col("content")).alias("t")).collect()}
    (segment,) = out.manifest()["segments"]
    got = {}
    table = out._segment(segment["name"]).collect()
    (docs,) = (np.frombuffer(r.places, "<i8") for r in table if r.term is None)
    for r in table:
        for place, n in zip(np.frombuffer(r.places, "<u4"), np.frombuffer(r.counts, "<u4"), strict=True) if r.term is not None else ():
            got.setdefault(int(docs[place]), []).extend([r.term] * int(n))
    assert {i: sorted(t) for i, t in terms.items() if t} == {i: sorted(t) for i, t in got.items()}
    assert {r.id: r.len for r in out.live().collect()} == {i: len(t) for i, t in terms.items()}
    plain = [r.id for r in rows.select("id", index.T.plain(F.col("content")).alias("p")).where("p is not null").collect()]
    assert {0, 1, 2, 3, 4, 13, 14} <= set(plain) and 7 not in plain and 6 not in plain
