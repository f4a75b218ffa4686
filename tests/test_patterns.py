import random

from pyspark.sql import functions as F

from lorespark.functions import patterns
from lorespark.operators import evaluation, ranking, retrieval


def test_holding_equals_trying_all_pairs(spark, monkeypatch):
    r = random.Random(2)
    texts = [(i, "".join(r.choice("ab é") for _ in range(r.randrange(0, 40)))) for i in range(80)] + [(80, None), (81, ""), (82, "日本😀a")]
    found = [(f"p{i}", "".join(r.choice("ab é") for _ in range(r.randrange(1, 4)))) for i in range(30)] + [("twice", "ab"), ("more", "ab"), ("none", None), ("all", ""), ("wide", "本😀")]
    t, p = spark.createDataFrame(texts, "id int, text string").repartition(3), spark.createDataFrame(found, "pid string, pattern string")
    want = sorted((i, k) for i, x in texts for k, y in found if x is not None and y is not None and y in x)
    for size in (1, 10**6):
        monkeypatch.setattr(patterns, "BLOCK_CHARS", size)
        assert sorted((q.id, q.pid) for q in patterns.holding(t, "text", p, "pattern").collect()) == want
    assert patterns.holding(t, "text", p.where("false"), "pattern").count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pair_of_rows_is_tried(spark, monkeypatch):
    """Prefixes, aliases and phrases are found without nested loops, whatever Spark could broadcast."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    ids = spark.createDataFrame([(x,) for x in ("abc", "abd", "ab", "x1", "a")], "id string")
    got = retrieval.resolve_prefix(ids, spark.createDataFrame([("ab",), ("abc",), ("x",), ("z",), ("",), ("abcd",)], "prefix string"))
    assert {r.prefix: (r.n, r.id, r.state) for r in got.collect()} == {"ab": (3, "ab", "exact"), "abc": (1, "abc", "exact"), "x": (1, "x1", "unique"), "z": (0, None, "none"), "": (5, None, "ambiguous"), "abcd": (0, None, "none")}
    asked = spark.createDataFrame([(1, "Deploy K8S now", "p"), (2, "the db", "q"), (3, "nothing", "p")], "qid int, query string, project string")
    syn = spark.createDataFrame([("", "k8s", "kubernetes"), ("p", "deploy", "release"), ("q", "now", "today"), ("", "db", "DB")], "project string, alias string, standard string")
    more = retrieval.expand(asked, syn)
    assert {r.qid: r.query for r in more.collect()} == {1: "Deploy K8S now kubernetes release", 2: "the db", 3: "nothing"}
    score = evaluation.write_eval(spark.createDataFrame([(1, "one,"), (2, "two")], "id int, content string"), spark.createDataFrame([("on",), ("ne",), ("zz",)], "phrase string"))
    assert tuple(score.first()) == (2, 1, 3.5, 1, 1)
    for df in (got, more):
        df.collect()
        assert "NestedLoop" not in plan(df) and "CartesianProduct" not in plan(df)


def test_long_queries_go_in_smaller_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1} common") for i in range(60)], "id int, content string")
    queries = spark.createDataFrame([(i, " ".join(f"w{(i + k) % 70}" for k in range(20))) for i in range(12)], "qid int, query string")
    want = sorted((r.qid, r.id, r.bm25) for r in retrieval.ranked(docs, queries, 5).collect())
    blocks = []
    monkeypatch.setattr(ranking, "CELLS", 64)
    real = retrieval._query_blocks
    monkeypatch.setattr(retrieval, "_query_blocks", lambda *a: blocks.append(1) or real(*a))
    best = lambda rows: {q: sorted((b, i) for k, i, b in rows if k == q)[:5] for q, _, _ in rows}
    got = sorted((r.qid, r.id, r.bm25) for r in retrieval.ranked(docs, queries, 5).collect())
    assert best(got) == best(want) and len(list(real(queries.select("qid", F.split("query", " ").alias("p")), F.size("p")))) > 5
