from pyspark.sql import functions as F

from lorespark.operators import context

MEM = "id bigint, content string, kind string, project string, salience double, last_seen_at bigint, updated_at bigint, expires_at bigint, superseded_by bigint"


def test_the_whole_text_keeps_its_fixed_parts(spark):
    row = lambda i, text, kind, project: (i, text, kind, project, 1.0 - i / 100, 5, 5, None, None)
    mem = spark.createDataFrame([row(1, "Never push to main", "rule", ""), row(2, "Uses tabs", "preference", ""), row(3, "Likes tea", "fact", ""), row(4, "Port 80 is taken", "pitfall", "p"), row(5, "x" * 100, "fact", "p")], MEM)
    projects = spark.createDataFrame([("p",), ("q",), ("",)], "project string")
    pending = spark.createDataFrame([("p", 3), ("q", 0)], "project string, pending int")
    pool = context.opening_pool(mem, projects, 10, 2)
    hint = "Ask for more with: search\n"
    go = lambda chars: context.session_start(pool, projects, pending, 2, chars, hint=hint)
    texts, traces, items = go(900)
    t = {r.project: r.text for r in texts.collect()}
    assert t["p"].startswith("[memory] project: p\n" + context.code_table() + "[待裁决] 本工程 3 条") and t["p"].endswith(hint) and len(t["p"]) <= 900
    assert t["q"].startswith("[memory] project: q\n" + context.code_table() + context.SECTIONS[0][1] + "：\n- [rule] mem:1 Never push") and "待裁决" not in t["q"] and "Port 80" not in t["q"]
    assert t[""].startswith("[memory] project: (global)\n")
    order = [t["p"].index(x) for x in ("Never push", "Uses tabs", "Port 80", "xxx")]
    assert order == sorted(order) and "Likes tea" not in t["p"]  # one other global memory
    assert {r.project: (r.raw_hits, r.injected, r.outcome, r.gate_reason) for r in traces.collect()} == {"p": (5, 4, "injected", "session_start"), "q": (3, 2, "injected", "session_start"), "": (3, 2, "injected", "session_start")}
    assert {r.match_class for r in items.collect()} == {"hard_rule", "global", "project"}
    fixed = len("[memory] project: p\n") + len(context.code_table()) + len(hint)
    small = {r.project: r.text for r in go(fixed + 3)[0].collect()}
    assert small["p"] == "[memory] project: p\n" + context.code_table() + hint  # no line of pending candidates, no section
    assert {r.outcome for r in go(fixed + 3)[1].where("project = 'p'").collect()} == {"abstained_low_quality"}
    none = context.session_start(pool.where("false"), projects, pending, 2, 900, event="pre_compact")
    assert {(r.outcome, r.gate_reason) for r in none[1].collect()} == {("abstained_no_hit", "pre_compact")} and none[0].count() == 3
    assert max(len(r.text) for n in (300, 400, 500) for r in go(n)[0].where(F.col("project") == "p").collect() if n >= fixed) <= 500
