"""What a session gets when it starts: hard rules, other global memories, the project's own, each section under its own cap and all under one budget; and which rules it has been given."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import supply
from .retrieval import visible

#: Reasons of opening traces, a kind's code with when to look it up, and the sections (name, title).
OPENING = ("session_start", "pre_compact")
CODES = [("P", "preference", "涉及用户 / 项目偏好、默认选择、禁用做法时"), ("D", "decision", "要复述「为什么这么定」时"), ("X", "pitfall", "遇到报错、反常现象、曾被坑过的路径时"), ("T", "task", "要确认「上次做到哪 / 还剩什么」时")]
SECTIONS = [("hard_rule", "硬规则（跨工程，务必遵守）"), ("global", "全局记忆"), ("project", "本工程记忆")]
CONTENT_CHARS, LEAST_POOL = 120, 12


def code_table() -> str:
    return "".join(f"{code} {kind} {when}\n" for code, kind, when in CODES)


def notes_text(mem: DataFrame, budget: int = 2048) -> DataFrame:
    """(text): the code table and then the hard rules within the budget, a line each, as one row."""
    lines = supply.notes(mem, budget)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("project", "content", "id"))), lambda r: F.concat(r["content"], F.lit("\n")))
    return lines.agg(F.concat(F.lit(code_table()), F.array_join(rows, "")).alias("text"))


def opening_pool(mem: DataFrame, projects: DataFrame, now: int, limit: int) -> DataFrame:
    """(project, section, place, id, ...) of what each project's session may open with: the best global rules, global memories and own memories, at most four times ``limit`` of each (12 at
    least), each memory in the first section that has it. projects: project ('' for none)."""
    pool = max(LEAST_POOL, 4 * limit)
    order = [F.desc("salience"), F.desc("last_seen_at"), F.desc("updated_at"), F.col("id")]
    live = mem.where(visible(now))
    top = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= pool)
    here = projects.select(F.col("project").alias("for_project")).distinct()
    every = live.where("project = ''")
    # at most ``pool`` global rows of either kind, for each project
    rules = top(every.where("kind = 'rule'"), F.lit(0)).withColumn("section", F.lit(0))
    others = top(every, F.lit(0)).withColumn("section", F.lit(1))
    shared = here.withColumn("all", F.lit(1)).join(F.broadcast(rules.unionByName(others).withColumn("all", F.lit(1))), "all").drop("all")
    own = top(live.where("project <> ''"), "project").withColumn("section", F.lit(2)).join(here, F.col("project") == F.col("for_project"))
    both = shared.unionByName(own)
    both = both.withColumn("n", F.row_number().over(Window.partitionBy("for_project", "id").orderBy("section"))).where("n = 1").drop("n")
    return both.withColumn("place", F.row_number().over(Window.partitionBy("for_project", "section").orderBy("r")))


def render(content: str, kind: str, id_: object, where: str, chars: int = CONTENT_CHARS) -> str:
    """One line of a section, its text folded and cut to ``chars``."""
    flat = " ".join(content.split())
    cut = flat if len(flat) <= chars else flat[:chars] + "…"
    return f"- [{kind}] mem:{str(id_)[:8]} {cut}" + (f" · {where}" if where.strip() else "") + "\n"


def _open_one(limit: int):
    """The sections of one project: at most three pools of rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, rank, out = int(pdf.budget.iloc[0]), 0, []
        for at, (name, title) in enumerate(SECTIONS):
            rows = pdf[pdf.section == at].sort_values("place")
            used, n, cap, first = len(title) + 2, 0, 1 if at == 1 else limit, len(out)
            fits = used <= left
            for r in rows.itertuples():
                line = render(r.content, r.kind, r.id, r.where)
                why = "budget" if not fits else "limit" if n >= cap else "budget" if used + len(line) > left else ""
                if not why:
                    used, n, rank = used + len(line), n + 1, rank + 1
                out.append([r.id, name, 0 if why else rank, why, None if why else line])
            if len(rows) and fits and not n:  # none fits whole: the first, cut to what is left behind the title
                r = next(rows.itertuples())
                for chars in range(CONTENT_CHARS, -1, -1):
                    line = render(r.content, r.kind, r.id, r.where, chars)
                    if used + len(line) <= left:
                        used, n, rank = used + len(line), 1, rank + 1
                        out[first] = [r.id, name, rank, "", line]
                        break
            left -= used if n else 0
        got = pd.DataFrame(out, columns=["id", "section", "injection_rank", "drop_reason", "line"])
        return got.assign(project=pdf.for_project.iloc[0])

    return run


def opening(pool: DataFrame, budget: int, limit: int) -> DataFrame:
    """(project, id, section, injection_rank, drop_reason, line): sections in order, each up to its cap (``limit``; 1 for other global memories) and what is left of the budget.

    A section costs its title and its lines; a line that does not fit is passed over; if none fits, the first is cut until it does. A project has at most three pools of rows, so
    its choice is made in one place. pool: as ``opening_pool`` gives it, with provenance where evidence is known, and with a column budget where it is not the same for all.
    """
    known = F.col("provenance") if "provenance" in pool.columns else F.lit(None).cast("string")
    where = F.coalesce(F.when(F.trim(known) != "", known), supply.fallback_provenance(F.col("project")))
    rows = pool.select("for_project", "section", "place", F.col("id").cast("bigint").alias("id"), "content", "kind", where.alias("where"), (F.col("budget") if "budget" in pool.columns else F.lit(budget)).cast("int").alias("budget"))
    return rows.groupBy("for_project").applyInPandas(_open_one(limit), "project string, id bigint, section string, injection_rank int, drop_reason string, line string")


def pending_line(pending: DataFrame) -> DataFrame:
    """(project, line): how many candidates of a project wait for a decision; none without. pending: project, pending."""
    text = F.concat(F.lit("[待裁决] 本工程 "), F.col("pending").cast("string"), F.lit(" 条 pending 候选（隔离区，不进检索）"))
    return pending.where((F.col("project") != "") & (F.col("pending") > 0)).select("project", text.alias("line"))


def session_start(pool: DataFrame, projects: DataFrame, pending: DataFrame, limit: int, chars: int, head=None, hint: str = "", pending_more: str = "", event: str = "session_start") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a session of each project opens with, as (project, text); the head of its trace (project, query_gate, gate_reason, scope, target_limit, budget_chars, raw_hits, qualified, injected, outcome); and the trace's items.

    The text is the head, the code table, the line of pending candidates, the sections and the hint. All but the sections are reserved from ``chars`` first, so that the budget never cuts them; the line of pending candidates is left out where
    it does not fit beside the others. head: a function from the project Column to a line; pending: project, pending; pending_more ends the line of pending candidates; event: why the session opens. A project without memories has the fixed parts alone.
    """
    own = projects.select("project").distinct()
    head = head or (lambda p: F.concat(F.lit("[memory] project: "), F.when(p == "", "(global)").otherwise(p), F.lit("\n")))
    wait = pending_line(pending).select("project", F.concat("line", F.lit(pending_more + "\n")).alias("wait"))
    fixed = own.join(wait, "project", "left").withColumn("head", head(F.col("project"))).withColumn("wait", F.coalesce("wait", F.lit("")))
    cost = F.length("head") + len(code_table()) + len(hint)
    fixed = fixed.withColumn("wait", F.when(cost + F.length("wait") > chars, "").otherwise(F.col("wait"))).withColumn("budget", F.greatest(F.lit(0), F.lit(chars) - cost - F.length("wait")))
    items = opening(pool.join(fixed.select(F.col("project").alias("for_project"), "budget"), "for_project"), chars, limit)
    titles = F.create_map(*[x for name, title in SECTIONS for x in (F.lit(name), F.lit(title + "：\n"))])
    place = F.create_map(*[x for i, (name, _) in enumerate(SECTIONS) for x in (F.lit(name), F.lit(i))])
    lines = items.where("injection_rank > 0").groupBy("project", "section").agg(F.array_sort(F.collect_list(F.struct("injection_rank", "line"))).alias("ls"))
    block = F.concat(titles[F.col("section")], F.array_join(F.transform("ls", lambda x: x["line"]), ""))
    body = lines.groupBy("project").agg(F.array_sort(F.collect_list(F.struct(place[F.col("section")].alias("at"), block.alias("block")))).alias("bs"))
    text = F.concat("head", F.lit(code_table()), "wait", F.coalesce(F.array_join(F.transform("bs", lambda x: x["block"]), ""), F.lit("")), F.lit(hint))
    texts = fixed.join(body, "project", "left").select("project", text.alias("text"))
    n = items.groupBy("project").agg(F.count("*").alias("raw_hits"), F.count_if(F.col("injection_rank") > 0).alias("injected"))
    told = own.join(n, "project", "left").na.fill(0, ["raw_hits", "injected"])
    outcome = F.when(F.col("injected") > 0, "injected").when(F.col("raw_hits") > 0, "abstained_low_quality").otherwise("abstained_no_hit")
    reason = "pre_compact" if event == "pre_compact" else "session_start"
    traces = told.select("project", F.lit("skip").alias("query_gate"), F.lit(reason).alias("gate_reason"), F.lit("current").alias("scope"), F.lit(limit).alias("target_limit"), F.lit(chars).alias("budget_chars"), "raw_hits", F.col("raw_hits").alias("qualified"), "injected", outcome.alias("outcome"))
    return texts, traces, items.withColumnRenamed("section", "match_class")


def injected_rules(traces: DataFrame, items: DataFrame, mem: DataFrame) -> DataFrame:
    """(session_id, id): rules that a session has really been given when it opened. traces: id, session_id, gate_reason; items: trace_id, memory_id, injection_rank."""
    t = traces.where(F.col("gate_reason").isin(*OPENING) & (F.trim("session_id") != "")).select(F.col("id").alias("trace_id"), "session_id")
    i = items.where("injection_rank > 0").select("trace_id", F.col("memory_id").alias("id"))
    return t.join(i, "trace_id").join(mem.where("kind = 'rule'").select("id"), "id").select("session_id", "id").distinct()


def noted(hits: DataFrame, given: DataFrame) -> DataFrame:
    """``hits`` (session_id, id, kind, ...) with noted: a rule that the session has been given at its start."""
    g = given.select("session_id", "id", F.lit(True).alias("_g")).distinct()
    return hits.join(g, ["session_id", "id"], "left").withColumn("noted", F.coalesce((F.col("kind") == "rule") & F.col("_g"), F.lit(False))).drop("_g")
