"""Read-side supply: gate, structural support, ordered drops, greedy choice under limit, quota and budget, with a full trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Scores of support, and the defaults of choice.
IDENTIFIER, DEEP, SUBJECT, MULTI, MULTI_STEP, PRECISE, BROAD_ONLY = 3.0, 3.0, 1.5, 2.0, 0.25, 1.0, 0.5
LIMIT, BUDGET_CHARS, CONTENT_CHARS, GLOBAL_CAP = 3, 1200, 120, 1


def support(content: Column, query: Column, subject: Column) -> Column:
    """The structural support of a hit with route contributions precise, broad and fuzzy."""
    ids, terms = T.identifiers(query), T.query_terms(query)
    low = F.lower(content)
    all_ids = (F.size(ids) > 0) & F.forall(ids, lambda t: T.contains_ident(low, t))
    routes = sum(((F.col(r) > 0).cast("int") for r in ("precise", "broad", "fuzzy")), F.lit(0))
    covered = T.term_coverage(content, terms)
    weak = (F.col("broad") > 0) & (F.col("fuzzy") == 0) & (covered >= 3) & (covered * 3 >= F.size(terms))
    worth = lambda c, v: F.when(c, v).otherwise(F.lit(0.0))
    multi = F.when(routes >= 2, MULTI + MULTI_STEP * (routes - 2)).otherwise(0.0)
    return worth(all_ids, IDENTIFIER) + worth(T.wants_deep(query), DEEP) + worth(F.coalesce(subject, F.lit(False)), SUBJECT) + multi + F.when(F.col("precise") > 0, PRECISE).when(weak, BROAD_ONLY).otherwise(0.0)


def overfetch(limit: int) -> int:
    """How many hits a search fetches to choose ``limit`` from: 24 for up to six, else four times as many."""
    return max(24, 4 * limit) if limit <= 6 else 4 * limit


def fallback_provenance(project: Column, precise: Column | None = None, broad: Column | None = None, fuzzy: Column | None = None) -> Column:
    """Where a hit without evidence comes from: the letters of its routes (p+b+f), else its scope."""
    where = F.when(project == "", "global").otherwise(F.concat(F.lit("project:"), project))
    if precise is None:
        return where
    routes = F.array_join(F.array_compact(F.array(F.when(precise > 0, "p"), F.when(broad > 0, "b"), F.when(fuzzy > 0, "f"))), "+")
    return F.when(routes != "", routes).otherwise(where)


def signals_json(precise: Column, broad: Column, fuzzy: Column) -> Column:
    """The routes' contributions as JSON; those of 0 are left out."""
    some = lambda c, name: F.when(c != 0, c).alias(name)
    return F.to_json(F.struct(some(precise, "precise"), some(broad, "broad"), some(fuzzy, "fuzzy")))


def line(content: Column, kind: Column, id_: Column, where: Column, weak: Column) -> Column:
    where = F.when(F.trim(where) != "", F.concat(F.lit(" · "), where)).otherwise("")
    return F.concat(F.lit("- ["), kind, F.lit("] mem:"), F.substring(id_.cast("string"), 1, 8), F.lit(" "), T.one_line(content, CONTENT_CHARS), F.when(weak, "（弱相关）").otherwise(""), where, F.lit("\n"))


def supply(hits: DataFrame, limit: int = LIMIT, budget: int = BUDGET_CHARS, scope: str = "current") -> DataFrame:
    """The trace: every pooled hit with score, drop_reason ('' if chosen), injection_rank (0 if not) and its line; and skipped queries as one row.

    hits: qid, query, q_project, id, rank, score, content, kind, project, precise, broad, fuzzy, subject, noted and, where evidence is known, provenance (its line, else null). A query
    has at most a pool of hits, so its choice is an ordered fold over them.
    """
    known = F.col("provenance") if "provenance" in hits.columns else F.lit(None).cast("string")
    prov = F.coalesce(F.when(F.trim(known) != "", known), fallback_provenance(F.col("project"), F.col("precise"), F.col("broad"), F.col("fuzzy")))
    hits = hits.withColumn("provenance", prov)
    h = hits.withColumn("gate", T.query_gate(F.col("query"))).withColumn("support", support(F.col("content"), F.col("query"), F.col("subject")))
    cls = F.when(F.col("project") == "", "global").when(F.col("project") == F.col("q_project"), "project").otherwise("cross")
    h = h.withColumn("cls", cls).withColumn("norm", T.normalize(F.col("content")))
    early = F.when(F.col("gate") != "run", "gate").when(F.col("support") <= 0, "unsupported").when(F.col("noted"), "notes")
    h = h.withColumn("early", early).withColumn("foreign", (F.col("cls") == "cross") & F.lit(scope != "all"))
    # a text counts as seen only once a row with it is eligible: equal texts of a foreign project do not hide later ones
    ok = F.col("early").isNull() & ~F.col("foreign")
    seen = F.max(ok.cast("int")).over(Window.partitionBy("qid", "norm").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, -1))
    h = h.withColumn("drop", F.coalesce(F.col("early"), F.when(F.coalesce(seen, F.lit(0)) == 1, "duplicate_content"), F.when(F.col("foreign"), "cross_project"), F.lit("")))
    weak = (F.col("broad") > 0) & (F.col("precise") == 0) & (F.col("fuzzy") == 0)
    h = h.withColumn("line", line(F.col("content"), F.col("kind"), F.col("id"), F.col("provenance"), weak)).withColumn("cost", F.length("line"))
    row = F.struct((-F.col("support")).alias("s"), (-F.col("score")).alias("f"), "rank", "id", "cls", "cost")
    pool = h.where("drop = ''").groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("pool"))
    got = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(0).alias("globals"), F.array().cast("array<struct<id:bigint,place:int,why:string>>").alias("out"))

    def step(s, r):
        full, quota, dear = s["n"] >= limit, (r["cls"] == "global") & (s["globals"] >= GLOBAL_CAP), s["used"] + r["cost"] > budget
        why = F.when(full, "limit").when(quota, "scope_quota").when(dear, "budget").otherwise("")
        take = why == ""
        one = F.struct(r["id"].cast("bigint").alias("id"), F.when(take, s["n"] + 1).otherwise(0).alias("place"), why.alias("why"))
        return F.struct(F.when(take, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(take, s["used"] + r["cost"]).otherwise(s["used"]).alias("used"), F.when(take & (r["cls"] == "global"), s["globals"] + 1).otherwise(s["globals"]).alias("globals"), F.concat(s["out"], F.array(one)).alias("out"))

    chosen = pool.select("qid", F.explode(F.aggregate("pool", got, step)["out"]).alias("o")).select("qid", "o.*")
    out = h.join(chosen, ["qid", "id"], "left")
    return out.select("qid", "id", "rank", F.col("support").alias("support"), F.coalesce(F.when(F.col("drop") != "", F.col("drop")), F.col("why"), F.lit("")).alias("drop_reason"), F.coalesce("place", F.lit(0)).alias("injection_rank"), "provenance", "line")


def outcomes(trace: DataFrame, queries: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(qid, outcome): injected, abstained_low_quality, abstained_no_hit or skipped_gate; error for the queries in ``failed`` (qid), whose search broke. Queries with a true column ``explicit`` pass the gate."""
    t = trace.groupBy("qid").agg(F.max("injection_rank").alias("n"))
    gate = T.query_gate(F.col("query"), F.col("explicit") if "explicit" in queries.columns else None)
    out = queries.join(t, "qid", "left").withColumn("gate", gate)
    broken = F.lit(False)
    if failed is not None:
        out, broken = out.join(failed.select("qid", F.lit(True).alias("broken")).distinct(), "qid", "left"), F.coalesce("broken", F.lit(False))
    return out.select("qid", F.when(~F.col("gate").isin("run", "explicit"), "skipped_gate").when(broken, "error").when(F.col("n").isNull(), "abstained_no_hit").when(F.col("n") > 0, "injected").otherwise("abstained_low_quality").alias("outcome"))


def traces(trace: DataFrame, queries: DataFrame) -> DataFrame:
    """The head of each query's trace: (qid, raw_hits, qualified, injected, outcome)."""
    n = trace.groupBy("qid").agg(F.count("*").alias("raw_hits"), F.count_if(F.col("drop_reason").isin("", "limit", "scope_quota", "budget")).alias("qualified"), F.count_if(F.col("injection_rank") > 0).alias("injected"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return outcomes(trace, queries).join(n, "qid", "left").select("qid", zero("raw_hits"), zero("qualified"), zero("injected"), "outcome")


def metrics(trace: DataFrame, expected: DataFrame) -> DataFrame:
    """(supply_rate, precision, abstain_rate): of queries that have something relevant, the share that got some of it; of injected hits, the share that is relevant; of the other queries,
    the share that got nothing. expected: qid, and id of a relevant memory, or null where there is none."""
    got = trace.where("injection_rank > 0").select("qid", "id")
    # injected hits are a few a query, and go to what is expected before that is made distinct
    want = expected.where("id is not null").select("qid", "id").join(F.broadcast(got), ["qid", "id"], "left_semi").distinct()
    good = got.join(want, ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("good"))
    per = expected.groupBy("qid").agg(F.count("id").alias("n")).join(got.groupBy("qid").agg(F.count("*").alias("injected")), "qid", "left").join(good, "qid", "left")
    has = F.col("n") > 0
    return per.agg(F.avg(F.when(has, (F.coalesce("good", F.lit(0)) > 0).cast("double"))).alias("supply_rate"), (F.sum("good") / F.sum("injected")).alias("precision"), F.avg(F.when(~has, F.col("injected").isNull().cast("double"))).alias("abstain_rate"))


def notes(mem: DataFrame, budget: int = 2048) -> DataFrame:
    """Hard rules (rules, and global rows of salience 0.8 or more) by project, content and id, up to the first that breaks the budget.

    The running sum is kept per block of rows first; only block sums meet in one place.
    """
    hard = mem.where((F.col("kind") == "rule") | ((F.col("project") == "") & (F.col("salience") >= 0.8))).select("project", "content", "id", (F.length("content") + 1).alias("cost"))
    # no more than budget rows can fit, since each costs at least one
    first = hard.orderBy("project", "content", "id").limit(budget)
    w = Window.orderBy("project", "content", "id").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("total", F.sum("cost").over(w)).where(F.col("total") <= budget).drop("total")
