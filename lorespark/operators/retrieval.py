"""Full-text retrieval of many queries over many texts: BM25, three routes, weighted rank fusion.

Corpus statistics are over the whole index; filters apply to hits afterwards. Queries are a small table: they go to the texts in blocks of QUERY_BLOCK. A block reads the texts
once and writes down which of its words each holds; document frequencies and scores come from that, and a partition sends on no more than each query's best rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import minhash as M
from ..functions import text as T
from ..functions.patterns import holding
from ..plans.scratch import written
from . import ranking
from .index import Index

#: The fusion constant and route weights, the fuzzy route's bound and size.
RRF, WEIGHTS = 60, {"precise": 1.0, "broad": 0.8, "fuzzy": 0.6}
FUZZY_LEAST, FUZZY_TOP, POOL = 0.4, 40, 4
#: Queries that go to the texts together.
QUERY_BLOCK = 512
LAYERS = {"": "memory", "memory": "memory", "observation": "observation", "recent": "observation", "both": "both", "all": "both"}
BROADCAST_ROWS = 200_000


def visible(now: int) -> Column:
    return (F.col("expires_at").isNull() | (F.col("expires_at") > now)) & F.col("superseded_by").isNull()


def in_scope(scope: str, project: str = "") -> Column:
    """current: the project's and global rows; global; project, and no scope with a project: its own alone; all, and whatever is unknown: no filter."""
    if scope == "global":
        return F.col("project") == ""
    if scope == "project" or (scope == "" and project):
        return F.col("project") == project
    if scope == "current":
        return F.col("project").isin(project, "")
    return F.lit(True)


def with_tags(df: DataFrame, tags: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows that have every wanted tag: one semi join each. tags: (memory_id, key, value)."""
    return reduce(lambda d, kv: d.join(tags.where((F.col("key") == kv[0]) & (F.col("value") == kv[1])).select(F.col("memory_id").alias("id")), "id", "left_semi"), sorted(wanted.items()), df)


def listing(mem: DataFrame, now: int, scope: str = "all", project: str = "", kind: str = "all", limit: int = 10) -> DataFrame:
    out = mem.where(visible(now) & in_scope(scope, project))
    if kind not in ("", "all"):
        out = out.where(F.col("kind") == kind)
    return out.orderBy(F.desc("salience"), F.desc("last_seen_at"), F.desc("updated_at"), "id").limit(limit)


def _query_blocks(queries: DataFrame, phrases: str | None = None):
    """The queries (qid, ...) in blocks of about QUERY_BLOCK, each collected for itself: a query has one row here, texts have none. phrases: the column of a query's phrases; a block's table of queries and different
    words has some ranking.CELLS cells then, so that long queries go in smaller blocks. Each block reads the texts, so words that queries share count once."""
    seen = queries.agg(F.count("*").alias("n"), F.sum(F.size(phrases) if phrases else F.lit(0)).alias("words")).first()
    apart = math.ceil(math.sqrt(seen.n * (seen.words or 0) / ranking.CELLS))
    if apart > 1:
        word = F.explode(F.transform(phrases, lambda p: F.struct(p["term"], p["prefix"])))
        apart = min(apart, math.ceil(seen.n * queries.select(word.alias("w")).distinct().count() / ranking.CELLS))
    blocks = max(1, math.ceil(seen.n / QUERY_BLOCK), apart)
    for b in range(blocks):
        yield queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)


def ranked(docs: DataFrame, queries: DataFrame, n: int | None = None, order: tuple[Column, ...] = (), keep: Column | None = None) -> DataFrame:
    """(qid, id, bm25, whole, order): BM25 (negative, lower is better) of documents with a phrase of the query; whole: a group of it is complete.

    docs: id, content and what ``order`` (numbers, least first; they rank equal scores, then the id) and ``keep`` (the filter on hits; statistics are over all of docs) read. queries:
    qid, query. n: a superset of each query's best ``n``, of all hits and of the whole ones; None: every hit. A word matches every term it begins; a Han run is a group of
    pairs, all of which make it complete.
    """
    terms = docs.select("id", T.index_terms(F.coalesce("content", F.lit(""))).alias("terms"), F.coalesce(keep if keep is not None else F.lit(True), F.lit(False)).alias("ok"), *[c.cast("double").alias(f"o{i}") for i, c in enumerate(order)])
    qid = queries.schema["qid"].dataType
    out = None
    for block in _query_blocks(queries.select("qid", T.query_phrases(F.col("query")).alias("p")), "p"):
        asked = ranking.Asked.of([(r.qid, [(p.grp, p.term, p.prefix) for p in r.p or []]) for r in block.collect()])
        rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in terms.schema.fields if f.name != "terms")
        met = written(terms.mapInArrow(ranking.met(asked), f"{rest}, {ranking.MET}"), "met")
        seen = met.select("len", "words").mapInArrow(ranking.count_words(asked), "word int, df bigint, len bigint").groupBy("word").agg(F.sum("df").alias("df"), F.sum("len").alias("len")).collect()
        df, (docs_n, length) = np.zeros(len(asked.words)), next(((r.df, r.len) for r in seen if r.word < 0), (0, 0))
        for r in seen:
            if r.word >= 0:
                df[r.word] = r.df
        idf = np.log((docs_n - df + 0.5) / (df + 0.5)) if docs_n else np.zeros(len(df))
        idf = np.where(idf <= 0, ranking.LEAST_IDF, idf)
        run = ranking.best_texts(asked, idf, length / docs_n if docs_n and length else 1.0, n, len(order), to_arrow_type(qid))
        hits = met.mapInArrow(run, f"qid {qid.simpleString()}, id bigint, bm25 double, whole int, order array<double>")
        out = hits if out is None else out.unionByName(hits)
    return out


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, bm25, whole) of every hit."""
    return ranked(docs, queries).drop("order")


def top(hits: DataFrame, n: int, *order: Column) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= n)


def fuzzy(docs: DataFrame, queries: DataFrame, least: float = FUZZY_LEAST, n: int = FUZZY_TOP, decayed: Column | None = None) -> DataFrame:
    """(qid, id, sim, decayed, rank): texts whose signature agrees with the query's; queries of under 8 shingles are left out. docs: id, content (or ds, its signature) and what ``decayed`` reads."""
    signed = docs.select("id", "ds" if "ds" in docs.columns else "content", (decayed if decayed is not None else F.lit(0.0)).cast("double").alias("decayed"))
    qid = queries.schema["qid"].dataType
    out = None
    for block in _query_blocks(queries.where(M.n_shingles(F.col("query")) >= M.MIN_SHINGLES)):
        rows = block.select("qid", "query").collect()
        if not rows:  # no text is like a query that is too short
            continue
        sig = np.array([M.signature(r.query) for r in rows], np.int64).reshape(len(rows), M.K)
        run = ranking.alike_texts([r.qid for r in rows], sig, least, n, to_arrow_type(qid))
        hits = signed.mapInArrow(run, f"qid {qid.simpleString()}, id bigint, sim double, decayed double")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"qid {qid.simpleString()}, id bigint, sim double, decayed double")
    return top(out, n, F.desc("sim"), F.col("id"))


def one_term(query: Column) -> Column:
    """Whether the whole query is one Han run of one or two characters: then the broad route repeats the precise one and is skipped."""
    return (F.size(T.query_phrases(query)) == 1) & ~F.element_at(T.query_phrases(query), 1)["prefix"]


def fused(mem: DataFrame, queries: DataFrame, decayed: Column, keep: Column, limit: int = 10, broad: bool = True, alike: bool = True, index: Index | None = None) -> DataFrame:
    """(qid, id, rank, score, exact, routes, precise, broad, fuzzy): weighted reciprocal-rank fusion of the three routes.

    A hit of the precise route (exact) is never overtaken by one of the others; then score, routes, decay, and who was seen first (route by route, each by rank) decide.
    mem: id, content, salience, last_seen_at and what ``decayed`` and ``keep`` (the filter on hits) read. index: a kept index of the contents; mem's are not read then, and rows that it lacks are no hits.
    """
    pool = POOL * limit
    newest = (-decayed, -F.col("salience"), -F.col("last_seen_at"))
    # each route's rows are few and read more than once: texts are scored once
    hits = written(ranked(mem, queries, pool, newest, keep) if index is None else index.search(queries, pool, mem, newest, keep), "hits")
    order = (F.col("bm25"), F.col("order"), F.col("id"))
    single = queries.select("qid", one_term(F.col("query")).alias("single"))
    take = lambda df, name, place, d: df.select("qid", "id", "rank", d.alias("decayed"), F.lit(name).alias("route"), F.lit(place).alias("place"))
    streams = [take(top(hits.where("whole = 1"), pool, *order), "precise", 0, -F.col("order")[0])]
    if broad:
        streams.append(take(top(hits.join(F.broadcast(single) if queries.count() <= BROADCAST_ROWS else single, "qid").where("not single"), pool, *order), "broad", 1, -F.col("order")[0]))
    if alike:
        streams.append(take(fuzzy(mem.where(keep) if index is None else mem.where(keep).join(index.signatures(), "id"), queries, n=min(FUZZY_TOP, pool), decayed=decayed), "fuzzy", 2, F.col("decayed")))
    w = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    all_hits = written(reduce(DataFrame.unionByName, streams).withColumn("w", w[F.col("route")]), "routes")
    active = all_hits.select("qid", "route", "w").distinct().groupBy("qid").agg(F.sum("w").alias("active"))
    part = all_hits.join(active, "qid").withColumn("c", F.col("w") / (RRF + F.col("rank")) / F.col("active"))
    sums = [F.coalesce(F.sum(F.when(F.col("route") == r, F.col("c"))), F.lit(0.0)).alias(r) for r in WEIGHTS]
    out = part.groupBy("qid", "id").agg(F.count("*").alias("routes"), F.max("decayed").alias("decayed"), F.min(F.struct("place", "rank")).alias("first"), *sums)
    out = out.withColumn("score", F.col("precise") + F.col("broad") + F.col("fuzzy")).withColumn("exact", (F.col("precise") > 0).cast("int"))
    out = top(out, limit, F.desc("exact"), F.desc(F.round("score", 12)), F.desc("routes"), F.desc("decayed"), F.col("first"))
    return out.select("qid", "id", "rank", "score", "exact", "routes", *WEIGHTS)


def looked_up(hits: DataFrame, mem: DataFrame, *columns: str) -> DataFrame:
    """Hits (few rows of many) with columns of their memories. Hits are written and go to the memories, so no text is shuffled, and what is computed from a text behind this is computed for hits alone."""
    kept = written(hits, "found")
    return mem.select("id", *columns).join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, "id")


def observation_search(obs: DataFrame, queries: DataFrame, limit: int = 10, scope: str = "all", project: str = "", kind: str = "", tags: dict | None = None) -> DataFrame:
    """Precise hits; a query that has none gets the broad ones. obs: id, summary, event, created_at, and project where a scope asks for it. Observations have no kinds and
    no tags: asking for them is an error. The kind of a hit is its tool, else its event."""
    if kind or tags:
        raise ValueError("observations cannot be filtered by kind or tag")
    named = F.coalesce(F.when(F.col("tool_name") != "", F.col("tool_name")), F.col("event")) if "tool_name" in obs.columns else F.col("event")
    keep = in_scope(scope, project)
    hits = written(ranked(obs.withColumn("content", F.col("summary")), queries, limit, (-F.col("created_at"),), keep), "hits")
    precise = hits.where("whole = 1")
    rest = hits.join(precise.select("qid").distinct(), "qid", "left_anti")
    best = top(precise.unionByName(rest), limit, F.col("bm25"), F.col("order"), F.col("id")).select("qid", "id", "rank", "bm25")
    return best.join(obs.select("id", named.alias("kind")), "id").select("qid", "id", "rank", "bm25", "kind")


def canonical_layer(layer: str) -> str:
    """memory, observation or both, of a layer's name or alias."""
    try:
        return LAYERS[layer.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown layer {layer!r}: memory, observation or both") from None


def search(layer: str, mem: DataFrame, obs: DataFrame, queries: DataFrame, decayed: Column, keep: Column, limit: int = 10, scope: str = "all", project: str = "") -> DataFrame:
    """(qid, id, rank, layer) by layer: fused memories, observations, or both in turn."""
    layer = canonical_layer(layer)
    if layer == "observation":
        return observation_search(obs, queries, limit, scope, project).select("qid", "id", "rank", F.lit(layer).alias("layer"))
    m = fused(mem, queries, decayed, keep & in_scope(scope, project), limit)
    if layer == "memory":
        return m.select("qid", "id", "rank", F.lit(layer).alias("layer"))
    both = interleave(m, observation_search(obs, queries, limit, scope, project), limit)
    return both.select("qid", "id", F.col("place").alias("rank"), "layer")


def interleave(memory: DataFrame, observation: DataFrame, limit: int = 10) -> DataFrame:
    """Two ranked lists taken in turn, memory first. Both: qid, id, rank."""
    both = memory.select("qid", "id", "rank", F.lit("memory").alias("layer")).unionByName(observation.select("qid", "id", "rank", F.lit("observation").alias("layer")))
    w = Window.partitionBy("qid").orderBy("rank", "layer", "id")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def expand(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Append the standard word of every alias that a query contains; global ('') and the query's project. Standards in order, once each."""
    s = synonyms.select(F.col("project").alias("sp"), "standard", F.lower("alias").alias("__alias"))
    asked = queries.select("qid", "project", F.lower("query").alias("__low"))
    found = holding(asked, "__low", s, "__alias").where(((F.col("sp") == "") | (F.col("sp") == F.col("project"))) & ~F.contains("__low", F.lower("standard")))
    add = found.groupBy("qid").agg(F.array_sort(F.collect_set("standard")).alias("more"))
    return queries.join(add, "qid", "left").withColumn("query", F.when(F.size("more") > 0, F.concat("query", F.lit(" "), F.array_join("more", " "))).otherwise(F.col("query"))).drop("more")


def assets_by_file(mem: DataFrame, files: list[str], limit: int = 200) -> DataFrame:
    """Rows whose provenance (JSON text) names one of the files, by project, line and newest. Malformed JSON names none."""
    f, line = F.get_json_object("provenance", "$.file"), F.get_json_object("provenance", "$.line").cast("bigint")
    return mem.withColumn("file", f).withColumn("line", line).where(F.col("file").isin(files)).orderBy("project", F.asc_nulls_first("line"), F.desc("created_at"), "id").limit(min(limit, 200))


def resolve_prefix(mem: DataFrame, wanted: DataFrame) -> DataFrame:
    """(prefix, n, id, state): the id that equals the prefix, else the only one it begins; state: exact, unique, none or ambiguous."""
    ids, asked = mem.select(F.col("id").cast("string").alias("id")).distinct(), wanted.select("prefix").distinct()
    # an id begins with one string of each length, so ids meet prefixes by equality; counts are folded before they are shuffled, however many ids a short prefix has
    lengths = sorted(r.n for r in asked.select(F.char_length("prefix").alias("n")).distinct().collect())
    begun = ids.select("id", F.explode(F.array(*[F.when(F.char_length("id") >= n, F.substring("id", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")).alias("prefix")).where("prefix is not null")
    hit = begun.groupBy("prefix").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max(F.when(F.col("id") == F.col("prefix"), F.col("id"))).alias("same"))
    out = asked.join(hit, "prefix", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    state = F.when(F.col("same").isNotNull(), "exact").when(F.col("n") == 1, "unique").when(F.col("n") == 0, "none").otherwise("ambiguous")
    return out.select("prefix", "n", F.when(state.isin("exact", "unique"), F.coalesce("same", "low")).alias("id"), state.alias("state"))
