"""DuckDB SQL that oracles share: named parts, put before a query in the order they need each other."""

from __future__ import annotations

import re

from ..functions import minhash as M
from ..functions import text as T
from .tables import AUDIT, MEMORIES, NOW, OBSERVATIONS

STRIP = "regexp_replace(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), '[。．.!！?？;；,，:：]+$', '')"
NORM = STRIP.format(c="content")
HASH = f"sha256({NORM})"
DECAY = "greatest(0.05, least(1.0, least(1.0, greatest(0.0, salience)) * exp(-0.01 * d) + 0.3 * ln(1 + greatest(0, access_count)) / (1.0 + d)))"
DAYS = f"floor(greatest(0, {NOW} - last_seen_at) / 86400.0)"
VISIBLE = f"(expires_at IS NULL OR expires_at > {NOW}) AND superseded_by IS NULL"
FOLDED = f"translate(lower({{c}}), '{T.FOLD_FROM}', '{T.FOLD_TO}')"
WORDS = f"regexp_extract_all({FOLDED}, '[\\p{{{{L}}}}\\p{{{{Nd}}}}]+')"


def words(c: str) -> str:
    return WORDS.format(c=c)


def bm25(docs: str, asked: str = "q", tag: str = "") -> dict[str, str]:
    """Parts up to hits{tag}: (qid, id, bm25) of the table ``docs`` (id, content without Han) for the queries ``asked``."""
    t = tag
    return {
        f"toks{t}": f"SELECT id, {words('content')} AS t FROM {docs}",
        f"stats{t}": f"SELECT count(*)::DOUBLE AS n_docs, avg(len(t)) AS avg_len FROM toks{t}",
        f"ph{t}": f"SELECT qid, unnest({words('query')}) AS w FROM {asked}",
        f"posts{t}": f"SELECT id, term, any_value(len) AS len, count(*) AS c FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM toks{t}) GROUP BY id, term",
        f"vocab{t}": f"SELECT w, term FROM (SELECT DISTINCT w FROM ph{t}) JOIN (SELECT DISTINCT term FROM posts{t}) ON starts_with(term, w)",
        f"tf{t}": f"SELECT w, id, any_value(len) AS len, sum(c)::DOUBLE AS f FROM posts{t} JOIN vocab{t} USING (term) GROUP BY w, id",
        f"dfs{t}": f"SELECT w, count(*) AS df FROM tf{t} GROUP BY w",
        f"part{t}": f"SELECT tf.w, id, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len)) AS s FROM tf{t} tf JOIN dfs{t} USING (w), stats{t}",
        f"hits{t}": f"SELECT qid, id, round(-sum(s * times), 9) AS bm25 FROM (SELECT qid, w, count(*) AS times FROM ph{t} GROUP BY ALL) JOIN part{t} USING (w) GROUP BY qid, id",
    }


_FNV = f"list_reduce(list_prepend({M.FNV_BASE}::HUGEINT, flatten(list_transform(string_split(g, ''), lambda ch: [(unicode(ch) & 255)::HUGEINT, ((unicode(ch) >> 8) & 255)::HUGEINT, ((unicode(ch) >> 16) & 255)::HUGEINT, 0::HUGEINT]))), lambda h, b: xor(h, b) * {M.FNV_PRIME} % 18446744073709551616)"


def signatures(texts: str, tag: str = "") -> dict[str, str]:
    """Parts up to sig{tag}: (id, k, v), the 64 MinHash values of each text of ``texts`` (id, content)."""
    t = tag
    functions = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(zip(M.A.tolist(), M.B.tolist(), strict=True)))
    return {
        f"chars{t}": f"SELECT id, unnest(string_split(lower(content), '')) AS c, unnest(range(length(content))) AS i FROM {texts} WHERE length(content) >= 3",
        f"grams{t}": f"SELECT DISTINCT id, g FROM (SELECT id, c || lead(c) OVER w || lead(c, 2) OVER w AS g FROM chars{t} WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE g IS NOT NULL UNION SELECT id, lower(content) FROM {texts} WHERE length(content) BETWEEN 1 AND 2",
        f"gh{t}": f"SELECT g, {_FNV} AS h FROM (SELECT DISTINCT g FROM grams{t})",
        f"gv{t}": f"SELECT g, k, (((a * h + b) % 18446744073709551616) % {M.PRIME})::BIGINT AS v FROM gh{t}, (VALUES {functions}) f(k, a, b)",
        f"sig{t}": f"SELECT id, k, min(v) AS v FROM grams{t} JOIN gv{t} USING (g) GROUP BY id, k",
    }


PARTS: dict[str, str] = {"memories": MEMORIES, "observations": OBSERVATIONS, "audit": AUDIT, "q": "SELECT item_id AS qid, text AS query FROM benchmark WHERE text IS NOT NULL"}
PARTS |= bm25("memories")
PARTS |= bm25("obs_texts", tag="_o") | {"obs_texts": "SELECT id, summary AS content FROM observations"}
PARTS |= signatures("sig_texts") | {"sig_texts": "SELECT 'm' || id AS id, content FROM memories UNION ALL SELECT 'q' || qid, query FROM q WHERE length(query) >= 10"}
PARTS |= signatures("memories", "_m")
RANKED = f"SELECT id, content, kind, project, salience, last_seen_at, round({DECAY}, 12) AS decayed FROM (SELECT *, {DAYS} AS d FROM memories WHERE {VISIBLE})"


def fused(limit: int, asked: str = "q", tag: str = "", hits: str = "hits") -> dict[str, str]:
    """Parts up to fused{tag}: (qid, id, rank, score, exact, routes, precise, broad, fuzzy), for Latin queries, whose precise route equals the broad one."""
    pool, t = 4 * limit, tag
    return {
        f"live{t}": RANKED,
        f"text_route{t}": f"SELECT qid, id, decayed, row_number() OVER (PARTITION BY qid ORDER BY bm25, decayed DESC, salience DESC, last_seen_at DESC, id) AS rank FROM {hits} JOIN live{t} USING (id)",
        f"alike{t}": f"SELECT qid, l.id, decayed, count(*) / 64 AS sim FROM {asked} JOIN sig a ON a.id = 'q' || qid JOIN sig b ON a.k = b.k AND a.v = b.v JOIN live{t} l ON b.id = 'm' || l.id GROUP BY ALL HAVING count(*) >= 0.4 * 64",
        f"alike_route{t}": f"SELECT qid, id, decayed, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM alike{t}",
        f"routes{t}": f"SELECT qid, id, decayed, rank, 0 AS place, 1.0::DOUBLE AS w FROM text_route{t} WHERE rank <= {pool} UNION ALL SELECT qid, id, decayed, rank, 1, 0.8 FROM text_route{t} WHERE rank <= {pool} UNION ALL SELECT qid, id, decayed, rank, 2, 0.6 FROM alike_route{t} WHERE rank <= {min(40, pool)}",
        f"active{t}": f"SELECT qid, sum(w) AS active FROM (SELECT DISTINCT qid, place, w FROM routes{t}) GROUP BY qid",
        f"merged{t}": f"SELECT qid, id, count(*) AS routes, max(decayed) AS decayed, min({{'p': place, 'r': rank}}) AS first, coalesce(sum(w / (60 + rank) / active) FILTER (place = 0), 0) AS precise, coalesce(sum(w / (60 + rank) / active) FILTER (place = 1), 0) AS broad, coalesce(sum(w / (60 + rank) / active) FILTER (place = 2), 0) AS fuzzy FROM routes{t} JOIN active{t} USING (qid) GROUP BY qid, id",
        f"fused{t}": f"SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY precise > 0 DESC, round(precise + broad + fuzzy, 12) DESC, routes DESC, decayed DESC, first)::INTEGER AS rank, precise + broad + fuzzy AS score, (precise > 0)::INTEGER AS exact, routes, precise, broad, fuzzy FROM merged{t}) WHERE rank <= {limit}",
    }


def with_parts(body: str, recursive: bool = False, **more: str) -> str:
    """``body`` behind the parts it names and those that these name; ``more`` adds parts or replaces them. A part's key may name its columns."""
    parts = PARTS | more
    name = {k.split("(")[0]: k for k in parts}
    used: dict[str, str] = {}
    seen: set[str] = set()

    def need(sql: str) -> None:
        for word in re.findall(r"[a-z_][a-z_0-9]*", re.sub(r"'[^']*'", "", sql)):
            if word in name and word not in seen:
                seen.add(word)
                need(parts[name[word]])
                used[name[word]] = parts[name[word]]

    need(body)
    if not used:
        return body
    return ("WITH " + "RECURSIVE " * recursive + ", ".join(f"{k} AS ({v})" for k, v in used.items()) + " " + body).replace("STRING", "VARCHAR")
