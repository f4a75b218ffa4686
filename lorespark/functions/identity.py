"""Names made from content: hashes of observations, windows and bundles, ids of events without one, and keys of repeated triggers. NUL ends each part that could run into the next."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

NUL = "\u0000"
SUMMARY_BYTES = 512


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _digest(prefix: str, n: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(*parts), 256), 1, n))


def observation_hash(event: Column, tool: Column, summary: Column) -> Column:
    return T.content_hash(F.concat(_text(event), F.lit("\n"), _text(tool), F.lit("\n"), _text(summary)))


def window_key(ids: Column) -> Column:
    """Half of the SHA-256 over the sorted ids, a line each."""
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), "\n"), 256), 1, 32)


def bundle_id(source: Column, generation: Column, after: Column, to: Column) -> Column:
    return _digest("bnd_", 24, _text(source), F.lit("|"), _text(generation), F.lit("|"), _text(after), F.lit("|"), _text(to))


def bundle_hash(items: Column) -> Column:
    """SHA-256 over ``id|event_uid|seq`` of a bundle's items, an array of structs in order, a line each."""
    line = lambda x: F.concat(_text(x["id"]), F.lit("|"), _text(x["event_uid"]), F.lit("|"), _text(x["seq"]), F.lit("\n"))
    return F.sha2(F.array_join(F.transform(items, line), ""), 256)


def event_uid(source: Column, generation: Column, seq: Column, raw: Column) -> Column:
    return _digest("evt:", 32, *[x for c in (source, generation, seq) for x in (_text(c), F.lit(NUL))], _text(raw))


def prompt_uid(source: Column, raw: Column) -> Column:
    return _digest("hook:prompt:", 32, _text(source), F.lit(NUL), _text(raw))


def transcript_uid(path: Column, start: Column, block: Column, text: Column) -> Column:
    return _digest("tx:", 32, *[x for c in (path, start, block) for x in (_text(c), F.lit(NUL))], _text(text))


def spool_uid(uid: Column, source: Column, occurred_at_ns: Column, raw: Column) -> Column:
    return F.when(_text(uid) != "", uid).otherwise(_digest("evt:spool:", 32, _text(source), F.lit(NUL), _text(occurred_at_ns), F.lit(NUL), _text(raw)))


def trigger_key(event: Column, session: Column, prompt: Column, cwd: Column, tool: Column | None = None, tool_id: Column | None = None, tool_input: Column | None = None) -> Column:
    """The key of a trigger that may arrive twice. After a tool call its name and id count too, and without an id its input (folded, scrubbed, 120 characters)."""
    base = [x for c in (event, session, F.trim(_text(prompt)), cwd) for x in (_text(c), F.lit(NUL))]
    plain = F.substring(F.sha2(F.concat(*base), 256), 1, 32)
    if tool is None:
        return plain
    said = [x for c in (F.trim(_text(tool)), F.trim(_text(tool_id))) for x in (c, F.lit(NUL))]
    folded = T.one_line(T.scrub(_text(tool_input)), 120)
    more = F.when(F.trim(_text(tool_id)) == "", F.concat(folded, F.lit(NUL))).otherwise("")
    return F.when(event == "post-tool-use", F.substring(F.sha2(F.concat(*base, *said, more), 256), 1, 32)).otherwise(plain)


def short_id(c: Column) -> Column:
    return F.substring(c.cast("string"), 1, 8)


def cut(c: Column, n: int) -> Column:
    """The first ``n`` characters, without a mark."""
    return F.substring(c, 1, n)


def summarize(raw: Column) -> Column:
    """A text without control characters, its white space folded, cut to SUMMARY_BYTES of UTF-8 at the end of a character."""
    plain = F.regexp_replace(F.regexp_replace(_text(raw), "[\\n\\r\\t]", " "), "[\\x00-\\x1f\\x7f]", "")
    flat = T.fields(plain)
    step = lambda s, ch: F.when(s["n"] + F.octet_length(ch) <= SUMMARY_BYTES, F.struct((s["n"] + F.octet_length(ch)).alias("n"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.lit(SUMMARY_BYTES + 1).alias("n"), s["k"].alias("k")))
    kept = F.aggregate(F.split(F.substring(flat, 1, SUMMARY_BYTES), ""), F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), step)["k"]
    return F.when(F.octet_length(flat) <= SUMMARY_BYTES, flat).otherwise(F.trim(F.substr(flat, F.lit(1), kept)))


def path_candidates(path: str, root: str = "") -> list[str]:
    """The names a file may be stored under: relative to the project's root, as typed, and absolute; each once."""
    typed = path.strip()
    if not typed:
        return []
    whole = posixpath.normpath(typed if typed.startswith("/") or not root else posixpath.join(root, typed))
    inside = posixpath.relpath(whole, root) if root and (whole + "/").startswith(root.rstrip("/") + "/") else ""
    return list(dict.fromkeys(x for x in (inside, typed, posixpath.normpath(typed), whole) if x))
