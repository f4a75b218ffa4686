"""Secret scans over an incremental blob ledger.

Every version of every document is addressed by the SHA-256 of its content. The ledger holds which (blob, rule version) pairs have
been scanned and what was found; a scan reads only the pairs it does not hold, each blob once however many documents
share it, and findings are joined back to all paths (documents) that ever held the blob.

Rules are a named, versioned list; a changed rule list has another version and is scanned anew. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Fixed patterns. The first three are the base rules; the others are added by this operator.
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEY_BEGIN = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_KEY_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
_BEARER = re.compile(r"\b[Bb]earer\x20+[A-Za-z0-9._~+/-]{16,}=*")
_LOGIN = re.compile(r"://[^\s/:@]+:[^\s/@]+@")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")


def private_keys(text: str):
    """Each BEGIN line with the first END line behind it; one pass over either, so that BEGINs without an END cost nothing more."""
    ends, at, done = [m.span() for m in _KEY_END.finditer(text)], 0, 0
    for m in _KEY_BEGIN.finditer(text) if ends else ():
        if m.start() < done:
            continue
        while at < len(ends) and ends[at][0] < m.end():
            at += 1
        if at == len(ends):
            return
        done = ends[at][1]
        yield m.start(), done


def jwts(text: str):
    """Three dotted parts, the first from an ``eyJ`` at a word's edge and of eleven characters or more, the second of eight or more.

    Dotted runs are found first and cut at their dots, so no character is read again for each ``eyJ``.
    """
    for m in _DOTTED.finditer(text):
        parts, at, i = m[0].split("."), m.start(), 0
        starts = []
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        while i + 2 < len(parts):
            if parts[i + 2] and len(parts[i + 1]) >= 8 and len(parts[i]) >= 11 and (head := _token_head(text, starts[i], len(parts[i]))) >= 0:
                yield head, starts[i + 2] + len(parts[i + 2])
                i += 3
            else:
                i += 1


def _token_head(text: str, at: int, n: int) -> int:
    """The first ``eyJ`` at a word's edge in text[at:at + n] with eight characters behind it, or -1."""
    i = text.find("eyJ", at, at + n)
    while 0 <= i <= at + n - 11:
        before = text[i - 1] if i else " "
        if not (before.isalnum() or before == "_"):
            return i
        i = text.find("eyJ", i + 1, at + n)
    return -1


def url_logins(text: str):
    """``scheme://user:password@`` with a scheme, user and password of any length; the scheme is read backwards from its colon."""
    done = 0
    for m in _LOGIN.finditer(text):
        a = m.start()
        while a > done and text[a - 1] in _SCHEME:
            a -= 1
        while a < m.start() and not ("a" <= text[a] <= "z"):
            a += 1
        if m.start() - a >= 2:
            done = m.end()
            yield a, done


#: kind, a string that every match holds, finder of spans.
_MORE = [
    ("private_key", "-----BEGIN ", private_keys),
    ("jwt", "eyJ", jwts),
    ("bearer", "earer ", lambda text: (m.span() for m in _BEARER.finditer(text))),
    ("url_login", "://", url_logins),
]
KINDS = ("assign", "access", "hex", *(name for name, _, _ in _MORE))
BASE = KINDS[:3]
#: Named anew whenever a rule changes what it finds.
RULE_VERSION = "v2-" + hashlib.sha256("\n".join(p.pattern for p in (_ASSIGN, _ACCESS, _HEX, _KEY_BEGIN, _KEY_END, _DOTTED, _BEARER, _LOGIN)).encode()).hexdigest()[:12]


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start and then kind; per kind leftmost and without overlap."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for name, sign, spans in _MORE:
        if sign in text:
            out += [(name, a, b) for a, b in spans(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_FOUND = "blob string, rules string, n_assign bigint, n_access bigint, n_hex bigint, n_more bigint, base_sha256 string, spans string"


def _scan(batches):
    C.hold("secrets")
    for batch in batches:
        cols: list[list] = [[] for _ in range(8)]
        for blob, text in zip(batch.column("blob").to_pylist(), batch.column("text"), strict=True):
            spans = find(text.as_py())
            base = [s for s in spans if s[0] in BASE]
            kinds = [s[0] for s in spans]
            row = (blob, RULE_VERSION, *(kinds.count(k) for k in BASE), len(spans) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        types = (pa.string(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in _FOUND.split(", ")])


class BlobLedger:
    """Findings by (blob, rules) in an append-only Parquet table, and the paths of every blob in another."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or C.Scratch(spark, "ledger").base

    def _read(self, name: str, schema: str) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def findings(self) -> DataFrame:
        return self._read("findings", _FOUND)

    def paths(self) -> DataFrame:
        return self._read("paths", "doc_id bigint, blob string")

    def ingest(self, docs: DataFrame) -> tuple[int, DataFrame]:
        """Record the versions in ``docs`` (doc_id, text; null text: empty) and scan blobs that are new under the current rules.

        Returns the number of blobs scanned, and a (doc_id, blob) row for each row of ``docs``. A second call with the same rows scans none; after a crash between
        the two appends the next call completes the work, since what is scanned is decided by the findings table alone.
        """
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("blob", F.sha2("text", 256))
        seen = self.findings().where(F.col("rules") == RULE_VERSION).select("blob")
        old = not seen.isEmpty()
        fresh = rows.select("blob", "text")
        if old:  # known blobs leave before their texts are moved
            fresh = fresh.join(seen.distinct(), "blob", "left_anti")
        fresh = fresh.groupBy("blob").agg(F.first("text").alias("text"))
        before = self.findings().count() if old else 0
        fresh.mapInArrow(_scan, _FOUND).write.mode("append").option("compression", "zstd").parquet(f"{self.path}/findings")
        batch = C.Scratch(self.spark, "ledger-batch").put("rows", rows.select("doc_id", "blob"))
        known = batch if self.paths().isEmpty() else batch.exceptAll(self.paths())
        known.write.mode("append").option("compression", "zstd").parquet(f"{self.path}/paths")
        return self.findings().count() - before, batch

    def report(self, rows: DataFrame | None = None) -> DataFrame:
        """``rows`` (doc_id, blob; a written table, by default every path the ledger has recorded) with what each blob holds under the current rules: one row each."""
        found = self.findings().where(F.col("rules") == RULE_VERSION).dropDuplicates(["blob"]).drop("rules")
        rows = self.paths() if rows is None else rows
        return C.cut_join(rows, found, "blob", C.heavy_keys(rows, "blob", C.Scratch(self.spark, "ledger-cuts"), "blobs"), C.by_place("doc_id"))


def secrets(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """Secret spans of every row of ``docs`` (doc_id, text; further columns are ignored), by way of ``ledger``, whatever else it holds.

    Null and empty texts have none, texts of any length are read whole; repeated rows and null ids keep a row each; spans of one start stand in the order of the kinds; an
    empty table gives no rows. Returns doc_id, n_assign, n_access, n_hex, n_more, base_sha256, spans and blob.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    _, rows = ledger.ingest(docs)
    return ledger.report(rows).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_more", "blob")


def redact(docs: DataFrame, mark: str = "[redacted]") -> DataFrame:
    """``docs`` with each secret's span replaced by ``mark`` (overlapping spans once); all other text and columns stay.

    Spans come from the ledger by content; a text without a finding passes through untouched, null texts stay null, empty ones empty. Repeated rows keep a row each,
    an empty table stays empty.
    """
    spark = docs.sparkSession
    ledger = BlobLedger(spark)
    ledger.ingest(docs)
    hit = ledger.findings().where((F.col("rules") == RULE_VERSION) & (F.col("spans") != "")).select("blob", "spans").distinct()
    hit = C.Scratch(spark, "hits").put("hits", hit)
    n, size = hit.agg(F.count("*"), F.coalesce(F.sum(F.length("spans")), F.lit(0))).first()
    names = docs.columns
    keyed = docs.withColumn("__blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    small = C.maybe_broadcast(hit, n + size // 256, 50_000)  # some 64 + 256 bytes a row: 16 MB

    @F.pandas_udf("string")
    def cut(text, spans):
        def one(t, s):
            if s is None or t is None:
                return t
            out, at = [], 0
            for a, b in sorted(tuple(map(int, x.rsplit(":", 2)[1:])) for x in s.split(",")):
                if b <= at:
                    continue
                out.append(t[at : max(a, at)])
                if a >= at:
                    out.append(mark)
                at = b
            return "".join(out) + t[at:]

        return text.combine(spans, one)

    out = keyed.join(small.toDF("__blob", "__spans"), "__blob", "left")
    return out.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(cut(F.when(F.col("__spans").isNotNull(), F.col("text")), "__spans"))).select(*names)
