"""A kept full-text index: an inverted index in segments that takes appended rows, marks deletions, merges by size, and answers searches without reading a text.

A segment is a Parquet folder. Its rows are dealt to shards of SHARD_DOCS at most or so, a power of two of them; a shard has a row of its documents (ids, lengths) and, by term, rows of at most BLOCK postings (places in the
shard, counts) with the block's largest count and least length, which bound every score in it (searches do not use them now). Beside it lie the signatures of its rows. A manifest of a few lines names the segments and tables of deletions of a version; it is
created exclusively, so of two writers of a version one fails. Rows that are written again die in older segments. Statistics are over live rows, so results are those of an index built anew.

A search sends a block of queries to the postings of their words: where they are read, the terms that a word answers are added up, so a word of very many terms is one row a shard and part of a segment. One pass counts live
documents, one scores shard by shard, all queries of a block in one table of CELLS cells at a time; both read what was sent on, which is written. Segments without a live document are not read.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import minhash as M
from ..functions import text as T
from ..plans.scratch import written
from .ranking import B_LEN, CELLS, DIGITS, K1, LEAST_IDF, Kept, _packed, _spread

#: Documents a shard, postings a block, words of queries that are searched together, segments of a size that are merged.
SHARD_DOCS, BLOCK, QUERY_WORDS, TIER = 2048, 128, 50_000, 4
#: Scores that are added to a table of queries and documents at a time.
ADDED = 1 << 20
#: Postings by word: what a search sends on.
FOUND = "seq int, shard int, words array<int>, places binary, counts binary"
POSTINGS = "shard int, term string, n int, places binary, counts binary, most int, least int"
_ARROW = pa.schema([("shard", pa.int32()), ("term", pa.string()), ("n", pa.int32()), ("places", pa.binary()), ("counts", pa.binary()), ("most", pa.int32()), ("least", pa.int32())])


@dataclass
class Words:
    """A block of queries: its words (term, prefix), and for each query its words, how often it has each, and its groups of words."""

    qids: list = field(default_factory=list)
    words: list[tuple[str, bool]] = field(default_factory=list)
    asked: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    groups: list[list[np.ndarray]] = field(default_factory=list)
    exact: dict[str, int] = field(default_factory=dict)
    begins: dict[str, int] = field(default_factory=dict)

    def add(self, qid, phrases: list[tuple[int, str, bool]]) -> None:
        times: dict[int, int] = {}
        groups: dict[int, set[int]] = {}
        for grp, term, prefix in phrases:
            table = self.begins if prefix else self.exact
            if term not in table:
                table[term] = len(self.words)
                self.words.append((term, prefix))
            w = table[term]
            times[w] = times.get(w, 0) + 1
            groups.setdefault(grp, set()).add(w)
        self.qids.append(qid)
        self.asked.append((np.array(list(times), np.int64), np.array(list(times.values()), float)))
        self.groups.append([np.array(sorted(g)) for g in groups.values()])

    def tables(self) -> list[tuple[int | None, pa.Array, np.ndarray]]:
        """The words that a term is (None), and by length those that it begins with, with their places."""
        by: dict[int | None, dict[str, int]] = {None: self.exact}
        for term, w in self.begins.items():
            by.setdefault(len(term), {})[term] = w
        return [(size, pa.array(list(t), pa.string()), np.array(list(t.values()), np.int64)) for size, t in by.items() if t]

    def by_word(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query query[i] has word w, times[i] times, for i from start[w] to start[w + 1]; alone[i]: it completes a group of the query by itself."""
        word = np.concatenate([np.zeros(0, np.int64), *[ws for ws, _ in self.asked]])
        query = np.repeat(np.arange(len(self.asked)), [len(ws) for ws, _ in self.asked])
        times = np.concatenate([np.zeros(0), *[t for _, t in self.asked]])
        single = {(q, int(g[0])) for q, groups in enumerate(self.groups) for g in groups if len(g) == 1}
        at = np.lexsort((query, word))
        word, query, times = word[at], query[at], times[at]
        alone = np.fromiter(((q, w) in single for q, w in zip(query.tolist(), word.tolist(), strict=True)), bool, len(word))
        return np.searchsorted(word, np.arange(len(self.words) + 1)), query, times, alone


def blocks_of(queries: DataFrame) -> Iterator[Words]:
    """Queries (qid, query) in blocks of QUERY_WORDS words, or of one longer query; queries are a small table and stream through the driver."""
    block = Words()
    for r in queries.select("qid", T.query_phrases(F.col("query")).alias("p")).toLocalIterator():
        if block.words and len(block.words) + len(r.p or []) > QUERY_WORDS:
            yield block
            block = Words()
        block.add(r.qid, [(p.grp, p.term, p.prefix) for p in r.p or []])
    if block.qids:
        yield block


def _joined(column, kind: str) -> np.ndarray:
    """The values of all binary rows, as they lie in memory."""
    out = [np.zeros(0, kind)]
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        _, off, raw = part.buffers()
        if len(part) and raw is not None:
            first, last = np.frombuffer(off, "<i8" if part.type in (pa.large_binary(), pa.large_string()) else "<i4")[part.offset :][[0, len(part)]].tolist()
            out.append(np.frombuffer(raw, kind, (last - first) // np.dtype(kind).itemsize, first))
    return np.concatenate(out)


def _blocks(shard: int, term: np.ndarray, names: list | pa.Array, place: np.ndarray, count: np.ndarray, length: np.ndarray) -> pa.Table:
    """Postings sorted by term and place as rows of blocks. term: places in ``names``."""
    new = np.concatenate([[True], term[1:] != term[:-1]]) if len(term) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    at = np.arange(len(term)) - np.repeat(first, np.diff(np.concatenate([first, [len(term)]])))
    start = np.flatnonzero(at % BLOCK == 0)
    end = np.concatenate([start[1:], [len(term)]])
    cols = [
        pa.array(np.full(len(start), shard), pa.int32()), pa.array(names, pa.string()).take(pa.array(term[start])), pa.array(end - start, pa.int32()), _packed(place, end - start, "<u4"), _packed(count, end - start, "<u4"),
        pa.array(np.maximum.reduceat(count, start) if len(start) else [], pa.int32()), pa.array(np.minimum.reduceat(length[place], start) if len(start) else [], pa.int32()),
    ]
    return pa.Table.from_arrays(cols, schema=_ARROW)


def _documents(shard: int, ids: np.ndarray, length: np.ndarray) -> pa.Table:
    """A shard's documents: the row without a term, ids for places and lengths for counts."""
    row = [[shard], [None], [len(ids)], [ids.astype("<i8").tobytes()], [length.astype("<u4").tobytes()], [0], [0]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(row, _ARROW, strict=True)], schema=_ARROW)


#: What code points of plain texts stand for: a letter or digit, 0 for none, DROPPED.
DROPPED = 255
_WORD = np.zeros(max(T.PLAIN) + 1, np.uint8)
_WORD[list(T.PLAIN)] = [DROPPED if x < 0 else x for x in T.PLAIN.values()]


def _cut(plain: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of plain texts, and the text of each."""
    size, raw = pc.utf8_length(plain).to_numpy().astype(np.int64), _joined(plain, "u1")
    if int(size.sum()) < len(raw):
        raw = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
    raw, first = _WORD[raw], np.cumsum(size) - size
    if (out := raw == DROPPED).any():
        first, raw = first - np.concatenate([[0], np.cumsum(out)])[first], raw[~out]
    cut = np.zeros(len(raw) + 1, bool)
    cut[first] = cut[-1] = True
    word = raw > 0
    start = np.flatnonzero(word & (cut[:-1] | np.concatenate([[True], ~word[:-1]])[: len(word)]))
    end = np.flatnonzero(word & (cut[1:] | np.concatenate([~word[1:], [True]])[: len(word)]))
    off = np.concatenate([[0], np.cumsum(end - start + 1)])
    terms = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(off), pa.py_buffer(raw[word])])
    return terms, np.searchsorted(first, start, side="right") - 1


def _invert(key, table):
    """One shard's documents (shard, id, plain, terms), inverted. terms: of texts that are not plain, else null."""
    table = table.sort_by("id").combine_chunks()
    ids, plain, terms = table.column("id").to_numpy(), table.column("plain").combine_chunks(), table.column("terms").combine_chunks()
    cut, own = _cut(plain)
    given = pc.fill_null(pc.list_value_length(terms), 0).to_numpy()
    flat = pa.concat_arrays([cut, terms.flatten().cast(pa.large_string())]).dictionary_encode()
    own = np.concatenate([own, np.repeat(np.arange(len(ids)), given)])
    length = np.bincount(own, minlength=len(ids))
    order = pc.sort_indices(flat.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    pair, count = np.unique(rank[flat.indices.to_numpy()] * len(ids) + own, return_counts=True)
    shard = table.column("shard")[0].as_py()
    return pa.concat_tables([_documents(shard, ids, length), _blocks(shard, pair // len(ids), flat.dictionary.take(order).cast(pa.string()), pair % len(ids), count, length)])


def _part(t) -> np.ndarray:
    """A segment's shard as one number."""
    return t.column("seq").to_numpy().astype(np.int64) << 32 | t.column("shard").to_numpy()


def _merge_shards(found, docs):
    """Shards of several segments that share live documents, as shards of one. found: their blocks (seq, ...); docs: seq, shard, place, id, len, and the new shard (to) of live documents."""
    out = [_ARROW.empty_table()]
    if not docs.num_rows:
        return out[0]
    ids, length, to, place = (docs.column(c).to_numpy() for c in ("id", "len", "to", "place"))
    parts, own = np.unique(_part(docs), return_inverse=True)
    # where each place of an old shard is among the documents, or -1
    size = np.zeros(len(parts), np.int64)
    np.maximum.at(size, own, place + 1)
    off = np.cumsum(size) - size
    known = np.full(size.sum(), -1)
    known[off[own] + place] = np.arange(len(ids))
    found = found.filter(pc.is_in(pa.array(_part(found)), pa.array(parts)))
    n = found.column("n").to_numpy()
    at, count = (np.frombuffer(b"".join(found.column(c).to_pylist()), "<u4").astype(np.int64) for c in ("places", "counts"))
    old = np.repeat(np.searchsorted(parts, _part(found)), n)
    inside = at < size[old]
    doc = np.where(inside, known[np.where(inside, off[old] + at, 0)], -1)
    flat = found.column("term").combine_chunks().dictionary_encode() if found.num_rows else pa.array([], pa.string()).dictionary_encode()
    names = flat.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    term, sorted_names = np.repeat(rank[flat.indices.to_numpy()], n), [names[i] for i in order]
    to_of = np.where(doc >= 0, to[doc], -1)
    for shard in np.unique(to).tolist():
        mine = np.flatnonzero(to == shard)
        mine = mine[np.argsort(ids[mine])]
        new = np.empty(len(ids), np.int64)
        new[mine] = np.arange(len(mine))
        sel = np.flatnonzero(to_of == shard)
        sel = sel[np.lexsort((new[doc[sel]], term[sel]))]
        out += [_documents(shard, ids[mine], length[mine]), _blocks(shard, term[sel], sorted_names, new[doc[sel]], count[sel], length[mine])]
    return pa.concat_tables(out)


def _shards(n: int) -> int:
    """Shards of ``n`` documents: a power of two, so that a shard of one segment falls into whole shards of another or holds them."""
    return 1 << max(0, -(-n // SHARD_DOCS) - 1).bit_length()


class Index:
    """The index in a folder of a shared file system; a missing folder is an empty index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- manifest ----------------------------------------------------------------------------------

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return p(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict:
        """version, segments (seq, name, docs, shards) and deletions (names) of the newest version."""
        fs, p = self._fs()
        folder = p(f"{self.path}/manifest")
        found = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        found = [n for n in found if n.endswith(".json")]
        if not found:
            return {"version": 0, "next": 1, "segments": [], "deletions": []}
        rows = self.spark.read.text(f"{self.path}/manifest/{found[-1]}").collect()
        return json.loads("".join(r.value for r in rows))

    def _commit(self, manifest: dict) -> None:
        """Make the next version; an error if another writer has made it."""
        fs, p = self._fs()
        manifest["version"] += 1
        out = fs.create(p(f"{self.path}/manifest/{manifest['version']:09d}.json"), False)
        out.write(json.dumps(manifest).encode())
        out.close()

    def _segment(self, name: str) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/{name}")

    # ---- writing -----------------------------------------------------------------------------------

    def append(self, docs: DataFrame) -> None:
        """Take rows (id, content) as a new segment. Rows of ids that the index has replace them; of ids that repeat in ``docs`` one row must stay: an error else."""
        m, name = self.manifest(), f"segment-{uuid.uuid4().hex}"
        n = docs.count()
        if not n:
            return
        shards = _shards(n)
        rows = docs.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.col("id").cast("bigint").alias("id"), F.coalesce("content", F.lit("")).alias("content"))
        # texts are dealt and sorted, a quarter of the bytes of their terms; they are cut behind it
        rows = rows.repartitionById(shards, "shard").sortWithinPartitions("shard").withColumn("plain", T.plain(F.col("content")))
        rows = rows.select("shard", "id", F.coalesce("plain", F.lit("")).alias("plain"), F.when(F.col("plain").isNull(), T.index_terms(F.col("content"))).alias("terms"))
        rows.groupBy("shard").applyInArrow(_invert, POSTINGS).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        docs.select(F.col("id").cast("bigint").alias("id"), M.minhash("content").alias("ds")).write.option("compression", "zstd").parquet(f"{self.path}/{name}-signed")
        own = self._ids(self._segment(name))
        if own.distinct().count() < n:
            raise ValueError("ids repeat in the rows to append")
        if m["segments"]:
            self._mark(m, own)
        m["segments"].append({"seq": m["next"], "name": name, "docs": n, "shards": shards})
        m["next"] += 1
        self._commit(m)

    def delete(self, ids: DataFrame) -> None:
        """Mark rows (id) as gone from all segments there are."""
        m = self.manifest()
        if m["segments"]:
            self._mark(m, ids.select(F.col("id").cast("bigint").alias("id")).distinct())
            self._commit(m)

    def _mark(self, m: dict, ids: DataFrame) -> None:
        name = f"deleted-{uuid.uuid4().hex}"
        ids.select("id", F.lit(m["next"]).alias("before")).write.parquet(f"{self.path}/{name}")
        m["deletions"].append(name)

    def merge(self) -> bool:
        """Merge segments of one size (within a factor of TIER) once there are TIER of them, without their dead rows; true if any were. Deletions that concern no segment any more are dropped."""
        m = self.manifest()
        tiers: dict[int, list[dict]] = {}
        for s in m["segments"]:
            tiers.setdefault(int(np.log(max(1, s["docs"])) / np.log(TIER)), []).append(s)
        for found in tiers.values():
            if len(found) >= TIER:
                self._merge(m, found)
                return True
        return False

    def _merge(self, m: dict, found: list[dict]) -> None:
        alive = self._alive(m, found)
        n = alive.count()
        shards = _shards(n)
        # blocks go to the shards they share as they are: what is shuffled is blocks, not postings (segments that do not tell their shards have one for 8192 documents)
        shared = math.gcd(shards, *[s.get("shards") or -(-s["docs"] // 8192) for s in found])
        k = (F.col("shard") % shared).alias("k")
        docs = alive.select(k, "seq", "shard", "place", "id", "len", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("to"))
        blocks = self._union(found).where("term is not null").select("*", k)
        name = f"segment-{uuid.uuid4().hex}"
        blocks.groupBy("k").cogroup(docs.groupBy("k")).applyInArrow(_merge_shards, POSTINGS).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        self._signed(m, found).select("id", "ds").write.option("compression", "zstd").parquet(f"{self.path}/{name}-signed")
        gone = {s["name"] for s in found}
        m["segments"] = [s for s in m["segments"] if s["name"] not in gone]
        if n:
            # rows of the merged segment count as written last: what they were deleted by has been applied
            m["segments"].append({"seq": m["next"], "name": name, "docs": n, "shards": shards})
        oldest = min((s["seq"] for s in m["segments"]), default=m["next"])
        if m["deletions"]:
            kept = self._deleted(m).where(F.col("before") > oldest)
            m["deletions"] = []
            if not kept.isEmpty():
                table = f"deleted-{uuid.uuid4().hex}"
                kept.write.parquet(f"{self.path}/{table}")
                m["deletions"] = [table]
        m["next"] += 1
        self._commit(m)

    # ---- reading -----------------------------------------------------------------------------------

    @staticmethod
    def _ids(segment: DataFrame) -> DataFrame:
        return _exploded(segment.where("term is null")).select("id")

    def _deleted(self, m: dict) -> DataFrame:
        rows = self.spark.read.schema("id bigint, before int").parquet(*[f"{self.path}/{n}" for n in m["deletions"]])
        return rows.groupBy("id").agg(F.max("before").alias("before"))

    def _union(self, segments: list[dict]) -> DataFrame:
        out = None
        for s in segments:
            part = self._segment(s["name"]).withColumn("seq", F.lit(s["seq"]))
            out = part if out is None else out.unionByName(part)
        return out

    def _alive(self, m: dict, segments: list[dict]) -> DataFrame:
        """(seq, shard, place, id, len) of live documents."""
        docs = _exploded(self._union(segments).where("term is null"))
        if m["deletions"]:
            docs = docs.join(self._deleted(m), "id", "left").where("before is null or before <= seq").drop("before")
        return docs

    def _signed(self, m: dict, segments: list[dict]) -> DataFrame:
        out = None
        for s in segments:
            part = self.spark.read.schema("id bigint, ds array<bigint>").parquet(f"{self.path}/{s['name']}-signed").where("ds is not null").withColumn("seq", F.lit(s["seq"]))
            out = part if out is None else out.unionByName(part)
        return out.join(self._deleted(m), "id", "left").where("before is null or before <= seq") if m["deletions"] else out

    def signatures(self) -> DataFrame:
        """(id, ds): the MinHash signatures of live rows that have one."""
        m = self.manifest()
        return self._signed(m, m["segments"]).select("id", "ds") if m["segments"] else self.spark.createDataFrame([], "id bigint, ds array<bigint>")

    def missing(self, rows: DataFrame) -> DataFrame:
        """Ids of ``rows`` (id) that the index does not hold: what an append has still to take."""
        return rows.select(F.col("id").cast("bigint").alias("id")).join(self.live().select("id"), "id", "left_anti")

    def live(self) -> DataFrame:
        """(id, len) of live documents, len in terms."""
        m = self.manifest()
        return self._alive(m, m["segments"]).select("id", "len") if m["segments"] else self.spark.createDataFrame([], "id bigint, len int")

    def search(self, queries: DataFrame, n: int | None = None, rows: DataFrame | None = None, order: tuple[Column, ...] = (), keep: Column | None = None) -> DataFrame:
        """(qid, id, bm25, whole, order) as ``retrieval.ranked`` gives them, of the live rows. rows: id and what ``order`` and ``keep`` read (no text); rows that it lacks are no hits. n: a superset of each
        query's best ``n``, of all hits and of the whole ones; None: every hit."""
        m, qid = self.manifest(), queries.schema["qid"].dataType
        schema = f"qid {qid.simpleString()}, id bigint, bm25 double, whole int, order array<double>"
        if not m["segments"]:
            return self.spark.createDataFrame([], schema)
        alive = self._alive(m, m["segments"])
        live = alive.groupBy("seq").agg(F.count("*").alias("n"), F.sum("len").alias("len")).collect()
        n_docs, n_terms = sum(r.n for r in live), sum(r["len"] for r in live)
        segments = [s for s in m["segments"] if s["seq"] in {r.seq for r in live}]
        if not segments:
            return self.spark.createDataFrame([], schema)
        known = alive.withColumn("ok", F.lit(True)) if rows is None else None
        if known is None:
            ok = F.coalesce(keep if keep is not None else F.lit(True), F.lit(False))
            known = alive.join(rows.select(F.col("id").cast("bigint").alias("id"), ok.alias("ok"), *[c.cast("double").alias(f"o{i}") for i, c in enumerate(order)]), "id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        known = known.select("seq", "shard", "place", "id", "len", "ok", *[f"o{i}" for i in range(len(order))])
        out = None
        for block in blocks_of(queries):
            found = self._union(segments).where("term is not null").select("seq", "shard", "term", "n", "places", "counts").mapInArrow(_asked_for(block), FOUND)
            found = written(found, "postings")
            pairs = lambda left, right=found: right.groupBy("seq", "shard").cogroup(left.groupBy("seq", "shard"))
            df = np.zeros(len(block.words))
            for r in pairs(alive.select("seq", "shard", "place")).applyInArrow(_count(len(block.words)), "word int, df bigint").groupBy("word").agg(F.sum("df").alias("df")).collect():
                df[r.word] = r.df
            idf = np.log((n_docs - df + 0.5) / (df + 0.5))
            idf = np.where(idf <= 0, LEAST_IDF, idf)
            hits = pairs(known).applyInArrow(_score(block, idf, n_terms / n_docs if n_terms else 1.0, n, len(order), to_arrow_type(qid)), schema)
            out = hits if out is None else out.unionByName(hits)
        return self.spark.createDataFrame([], schema) if out is None else out


def _exploded(docs: DataFrame) -> DataFrame:
    """(seq, shard, place, id, len) of rows without a term; seq where they have one."""
    seq = "seq int, " if "seq" in docs.columns else ""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["places"], "<i8")
                cols = ([pa.array(np.full(len(ids), r["seq"]), pa.int32())] if seq else []) + [pa.array(np.full(len(ids), r["shard"]), pa.int32()), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids), pa.array(np.frombuffer(r["counts"], "<u4"), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=[*(["seq"] if seq else []), "shard", "place", "id", "len"])

    return docs.mapInArrow(run, f"{seq}shard int, place int, id bigint, len int")


def _summed(*keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in their order, and the sum of their counts."""
    size = [int(k.max()) + 1 if len(k) else 1 for k in keys]
    flat = np.ravel_multi_index(keys, size) if len(count) else np.zeros(0, np.int64)
    if not (flat[1:] > flat[:-1]).all():
        flat, back = np.unique(flat, return_inverse=True)
        count = np.bincount(back, count, len(flat)).astype(np.int64)
    return *np.unravel_index(flat, size), count


def _asked_for(block: Words):
    """Postings of terms that the queries ask for as rows of a shard and a word; terms that one word answers are added up."""
    tables = block.tables()

    def run(batches):
        for batch in batches:
            term = batch.column("term")
            row, word = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for size, known, words in tables:
                at = pc.index_in(term if size is None else pc.utf8_slice_codeunits(term, 0, size), value_set=known)
                row.append(np.flatnonzero(at.is_valid()))
                word.append(words[at.drop_null().to_numpy()])
            row, word = np.concatenate(row), np.concatenate(word)
            if not len(row):
                continue
            n, place, count = batch.column("n").to_numpy().astype(np.int64), _joined(batch.column("places"), "<u4").astype(np.int64), _joined(batch.column("counts"), "<u4").astype(np.int64)
            times, at = _spread(np.cumsum(n) - n, n, row)
            parts, own = np.unique(_part(batch), return_inverse=True)
            own, word, place, count = _summed(np.repeat(own[row], times), np.repeat(word, times), place[at], count=count[at])
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (word[1:] != word[:-1])]))
            each = np.diff(np.concatenate([new, [len(word)]]))
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1), pa.int32()), pa.array(word[new], pa.int32()))
            cols = [pa.array(parts[own[new]] >> 32, pa.int32()), pa.array(parts[own[new]] & 0xFFFFFFFF, pa.int32()), words, _packed(place, each, "<u4"), _packed(count, each, "<u4")]
            yield pa.RecordBatch.from_arrays(cols, names=["seq", "shard", "words", "places", "counts"])

    return run


def _postings(found: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, count) by word and place, of places below ``size``; terms that one word answers are added up."""
    found = found.combine_chunks()
    words, n = found.column("words"), pc.binary_length(found.column("places")).to_numpy().astype(np.int64) // 4
    place, count = _joined(found.column("places"), "<u4").astype(np.int64), _joined(found.column("counts"), "<u4").astype(np.int64)
    many = pc.list_value_length(words).to_numpy().astype(np.int64)
    times, at = _spread(np.cumsum(n) - n, n, np.repeat(np.arange(len(n)), many))
    word, place, count = np.repeat(pc.list_flatten(words).to_numpy().astype(np.int64), times), place[at], count[at]
    inside = place < size
    return _summed(word[inside], place[inside], count=count[inside])


def _count(n: int):
    def run(found, alive):
        live = np.zeros(0, bool)
        if alive.num_rows:
            place = alive.column("place").to_numpy()
            live = np.zeros(int(place.max()) + 1, bool)
            live[place] = True
        word, place, _ = _postings(found, len(live))
        df = np.bincount(word[live[place]], minlength=n)
        some = np.flatnonzero(df)
        return pa.table({"word": pa.array(some, pa.int32()), "df": pa.array(df[some])})

    return run


def _nth(score: np.ndarray, n: int) -> np.ndarray:
    """The n-th best score of each row, 0 where it has none."""
    return np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n, None] if score.shape[1] >= n else np.zeros((len(score), 1))


def _score(block: Words, idf: np.ndarray, mean: float, n: int | None, width: int, qid_type: pa.DataType):
    """A shard's best ``n`` of each query, of all hits and of the whole ones."""
    start, query, often, alone = block.by_word()

    def run(found, known):
        names = ["qid", "id", "bm25", "whole", "order"]
        kinds = [qid_type, pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.float64())]
        if not known.num_rows or not found.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        # documents are told by where they stand in known
        old = known.column("place").to_numpy()
        ok, ids, length = known.column("ok").to_numpy(), known.column("id").to_numpy(), known.column("len").to_numpy()
        at = np.full(int(old.max()) + 1, -1)
        at[old] = np.arange(len(old))
        order = np.stack([np.zeros(len(old)), *[known.column(f"o{i}").to_numpy() for i in range(width)]], axis=1)[:, 1:]
        word, place, count = _postings(found, len(at))
        doc = at[place]
        live = doc >= 0
        live[live] = ok[doc[live]]
        word, doc, count = word[live], doc[live], count[live]
        score = idf[word] * count * (K1 + 1) / (count + (K1 * (1 - B_LEN + B_LEN * length / mean))[doc])
        kept = Kept(n, width)
        step = max(1, CELLS // len(ids))
        for first in range(0, len(block.qids), step):
            shape = min(step, len(block.qids) - first), len(ids)
            mine = np.flatnonzero((query >= first) & (query < first + step))
            of = np.searchsorted(mine, start)
            q, t, single = query[mine] - first, often[mine], alone[mine]
            total, whole = np.zeros(shape).reshape(-1), np.zeros(shape, bool)
            adds = np.cumsum(np.diff(of)[word])
            cuts = np.unique(np.concatenate([[0], np.searchsorted(adds, np.arange(ADDED, int(adds[-1]), ADDED)) + 1, [len(word)]])) if len(word) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                times, i = _spread(of[:-1], np.diff(of), word[a:b])
                cell = q[i] * shape[1] + np.repeat(doc[a:b], times)
                total += np.bincount(cell, t[i] * np.repeat(score[a:b], times), len(total))
                whole.reshape(-1)[cell[single[i]]] = True
            total = total.reshape(shape)
            for k, groups in enumerate(block.groups[first : first + step]):
                for g in groups:
                    if len(g) > 1:
                        have = np.zeros(len(ids), np.int64)
                        for a, b in zip(np.searchsorted(word, g).tolist(), np.searchsorted(word, g + 1).tolist(), strict=True):
                            have[doc[a:b]] += 1
                        whole[k] |= have == len(g)
            some = total > 0  # no idf is below LEAST_IDF
            if n is not None:
                slack = 10.0 ** (1 - DIGITS)
                some &= (total + slack >= _nth(total, n)) | whole & (total + slack >= _nth(np.where(whole, total, 0.0), n))
            k, d = np.nonzero(some)
            kept.add(k + first, -np.round(total[k, d], DIGITS), whole[k, d], order[d], ids[d], np.zeros((len(k), 0)))
        q, key, whole, order, ids, _ = kept.rows
        cols = [[block.qids[i] for i in q.tolist()], ids, key, whole.astype(np.int32), list(order)]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run
