"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Plan, every step a distributed one:

1. Equal texts form one class; only one row of a class goes on. A class is named by a 64-bit hash; where a second, independent one shows that different texts share a
   name, they get names of their own.
2. Each class's set of distinct k-word shingles is scattered, packed, into buckets by shingle hash. A bucket counts
   in how many classes a shingle occurs and sends back only those of two or more: a shingle of one class can meet nobody.
3. Each class gets its repeated shingles in rare-first order (count, hash). Shingles of one class come first in that
   order without being moved. Its prefix of ``n - ceil(t*n) + 1`` shingles must share a member with any set of similarity
   t or more; if the prefix holds unique shingles only, the class has no link.
4. Classes are joined on prefix shingles. Several rounds link every class with one hash-chosen centre per prefix shingle, so that large
   groups of near copies close up after linear work. Then all remaining pairs of different components that share a
   prefix shingle are formed, once each, and pass the length, positional and suffix filters before their sets are intersected.
   Links between members of one component are left unformed only where they cannot change the component.

A shingle's key has 64 bits with 2**16 buckets or more, else 48 and those of its bucket. Different shingles with one key are taken as equal; that can only matter if both
stand in the two sets of one pair.

Hot classes, prefix shingles and components are cut in proportion before what is known of them is joined back, and a prefix shingle of many classes is cut into blocks
whose pairs are formed apart, so no task grows with a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components

#: Parameters of the operator. bytes_per_bucket: text bytes whose shingles meet in one bucket.
SLICE_BYTES = 2 << 20
BYTES_PER_BUCKET = 8 << 20
STAR_ROUNDS = 3
KEY_BITS = 48
SKETCH = 32
#: Classes of one prefix shingle that meet as one block.
BLOCK = 512
#: Prefix shingles that a row carries to tell whether a pair met at an earlier one; behind them a pair may be formed more than once.
CARRIED = 128


def _key_bits(bucket_bits: int) -> int:
    return min(KEY_BITS, 64 - bucket_bits)


def _first_hash(text: F.Column) -> F.Column:
    return F.xxhash64(text)


def _second_hash(text: F.Column) -> F.Column:
    """The same function from another seed: that of a number before the text."""
    return F.xxhash64(F.lit(7), text)


def _scatter(k: int, bucket_bits: int):
    shift, key_bits = C.U(64 - bucket_bits), _key_bits(bucket_bits)
    narrow = np.uint16 if bucket_bits <= 16 else np.uint32

    def run(batches):
        C.hold("shingles", C.forget_powers)
        for batch in batches:
            cls = batch.column("cls").to_numpy(zero_copy_only=False)
            raw, off = C.utf8(batch.column("text"))
            for i, j in C.slices(off, SLICE_BYTES):
                sets = C.shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                n = np.fromiter(map(len, sets), np.int64, j - i)
                h = np.concatenate(sets) if sets else np.zeros(0, C.U)
                bucket = (h >> shift).astype(np.int64) if bucket_bits else np.zeros(len(h), np.int64)
                order = np.argsort(bucket.astype(narrow), kind="stable")
                own = np.repeat(np.arange(j - i), n)[order]
                h, bucket = h[order], bucket[order]
                key = (h << C.U(bucket_bits)) >> C.U(64 - key_bits)
                hi, lo = (key >> C.U(16)).astype(np.uint32), (key & C.U(65535)).astype(np.uint16)
                home = (C.mix64(cls[i:j].view(C.U)) % C.U(1 << bucket_bits)).astype(np.int64)
                rows = []
                cuts = C.group_cuts(bucket)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    runs = C.group_cuts(own[a:b])
                    who = own[a:b][runs[:-1]]
                    rows.append((int(bucket[a]), 0, C.blob(cls[i:j][who]), C.blob(np.diff(runs).astype(np.uint32)), C.blob(hi[a:b]), C.blob(lo[a:b])))
                at = np.argsort(home, kind="stable")
                cuts = C.group_cuts(home[at])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    who = at[a:b]
                    rows.append((int(home[who[0]]), 1, C.blob(cls[i:j][who]), C.blob(n[who].astype(np.uint32)), b"", b""))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int8(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "kind", "who", "cnt", "hi", "lo"])

    return run


_PACKED = "bucket int, kind tinyint, who binary, cnt binary, hi binary, lo binary"
_COUNTED = "block int, kind tinyint, who binary, cnt binary, h binary, df binary"


def _joined(col: pa.ChunkedArray, kind: np.ndarray, want: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x, k in zip(col.to_pylist(), kind, strict=True) if k == want), dtype)


def _count(bucket_bits: int):
    """One bucket: classes per shingle; entries of shingles in two classes or more, by the block of their class."""

    def run(t: pa.Table) -> pa.Table:
        C.hold("shingle counts")
        kind = t.column("kind").to_numpy()
        bucket = C.U(int(t.column("bucket")[0].as_py()))
        out = []
        meta_who, meta_n = _joined(t.column("who"), kind, 1, np.int64), _joined(t.column("cnt"), kind, 1, np.uint32)
        who = np.repeat(_joined(t.column("who"), kind, 0, np.int64), _joined(t.column("cnt"), kind, 0, np.uint32))
        key = (_joined(t.column("hi"), kind, 0, np.uint32).astype(C.U) << C.U(16)) | _joined(t.column("lo"), kind, 0, np.uint16)
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        cuts = C.group_cuts(key)
        df = np.repeat(np.diff(cuts), np.diff(cuts))
        keep = df >= 2
        key, who, df = key[keep] | (bucket << C.U(_key_bits(bucket_bits))), who[keep], df[keep]
        block = (C.mix64(who.view(C.U)) % C.U(1 << bucket_bits)).astype(np.int64)
        order = np.lexsort((who, block))
        key, who, df, block = key[order], who[order], df[order], block[order]
        cuts = C.group_cuts(block)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            runs = C.group_cuts(who[a:b])
            out.append((int(block[a]), 0, C.blob(who[a:b][runs[:-1]]), C.blob(np.diff(runs).astype(np.uint32)), C.blob(key[a:b]), C.blob(df[a:b].astype(np.uint32))))
        block = (C.mix64(meta_who.view(C.U)) % C.U(1 << bucket_bits)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        cuts = C.group_cuts(block[order])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out.append((int(block[order[a]]), 1, C.blob(meta_who[order[a:b]]), C.blob(meta_n[order[a:b]]), b"", b""))
        types = (pa.int32(), pa.int8(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        cols = zip(*out, strict=True) if out else [[]] * 6
        return pa.table([pa.array(c, ty) for c, ty in zip(cols, types, strict=True)], names=["block", "kind", "who", "cnt", "h", "df"])

    return run


_SETS = "cls bigint, n int, own int, plen int, rep array<bigint>, sketch array<int>"


def _order(num: int, den: int):
    """One block: per class its size, how many shingles are its own alone, and the repeated ones, rarest first."""

    def run(t: pa.Table) -> pa.Table:
        C.hold("shingle counts")
        kind = t.column("kind").to_numpy()
        mw, mn = _joined(t.column("who"), kind, 1, np.int64), _joined(t.column("cnt"), kind, 1, np.uint32).astype(np.int64)
        at = np.argsort(mw, kind="stable")
        mw, mn = mw[at], mn[at]
        first = np.concatenate([[True], mw[1:] != mw[:-1]]) if len(mw) else np.zeros(0, bool)
        mw, mn = mw[first], mn[first]
        who = np.repeat(_joined(t.column("who"), kind, 0, np.int64), _joined(t.column("cnt"), kind, 0, np.uint32))
        h, df = _joined(t.column("h"), kind, 0, np.int64), _joined(t.column("df"), kind, 0, np.uint32)
        order = np.lexsort((h, df, who))
        who, h, df = who[order], h[order], df[order]
        lo, hi = np.searchsorted(who, mw, "left"), np.searchsorted(who, mw, "right")
        own = mn - (hi - lo)
        plen = mn - -(-mn * num // den) + 1
        reps, sketches = [], []
        for a, b, o, p in zip(lo, hi, own, plen, strict=True):
            if o >= p or a == b:
                reps.append(None)
                sketches.append(None)
            else:
                reps.append(h[a:b])
                sketches.append(np.bincount(h[a:b] % SKETCH, minlength=SKETCH).astype(np.int32))
        return pa.table([pa.array(mw), pa.array(mn.astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(plen.astype(np.int32)), pa.array(reps, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int32()))], names=["cls", "n", "own", "plen", "rep", "sketch"])

    return run


def _may_link(num: int, den: int) -> F.Column:
    """Length, first-meeting, positional and suffix filters of a pair (a, b) that meets at a prefix shingle.

    n: set sizes; p: the shingle's place in either set; e: the prefix shingles before it, null if they are too many to carry; k: repeated
    shingles by hash class. A pair counts where it meets first; there the rest of either set bounds what they share, as do the classes' smaller counts.
    """
    need = F.ceil((F.col("na") + F.col("nb")) * F.lit(num) / F.lit(num + den) - F.lit(1e-9))
    length = (F.least("na", "nb") * den) >= (F.greatest("na", "nb") * num)
    carried = F.col("ea").isNotNull() & F.col("eb").isNotNull()
    first = ~F.coalesce(F.arrays_overlap("ea", "eb"), F.lit(False))
    place = ~carried | (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need)
    suffix = sum((F.least(F.col("ka")[i], F.col("kb")[i]) for i in range(1, SKETCH)), F.least(F.col("ka")[0], F.col("kb")[0])) >= need
    return length & first & place & suffix


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) among pairs (a, b): shared shingles are repeated ones, so the repeated lists decide."""
    s = sets.select("cls", "n", "rep")
    x = pairs.select("a", "b").join(s.toDF("a", "na", "ra"), "a").join(s.toDF("b", "nb", "rb"), "b")
    both = F.size(F.array_intersect("ra", "rb"))
    return x.where(both * den >= (F.col("na") + F.col("nb") - both) * num).select("a", "b")


def jaccard_classes(docs: DataFrame, k: int, num: int, den: int, label: str = "jaccard") -> tuple[DataFrame, DataFrame, C.Scratch, object]:
    """Rows (doc_id, cls) of ``docs``, classes (cls, n, root), the scratch folder, and the function that adds ``cls`` to a table with ``text``.

    docs: doc_id, text. Sets of Jaccard similarity num/den or more are linked. Null and empty texts have the empty set, which links with nothing.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark, label)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    clash = None

    def classed(df: DataFrame) -> DataFrame:
        df = df.withColumn("cls", _first_hash(text)).withColumn("__second", _second_hash(text))
        if clash is not None:
            df = df.join(F.broadcast(clash), "cls", "left").withColumn("cls", F.when(F.col("__clash"), F.xxhash64("cls", "__second")).otherwise(F.col("cls"))).drop("__clash")
        return df

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    ids = scratch.put("ids", classed(rows).select("doc_id", "cls", F.octet_length("text").alias("size"), "__second"))
    # names that two texts share: some n*n / 2**65 of n texts, so a handful at any corpus size
    same = ids.groupBy("cls").agg(F.min("__second").alias("x"), F.max("__second").alias("y")).where("x <> y").select("cls", F.lit(True).alias("__clash"))
    same = scratch.put("clash", same)
    if not same.isEmpty():
        clash = same
        ids = scratch.put("ids2", classed(rows).select("doc_id", "cls", F.octet_length("text").alias("size"), "__second"))
    each = scratch.put("each", ids.groupBy("cls", "doc_id").agg(F.count("*").alias("rows")))
    first = each.groupBy("cls").agg(F.min("doc_id").alias("low"), F.count("*").alias("ids"))
    hot = C.heavy_keys(each, "cls", scratch, "each")
    more = C.cut_join(each, first.where("ids > 1"), "cls", hot, C.by_place("doc_id")).where("doc_id > low or (doc_id is null and low is not null)").select("cls", "doc_id")
    more = scratch.put("more", more)
    total = ids.agg(F.sum("size")).first()[0] or 0
    reps = classed(rows).alias("r").join(C.maybe_broadcast(more, more.count()).alias("m"), F.expr("r.cls = m.cls and r.doc_id <=> m.doc_id"), "left_anti").select("cls", "text")
    if not each.where("rows > 1").isEmpty():  # rows that repeat id and text
        reps = reps.dropDuplicates(["cls"])

    bits = C.pow2_at_least(max(C.shuffle_partitions(spark), total / BYTES_PER_BUCKET)).bit_length() - 1
    packed = reps.mapInArrow(_scatter(k, bits), _PACKED)
    counted = packed.groupBy("bucket").applyInArrow(_count(bits), _COUNTED)
    sets = scratch.put("sets", counted.groupBy("block").applyInArrow(_order(num, den), _SETS))

    live = sets.where("rep is not null")
    prefix = live.select("cls", "n", F.posexplode(F.slice("rep", F.lit(1), F.col("plen") - F.col("own"))).alias("i", "h"), "own")
    slim = scratch.put("prefix", prefix.select("cls", "n", (F.col("own") + F.col("i")).alias("p"), "h"))

    hot = C.heavy_keys(slim, "h", scratch, "prefix")
    comp, links, tried = None, None, []
    for rnd in range(STAR_ROUNDS):
        # one centre per prefix shingle, chosen by hash: the classes of a large group of near copies mostly agree on it
        at = slim
        if comp is not None:
            at = at.join(comp.toDF("cls", "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        else:
            at = at.withColumn("root", F.col("cls"))
        centre = at.groupBy("h").agg(F.min(F.struct(F.xxhash64("cls", F.lit(rnd)).alias("r"), F.col("cls").alias("c"), F.col("n").alias("nc"), F.col("root").alias("rc"))).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h", "m.c", "m.nc", "m.rc")
        pairs = C.cut_join(at, centre, "h", hot, F.xxhash64("cls", F.lit(5))).where("root <> rc").where((F.least("n", "nc") * den) >= (F.greatest("n", "nc") * num))
        pairs = pairs.select(F.least("cls", "c").alias("a"), F.greatest("cls", "c").alias("b")).distinct()
        pairs = scratch.put(f"tried{rnd}", pairs if not tried else pairs.join(tried[0] if len(tried) == 1 else tried[0].union(tried[1]), ["a", "b"], "left_anti"))
        tried.append(pairs)
        found = scratch.put(f"star{rnd}", _verify(pairs, live, num, den))
        links = found if links is None else links.union(found)
        if found.isEmpty():
            break
        comp = connected_components(links, scratch, f"cc{rnd}")
    at = slim if comp is None else slim.join(comp.toDF("cls", "root"), "cls", "left")
    at = at.withColumn("root", F.coalesce("root", "cls") if comp is not None else F.col("cls"))
    mixed = at.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")).where("lo <> hi").select("h", "nb")
    at = scratch.put("rest", C.cut_join(at, mixed, "h", hot, F.xxhash64("cls", F.lit(5))))
    ahead = F.col("plen") - F.col("own")
    carry = live.select("cls", "own", "sketch", F.slice("rep", F.lit(1), F.least(ahead, F.lit(CARRIED))).alias("pre"))
    at = at.join(carry, "cls").withColumn("e", F.when(F.col("p") - F.col("own") <= CARRIED, F.slice("pre", F.lit(1), F.col("p") - F.col("own"))))
    # block i of a shingle's classes meets block j under the key (h, i, j): one key for most shingles, and no task takes a common one whole
    at = at.withColumn("blk", F.pmod(F.xxhash64("cls", F.lit(9)), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    side = lambda i, j: at.select("h", F.col(i).alias("i"), F.col(j).alias("j"), "cls", "n", "p", "root", "e", "sketch")
    x = side("blk", "other").toDF("h", "i", "j", "a", "na", "pa", "ra", "ea", "ka")
    y = side("other", "blk").toDF("h", "i", "j", "b", "nb", "pb", "rb", "eb", "kb")
    pairs = x.join(y, ["h", "i", "j"]).where(F.expr("a < b and ra <> rb") & _may_link(num, den)).select("a", "b").distinct()
    for t in tried:  # a pair is verified once
        pairs = pairs.join(t, ["a", "b"], "left_anti")
    last = scratch.put("last", _verify(pairs, live, num, den))
    if not last.isEmpty():
        comp = connected_components(links.union(last) if links is not None else last, scratch, "ccz")
    classes = sets.select("cls", "n")
    if comp is None:
        classes = classes.withColumn("root", F.col("cls"))
    else:
        classes = classes.join(comp.toDF("cls", "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    return ids.select("doc_id", "cls"), scratch.put("class-roots", classes), scratch, classed


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; further columns are ignored).

    component_id: the smallest doc_id reachable by links, the own one included. Rows without words (null, empty and blank texts) have n_shingles 0
    and their own id; texts of any length are compared whole. Rows that repeat a doc_id keep a row each. A null doc_id stays null and takes the smallest id of
    its component, if there is one. An empty table gives no rows.
    """
    ids, classes, scratch, _ = jaccard_classes(docs, k, num, den)
    low = ids.groupBy("cls").agg(F.min("doc_id").alias("low"))
    low = classes.join(low, "cls").groupBy("root").agg(F.min("low").alias("component_id"))
    known = C.cut_join(classes, low, "root", C.heavy_keys(classes, "root", scratch, "roots"), F.xxhash64("cls", F.lit(5)))
    known = scratch.put("known", known.select("cls", "n", "component_id"))
    out = C.cut_join(ids, known, "cls", C.heavy_keys(ids, "cls", scratch, "ids"), C.by_place("doc_id"))
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one row of each group of linked rows left: the one of smallest doc_id (an id before none, ties by text hash).

    Rows without words (null, empty and blank texts) all stay; texts of any length are compared whole; of rows that repeat id and text one stays; an empty table stays empty.
    Only (id, text hash) pairs are joined to choose; texts move only where that list is too long to broadcast.
    """
    ids, classes, scratch, classed = jaccard_classes(docs, k, num, den, "keepone")
    worded = classes.where("n > 0").select("cls", "root")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col("cls").alias("c"))
    first = ids.groupBy("cls").agg(F.min(rank).alias("m"))
    best = worded.join(first, "cls").groupBy("root").agg(F.min("m").alias("m")).select("root", F.col("m.d").alias("d"), F.col("m.c").alias("c"))
    of = C.cut_join(worded, best, "root", C.heavy_keys(worded, "root", scratch, "roots"), F.xxhash64("cls", F.lit(5)))
    of = scratch.put("best", of.select("cls", "d", "c"))
    rows = C.cut_join(ids, of, "cls", C.heavy_keys(ids, "cls", scratch, "ids"), C.by_place("doc_id"))
    rows = scratch.put("rows", rows.select(F.col("doc_id").alias("__d"), F.col("cls").alias("__c"), F.expr("doc_id <=> d and cls = c").alias("stays")))
    lost = rows.where("not stays").select("__d", "__c").distinct()
    again = rows.where("stays").groupBy("__d", "__c").agg(F.count("*").alias("n")).where("n > 1").select("__d", "__c")
    lost, again = scratch.put("lost", lost), scratch.put("again", again)
    named = classed(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c != "text"})).withColumnRenamed("cls", "__cls")
    named = named.select(F.col("__cls"), F.col("text"), *[F.col(f"own_{c}").alias(c) for c in docs.columns if c != "text"])
    same = F.expr("__cls = __c and cast(doc_id as bigint) <=> __d")
    out = named.join(C.maybe_broadcast(lost, lost.count()), same, "left_anti")
    n = again.count()
    if n:  # rows that repeat id and text of the one that stays
        again = C.maybe_broadcast(again, n)
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["doc_id", "__cls"]))
    return out.select(*docs.columns)
