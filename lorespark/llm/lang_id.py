"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, at every position, one bit per language: ANDing the words at an n-gram's positions
returns all languages that contain the n-gram. A text's per-language popcounts over its distinct n-gram
occurrences are corrected for the false positives that the fill of each slice predicts, and the largest share decides.

Training looks at a bounded sample of labelled rows (``rows_per_lang`` texts of a language, chosen by hash, whole); each language keeps its ``grams_per_lang``
most frequent n-grams. The filter's size depends on these bounds only, so it can be broadcast at any corpus size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: N-gram lengths; characters besides letters separate words, and one edge mark stands before and after each word.
LENGTHS = (1, 2, 3, 4)
PROBES = 3
ROWS_PER_LANG = 2000
GRAMS_PER_LANG = 3000
BITS_PER_GRAM = 16
SLICE_BYTES = 1 << 19

_letters: dict[str, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if "t" not in _letters:
        _letters["t"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters["t"]


def grams(text: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit n-gram hashes of all texts, the text index of each, and whether each text has a letter."""
    low = [(t or "").lower() for t in text]
    joined = "\n".join(low) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
    letter = _is_letter()[np.minimum(code, 0x10FFFF)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one edge mark after each word; the one before it is the previous edge
    own = np.repeat(np.arange(len(low)), size)[keep]
    chars = np.where(letter[keep], code[keep], 0).astype(C.U)
    has = np.bincount(own[chars > 0], minlength=len(low)) > 0
    # every word: edge, letters, edge; n-grams may begin at the edge before a word and end at the edge behind it
    chars = np.concatenate([[0], chars]).astype(C.U)
    own = np.concatenate([own[:1], own]) if len(own) else np.zeros(1, np.int64)
    n = len(chars)
    hashes, owners = [], []
    acc = np.zeros(n, C.U)
    edge_inside = np.zeros(n, bool)
    for k in range(1, max(LENGTHS) + 1):
        m = n - k + 1
        if m <= 0:
            break
        acc = acc[:m] * C.U(0x100000001B3) + chars[k - 1 :] + C.U(1)
        if k > 2:
            edge_inside = edge_inside[:m] | (chars[k - 2 : k - 2 + m] == 0)
        if k == 1:
            ok = chars > 0
            edge_inside = np.zeros(n, bool)
        elif k == 2:
            ok = (chars[:m] > 0) | (chars[1:] > 0)
        else:
            ok = ~edge_inside[:m]
        if k in LENGTHS:
            hashes.append(C.mix64(acc[ok] + C.U(k * 0x9E3779B97F4A7C15 & C.M64)))
            owners.append(own[k - 1 :][ok])
    if not hashes:
        return np.zeros(0, C.U), np.zeros(0, np.int64), has
    return np.concatenate(hashes), np.concatenate(owners), has


@dataclass
class BitmaskFilter:
    """table[position, word]: a bit per language. rate[l]: how often an unknown n-gram seems to be one of language l."""

    langs: list[str]
    table: np.ndarray
    rate: np.ndarray

    def positions(self, h: np.ndarray) -> list[np.ndarray]:
        step = (h >> C.U(32)) | C.U(1)
        return [((h + C.U(i) * step) % C.U(len(self.table))).astype(np.int64) for i in range(PROBES)]

    def masks(self, h: np.ndarray) -> np.ndarray:
        pos = self.positions(h)
        out = self.table[pos[0]]
        for p in pos[1:]:
            out = out & self.table[p]
        return out

    @classmethod
    def build(cls, langs: list[str], members: dict[str, np.ndarray]) -> BitmaskFilter:
        total = max([1, *(len(x) for x in members.values())])
        size = C.pow2_at_least(BITS_PER_GRAM * total)
        f = cls(langs, np.zeros((size, max(1, -(-len(langs) // 64))), C.U), np.zeros(len(langs)))
        for i, lang in enumerate(langs):
            for p in f.positions(members[lang]):
                np.bitwise_or.at(f.table[:, i // 64], p, C.U(1) << C.U(i % 64))
            fill = float(np.mean((f.table[:, i // 64] >> C.U(i % 64)) & C.U(1)))
            f.rate[i] = fill**PROBES
        return f

    def decide(self, text: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        h, own, has = grams(text)
        n = len(text)
        total = np.bincount(own, minlength=n).astype(float)
        m = self.masks(h)
        share = np.zeros((len(self.langs), n))
        for i in range(len(self.langs)):
            hit = ((m[:, i // 64] >> C.U(i % 64)) & C.U(1)).astype(bool)
            count = np.bincount(own[hit], minlength=n)
            fp = self.rate[i]
            share[i] = np.clip((count - fp * total) / np.maximum(1e-9, (1 - fp) * total), 0, 1)
        if not self.langs:
            return ["und"] * n, [0.0] * n, total.astype(int).tolist()
        best = np.argmax(share, axis=0)
        top = share[best, np.arange(n)]
        return [self.langs[b] if ok else "und" for b, ok in zip(best, has, strict=True)], np.where(has, top, 0.0).tolist(), total.astype(int).tolist()


def threshold(want: int, n: int) -> int:
    """The 62-bit hashes below it are ``want`` out of ``n``, or all."""
    return 1 << 62 if n <= want else (want << 62) // n


def train(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, grams_per_lang: int = GRAMS_PER_LANG) -> BitmaskFilter:
    """Fit on ``docs`` (text, lang): at most about ``rows_per_lang`` rows of each language, chosen by the hash of the text.

    A text is in the sample if the upper 62 bits of its hash are below its language's share of them, so a share is never rounded to nothing however many
    rows there are; copies of a text count once. Null labels and texts are left out, an empty table gives a model without languages (all ``und``).
    Languages are ordered by name, which also breaks ties of prediction.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    count = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not count:
        return BitmaskFilter([], np.zeros((1, 1), C.U), np.zeros(0))
    part = F.create_map(*[x for k, n in count.items() for x in (F.lit(k), F.lit(threshold(rows_per_lang, n)))])
    sample = rows.where(F.shiftrightunsigned(F.xxhash64("text", F.lit(17)), 2) < part[F.col("lang")]).distinct()

    def tally(batches):
        C.hold("lang_id")
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist())
            text = batch.column("text")
            _, off = C.utf8(text)
            for i, j in C.slices(off, SLICE_BYTES):
                h, own, _ = grams(text[i:j].to_pylist())
                for name in np.unique(lang[i:j]):
                    values, n = np.unique(h[lang[i:j][own] == name], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(tally, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= grams_per_lang).select("lang", "gram").toPandas()
    langs = sorted(count)
    return BitmaskFilter.build(langs, {k: top.gram[top.lang == k].to_numpy(np.int64).view(C.U) for k in langs})


def predict(docs: DataFrame, model: BitmaskFilter, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (text and any further columns) with lang_pred, score (0 to 1) and n_grams.

    lang_pred is ``und`` and the score 0 if the text is null or has no letter. Columns of these names in docs are replaced.
    """
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score", "n_grams")]
    src = docs.select(*names) if "text" in names else docs.select(*names, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        C.hold("lang_id")
        f = shared.value
        for batch in batches:
            text = batch.column("text").cast(pa.string())
            _, off = C.utf8(text)
            parts = [f.decide(text[i:j].to_pylist()) for i, j in C.slices(off, SLICE_BYTES)]
            cols = [[x for p in parts for x in p[k]] for k in range(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64())], names=[*names, "lang_pred", "score", "n_grams"])

    return src.mapInArrow(run, f"{schema}, lang_pred string, score double, n_grams bigint")


def held_out() -> F.Column:
    """The fold that training never sees: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang; further columns are ignored); trained on the other fold.

    Null, empty and letterless texts are ``und`` with score 0, texts of any length are read whole, ties go to the alphabetically first language, repeated rows keep a
    row each (a null doc_id is not held out), an empty table gives no rows.
    """
    model = train(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
