"""A hierarchical Pitman-Yor language model over word pairs, seated by Gibbs sampling.

Every context (the word before, or a document's start) is a restaurant whose dishes are the words that follow it; all of them share one parent, the restaurant of single words, whose
own parent is uniform over the vocabulary and one unknown word. Each table of a context sends a customer to the parent. A sweep draws the number of tables of every dish from its
conditional law, given the context's other tables and what the parent predicts (customers within tables are summed out: counts up to EXACT by generalised Stirling
numbers, larger ones by the saddle point of the same law); a round sweeps all contexts, sends their tables to the parent, draws its tables, and sends its masses back. Documents are
scored by predictive probabilities averaged over the rounds kept.

Contexts live in buckets ranged by their hash, words in others; a context with more than a fourth of a bucket's share is dealt over all by the hash of the pair, and its number of
tables is summed between rounds. All rows are packed: arrays of hashes of which the most frequent are 2-byte codes. Draws are seeded by round, sweep and bucket, and buckets depend on the
size of the corpus alone, so a lost task is drawn alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Strengths of contexts and of the parent; rounds in all and rounds kept for scoring; sweeps a round.
STRENGTH, ROOT_STRENGTH = 1.0, 1.0
ROUNDS, KEPT, SWEEPS = 3, 2, 2
SEED = 29
#: Counts whose table numbers are drawn from exact weights.
EXACT = 256
#: Words of the code book (what is broadcast is at most 16 bytes each), tokens a bucket of contexts takes, tokens packed at a time, bytes hashed at a time.
CODES = 65_535
BUCKET_TOKENS = 1_500_000
PACK_TOKENS = 1 << 20
SLICE_BYTES = 1 << 22
#: The hashes of a document's start and end, which no word is given on purpose.
START, END = C.U(0x9B1F5EE0A2C43D17), C.U(0x51ED270B6F3A98C5)

ROW = "kind int, k bigint, j bigint, x binary, y binary, z binary, v binary, p bigint, q bigint"
_ARROW = pa.schema([("kind", pa.int32()), ("k", pa.int64()), ("j", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary()), ("v", pa.binary()), ("p", pa.int64()), ("q", pa.int64())])
WORDS, PAIRS, MESSAGE, ANSWER, TABLES, HEAVY, ENTRY, NEW, PARTIAL = range(9)


def _row(kind: int, k: int, j: int = 0, x: bytes = b"", y: bytes = b"", z: bytes = b"", v: bytes = b"", p: int = 0, q: int = 0) -> tuple:
    return kind, k, j, x, y, z, v, int(p), int(q)


def closed(b: bytes) -> bytes:
    """A packed array as it is stored: behind a zero as it is, or behind its length compressed."""
    return b"\0" + b if len(b) < 64 else b"\1" + len(b).to_bytes(8, "little") + pa.compress(b, "zstd", asbytes=True)


def opened(b: bytes) -> bytes:
    return b[1:] if b[:1] == b"\0" else pa.decompress(b[9:], int.from_bytes(b[1:9], "little"), "zstd", asbytes=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    rows = [(*r[:3], *map(closed, r[3:7]), *r[7:]) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _rows(table: pa.Table) -> list[dict]:
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["j"], r["p"], r["k"]))
    for r in rows:
        r.update((c, opened(r[c])) for c in "xyzv")
    return rows


# ---- packing ---------------------------------------------------------------------------------------


def small(a: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes each that all of them fit."""
    top = int(a.max()) if len(a) else 0
    size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([size]) + a.astype(f"<u{size}").tobytes()


def unsmall(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64) if b else np.zeros(0, np.int64)


def encode(w: np.ndarray, codes: np.ndarray) -> bytes:
    """64-bit hashes as 2-byte places in the sorted code book, those outside it (0) in full behind."""
    at = np.searchsorted(codes, w)
    at[at == len(codes)] = 0
    hit = codes[at] == w if len(codes) else np.zeros(len(w), bool)
    return len(w).to_bytes(4, "little") + np.where(hit, at + 1, 0).astype("<u2").tobytes() + w[~hit].tobytes()


def decode(b: bytes, codes: np.ndarray) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    at = np.frombuffer(b, "<u2", n, 4)
    out = np.empty(n, C.U)
    miss = at == 0
    out[~miss] = codes[at[~miss].astype(np.int64) - 1]
    out[miss] = np.frombuffer(b, C.U, offset=4 + 2 * n)
    return out


def _group(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    cuts = C.group_cuts(sorted_keys)
    return cuts[:-1], np.diff(cuts)


# ---- tokens ----------------------------------------------------------------------------------------


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's context, word and row: the words of every text (A-Z lower-cased) and one end."""
    words, first = C.word_hashes(raw, off)
    word = np.insert(words, first[1:], END)
    n = len(off) - 1
    start = first[:-1] + np.arange(n)
    context = np.empty(len(word), C.U)
    context[1:] = word[:-1]
    context[start] = START
    return context, word, np.repeat(np.arange(n), np.diff(first) + 1)


def _pieces(batches, keyed: bool):
    """(first key, contexts, words, rows) of at most PACK_TOKENS tokens of rows whose keys follow on each other; a long text may be parted, its contexts stay."""
    held, size, base, count = [], 0, 0, 0

    def release():
        nonlocal held, size, count
        context, word, row = (np.concatenate([h[i] for h in held]) for i in range(3))
        held, size, count = [], 0, 0
        for i in range(0, len(word), PACK_TOKENS):
            yield base, context[i : i + PACK_TOKENS], word[i : i + PACK_TOKENS], row[i : i + PACK_TOKENS]

    for batch in batches:
        raw, off = C.utf8(batch.column("text"))
        keys = batch.column("key").to_numpy() if keyed else None
        for i, j in C.slices(off, SLICE_BYTES):
            cuts = [i, *(i + 1 + np.flatnonzero(np.diff(keys[i:j]) != 1)).tolist(), j] if keyed else [i, j]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and (size >= PACK_TOKENS or keyed and int(keys[a]) != base + count):
                    yield from release()
                if not held and keyed:
                    base = int(keys[a])
                context, word, row = tokens(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                held.append((context, word, row + count))
                size, count = size + len(word), count + b - a
        C.forget_powers()
    if held:
        yield from release()


@dataclass
class Deal:
    """How contexts and words are dealt to buckets: by the upper bits of their hashes."""

    context_bits: int
    word_bits: int
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, C.U))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    heavy: np.ndarray = field(default_factory=lambda: np.zeros(0, C.U))
    heavy_customers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def of_pairs(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        key = u
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, u), len(self.heavy) - 1)
            key = np.where(self.heavy[at] == u, C.mix64(u * C.U(0x9E3779B97F4A7C15) + w), u)
        return (key >> C.U(64 - self.context_bits)).astype(np.int64)

    def of_words(self, w: np.ndarray) -> np.ndarray:
        return (w >> C.U(64 - self.word_bits)).astype(np.int64)


def _count_words(bits: int):
    def run(batches):
        C.hold("pitman_yor")
        out = []
        for _, _, word, _ in _pieces(batches, False):
            w, n = np.unique(word, return_counts=True)
            starts, sizes = _group((w >> C.U(64 - bits)).astype(np.int64))
            out = [_row(WORDS, int(w[a] >> C.U(64 - bits)), x=w[a : a + m].tobytes(), y=small(n[a : a + m])) for a, m in zip(starts.tolist(), sizes.tolist(), strict=True)]
            yield _batch(out)

    return run


def _sum_words(key, table):
    rows = _rows(table)
    w, at = np.unique(np.concatenate([np.frombuffer(r["x"], C.U) for r in rows]), return_inverse=True)
    n = np.bincount(at, np.concatenate([unsmall(r["y"]) for r in rows]), len(w)).astype(np.int64)
    return _table([_row(WORDS, rows[0]["k"], x=w.tobytes(), y=small(n), z=small(np.ones(len(w), np.int64)), p=n.sum(), q=len(w))])


def _ids(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes among a piece's contexts and words, in order, and the place of each token's context and word."""
    known, at = np.unique(np.concatenate([word, context[:1], [START]]), return_inverse=True)
    own, begin = at[:-2], at[-1]
    before = np.empty(len(word), np.int64)
    before[0] = at[-2]
    before[1:] = own[:-1]
    before[context == START] = begin
    return known, before, own


def _pack_pairs(deal: Deal):
    """Counted pairs of each piece, a row a bucket: contexts, how many pairs each has, words, counts."""

    def run(batches):
        C.hold("pitman_yor")
        for _, context, word, _ in _pieces(batches, False):
            known, before, own = _ids(context, word)
            key, n = np.unique(before << 32 | own, return_counts=True)
            u, w = known[key >> 32], known[key & 0xFFFFFFFF]
            b = deal.of_pairs(u, w)
            order = np.argsort(b, kind="stable")
            u, w, n, b = u[order], w[order], n[order], b[order]
            out = []
            for a, m in zip(*(x.tolist() for x in _group(b)), strict=True):
                at, size = _group(u[a : a + m])
                out.append(_row(PAIRS, int(b[a]), x=encode(u[a : a + m][at], deal.codes), v=small(size), y=encode(w[a : a + m], deal.codes), z=small(n[a : a + m])))
            yield _batch(out)

    return run


class Bucket:
    """A bucket's contexts: pairs in the order of context and word, ``c`` customers each."""

    def __init__(self, row: dict | None, deal: Deal):
        self.deal = deal
        empty = row is None
        self.u = np.zeros(0, C.U) if empty else decode(row["x"], deal.codes)
        self.size = np.zeros(0, np.int64) if empty else unsmall(row["v"])
        w = np.zeros(0, C.U) if empty else decode(row["y"], deal.codes)
        self.c = np.zeros(0, np.int64) if empty else unsmall(row["z"])
        self.ui = np.repeat(np.arange(len(self.u)), self.size)
        self.words, self.wi = np.unique(w, return_inverse=True)
        self.many = np.flatnonzero(self.c > 1)
        self.key = self.ui << 32 | self.wi
        self.heavy = np.full(len(self.u), -1)
        if len(deal.heavy) and len(self.u):
            at = np.minimum(np.searchsorted(deal.heavy, self.u), len(deal.heavy) - 1)
            self.heavy = np.where(deal.heavy[at] == self.u, at, -1)

    def contexts(self, u: np.ndarray) -> np.ndarray:
        """Places of contexts here; behind them that of all unknown ones, and those of heavy ones without a pair here."""
        out = np.full(len(u), len(self.u))
        for known, first in ((self.deal.heavy, len(self.u) + 1), (self.u, 0)):
            if len(known):
                at = np.minimum(np.searchsorted(known, u), len(known) - 1)
                out = np.where(known[at] == u, first + at, out)
        return out

    def tables(self, t: np.ndarray) -> np.ndarray:
        """Tables of each context here, for ``t`` of the pairs with more than one customer."""
        return self.size + np.bincount(self.ui[self.many], t - 1, len(self.u)).astype(np.int64)

    def customers(self) -> np.ndarray:
        own = np.bincount(self.ui, self.c, len(self.u)).astype(np.int64)
        return np.where(self.heavy >= 0, self.deal.heavy_customers[self.heavy] if len(self.deal.heavy) else own, own)

    def message(self, b: int, t: np.ndarray) -> list[tuple]:
        """The tables of each word here, to the words' buckets."""
        n = np.bincount(self.wi, minlength=len(self.words)) + np.bincount(self.wi[self.many], t - 1, len(self.words)).astype(np.int64)
        to = self.deal.of_words(self.words)
        return [_row(MESSAGE, int(to[a]), b, encode(self.words[a : a + m], self.deal.codes), small(n[a : a + m]), p=n[a : a + m].sum()) for a, m in zip(*(x.tolist() for x in _group(to)), strict=True)]

    def state(self, b: int, t: np.ndarray) -> list[tuple]:
        own = self.tables(t)
        return [_row(TABLES, b, x=small(t)), *[_row(HEAVY, int(self.heavy[i]), b, p=own[i]) for i in np.flatnonzero(self.heavy >= 0)], *self.message(b, t)]


def _merge_pairs(deal: Deal):
    def run(key, table):
        C.hold("pitman_yor")
        rows = _rows(table)
        b = rows[0]["k"]
        us, u_at = np.unique(np.concatenate([np.repeat(decode(r["x"], deal.codes), unsmall(r["v"])) for r in rows]), return_inverse=True)
        ws, w_at = np.unique(np.concatenate([decode(r["y"], deal.codes) for r in rows]), return_inverse=True)
        pair, at = np.unique(u_at << 32 | w_at, return_inverse=True)
        n = np.bincount(at, np.concatenate([unsmall(r["z"]) for r in rows]), len(pair)).astype(np.int64)
        _, size = _group(pair >> 32)
        row = _row(PAIRS, b, x=encode(us, deal.codes), v=small(size), y=encode(ws[pair & 0xFFFFFFFF], deal.codes), z=small(n), p=(n == 1).sum(), q=(n == 2).sum())
        return _table([row])

    return run


def _one_table_each(deal: Deal):
    """The first state of each bucket: one table a pair."""

    def run(batches):
        C.hold("pitman_yor")
        for batch in batches:
            for row in _rows(pa.Table.from_batches([batch])):
                own = Bucket(row, deal)
                yield _batch(own.state(row["k"], np.ones(len(own.many), np.int64)))

    return run


# ---- seating ---------------------------------------------------------------------------------------

_stirling: dict[float, np.ndarray] = {}


def stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c and t up to EXACT."""
    if discount not in _stirling:
        _stirling.clear()
        s = np.full((EXACT + 1, EXACT + 1), -np.inf)
        s[1, 1] = 0.0
        for c in range(1, EXACT):
            t = np.arange(1, c + 1)
            s[c + 1, 1 : c + 1] = s[c, 1 : c + 1] + np.log(c - discount * t)
            s[c + 1, 2 : c + 2] = np.logaddexp(s[c + 1, 2 : c + 2], s[c, 1 : c + 1])
        _stirling[discount] = s
    return _stirling[discount]


def saddle(c: np.ndarray, a: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the number of tables of ``c`` customers where a new one weighs ``a``: sizes of tables are tilted by r so that they come to c on average."""
    low, high = np.full(len(c), -80.0), np.zeros(len(c))
    log_c, log_a = np.log(c), np.log(a)
    for _ in range(60):
        mid = (low + high) / 2
        above = log_a + np.log(-np.expm1(mid)) + (discount - 1) * mid > log_c
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    r = -np.expm1(low)
    phi = -np.expm1(discount * low)
    one = r * discount * np.exp((discount - 1) * low) / phi
    two = r * r * discount * (1 - discount) * np.exp((discount - 2) * low) / phi + one
    tables = a * phi / discount
    return 1 + tables * (c - 1) / c, np.maximum(tables * (1 - one * one / two), 0.0)


def draw_tables(rng: np.random.Generator, c: np.ndarray, parent: np.ndarray, others: np.ndarray, strength: float, discount: float) -> np.ndarray:
    """The number of tables of each dish: ``c`` customers, ``parent``'s probability of it, ``others`` tables in its restaurant. Weight of t: S(c, t) times the product over i < t of parent * (strength + discount * (others + i))."""
    out = np.ones(len(c), np.int64)
    base = strength + discount * others
    few = np.flatnonzero((c > 1) & (c <= EXACT))
    if len(few):
        n = c[few]
        start = np.concatenate([[0], np.cumsum(n)])[:-1]
        t = np.arange(int(n.sum())) - np.repeat(start, n) + 1
        grow = np.cumsum(np.log(np.repeat(parent[few], n)) + np.log(np.repeat(base[few], n) + discount * (t - 1)))
        before = np.concatenate([[0.0], grow])[start]
        weight = stirling(discount)[np.repeat(n, n), t] + grow - np.repeat(before, n)
        weight = np.exp(weight - np.repeat(np.maximum.reduceat(weight, start), n))
        total = np.cumsum(weight)
        ends = start + n - 1
        left = np.concatenate([[0.0], total])[start]
        at = np.searchsorted(total, left + rng.random(len(few)) * (total[ends] - left), side="right")
        out[few] = np.clip(at, start, ends) - start + 1
    most = np.flatnonzero(c > EXACT)
    if len(most):
        n, mean = c[most].astype(float), np.ones(len(most))
        for _ in range(3):  # half of a dish's own tables count among the others of a new one, on average
            mean, var = saddle(n, parent[most] * (base[most] + discount * (mean - 1) / 2), discount)
        mean = np.maximum(mean - 1, 1e-12)
        p = np.clip(1 - var / mean, 1e-9, 1.0)
        drawn = np.where(p < 1e-6, rng.poisson(np.minimum(mean, 1e15)), rng.binomial(np.maximum(np.rint(np.minimum(mean / p, 1e15)), 1).astype(np.int64), p))
        out[most] = np.clip(1 + drawn, 1, c[most])
    return out


@dataclass
class Root:
    """What all buckets know of the parent in one round: its customers and tables, the vocabulary, strength and discount."""

    customers: int
    tables: int
    vocabulary: int
    discount: float
    strength: float = ROOT_STRENGTH

    def probability(self, mass: np.ndarray) -> np.ndarray:
        """Of words whose customers less discounted tables are ``mass`` (0: unknown)."""
        return (mass + (self.strength + self.discount * self.tables) / (self.vocabulary + 1)) / (self.strength + self.customers)


def _seat_words(codes: np.ndarray, turn: int, root: Root, last: bool):
    """A round of the parent: its tables are drawn and its masses answered to the buckets that asked, in the last round with the words' counts."""

    def run(key, table):
        C.hold("pitman_yor")
        rows = _rows(table)
        own = rows[0]
        words, tables = np.frombuffer(own["x"], C.U), unsmall(own["z"])
        asked = [(r["j"], np.searchsorted(words, decode(r["x"], codes)), unsmall(r["y"])) for r in rows[1:]]
        n = np.bincount(np.concatenate([a for _, a, _ in asked]), np.concatenate([m for _, _, m in asked]), len(words)).astype(np.int64)
        rng = np.random.default_rng([SEED, turn, 0, own["k"]])
        for _ in range(SWEEPS):
            tables = draw_tables(rng, n, np.full(len(n), 1 / (root.vocabulary + 1)), np.maximum(root.tables - tables, 0), root.strength, root.discount)
        mass, count = (n - root.discount * tables).astype("<f4"), unsmall(own["y"])
        out = [_row(WORDS, own["k"], x=own["x"], y=own["y"], z=small(tables), v=mass.tobytes(), p=tables.sum(), q=n.sum())]
        return _table(out + [_row(ANSWER, b, own["k"], mass[a].tobytes(), small(count[a]) if last else b"") for b, a, _ in asked])

    return run


def _seat_contexts(deal: Deal, turn: int, root: Root, discount: float, heavy_tables: np.ndarray):
    """A round of the contexts of a bucket: the tables of pairs with more than one customer; others have one."""

    def run(key, table):
        C.hold("pitman_yor")
        rows = _rows(table)
        own, b = Bucket(rows[0], deal), rows[0]["k"]
        parent = root.probability(np.concatenate([np.frombuffer(r["x"], "<f4") for r in rows if r["kind"] == ANSWER]).astype(float))
        t = next(unsmall(r["x"]) for r in rows if r["kind"] == TABLES)
        rng = np.random.default_rng([SEED, turn, 1, b])
        first = own.tables(t)
        elsewhere = np.where(own.heavy >= 0, heavy_tables[own.heavy] - first, 0) if len(heavy_tables) else np.zeros(len(first), np.int64)
        c, p, ui = own.c[own.many], parent[own.wi[own.many]], own.ui[own.many]
        for _ in range(SWEEPS):
            t = draw_tables(rng, c, p, (own.tables(t) + elsewhere)[ui] - t, STRENGTH, discount)
        return _table(own.state(b, t))

    return run


# ---- training --------------------------------------------------------------------------------------


@dataclass
class Round:
    """A kept sample: the parent's totals, the tables of pairs with the answers of words, the words' masses, and the tables of heavy contexts."""

    root: Root
    seated: DataFrame
    words: DataFrame
    heavy_tables: np.ndarray


@dataclass
class Model:
    """Tables in the shared folder and what the driver knows of them."""

    deal: Deal
    tokens: int
    vocabulary: int
    discount: float
    pairs: DataFrame | None = None
    kept: list[Round] = field(default_factory=list)


def _grouped(rows: DataFrame, run, bits: int) -> DataFrame:
    """``run`` over the rows of each of 2 ** bits buckets, a bucket a task where there are more of them than shuffle partitions."""
    return rows.repartition(max(C.shuffle_partitions(rows.sparkSession), 1 << bits), "k").groupBy("k").applyInArrow(run, ROW)


def _total(rows: DataFrame, column: str) -> int:
    return int(rows.agg(F.sum(column)).first()[0] or 0)


def _code_book(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, at most CODES, in the order of their hashes, and their counts: all above a threshold read off a histogram of counts (eight steps an octave)."""

    def step(n: np.ndarray) -> np.ndarray:
        octave = np.floor(np.log2(n)).astype(np.int64)
        return octave * 8 + np.floor((n / 2.0**octave - 1) * 8).astype(np.int64)

    def histogram(batches):
        for batch in batches:
            for y in batch.column("y").to_pylist():
                s, n = np.unique(step(unsmall(opened(y))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n)], names=["s", "n"])

    steps = {r.s: r.n for r in words.select("y").mapInArrow(histogram, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).collect()}
    least, total = max(steps) + 1, 0
    for s in sorted(steps, reverse=True):
        total += steps[s]
        if total > CODES:
            break
        least = s

    def top(batches):
        for batch in batches:
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                w, n = np.frombuffer(opened(x), np.int64), unsmall(opened(y))
                ok = step(n) >= least
                yield pa.RecordBatch.from_arrays([pa.array(w[ok]), pa.array(n[ok])], names=["w", "n"])

    got = words.select("x", "y").mapInArrow(top, "w bigint, n bigint").toPandas()
    codes = got.w.to_numpy(np.int64).view(C.U)
    order = np.argsort(codes)
    return codes[order], got.n.to_numpy(np.int64)[order]


def train(docs: DataFrame, rounds: int = ROUNDS, kept: int = KEPT) -> Model:
    """Fit on the texts of ``docs`` (text; null: empty). An empty table gives a model that knows no word."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "pitman_yor", tidy=True)
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    bits = max(1, (C.pow2_at_least(((seen["size"] or 0) / 6 + seen.n) / BUCKET_TOKENS)).bit_length() - 1)
    deal = Deal(bits, max(1, bits - 2))
    model = Model(deal, 0, 0, 0.5)
    if not seen.n:
        return model
    words = scratch.put("words", _grouped(docs.mapInArrow(_count_words(deal.word_bits), ROW), _sum_words, deal.word_bits))
    model.tokens, model.vocabulary = _total(words, "p"), _total(words, "q")
    deal.codes, deal.counts = _code_book(words)
    most = model.tokens / (4 << bits)
    heavy = {int(w): int(n) for w, n in zip(deal.codes, deal.counts, strict=True) if n > most} | ({int(START): seen.n} if seen.n > most else {})
    heavy.pop(int(END), None)
    deal.heavy = np.array(sorted(heavy), C.U)
    deal.heavy_customers = np.array([heavy[w] for w in sorted(heavy)], np.int64)
    model.pairs = scratch.put("pairs", _grouped(docs.mapInArrow(_pack_pairs(deal), ROW), _merge_pairs(deal), deal.context_bits))
    state = model.pairs.mapInArrow(_one_table_each(deal), ROW)
    ones = model.pairs.agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    model.discount = float(np.clip(ones.p / max(1, ones.p + 2 * ones.q), 0.05, 0.95))
    once, twice = (_total(words.select("y").mapInArrow(_of_count(n), "n bigint"), "n") for n in (1, 2))
    root = Root(0, model.vocabulary, model.vocabulary, float(np.clip(once / max(1, once + 2 * twice), 0.05, 0.95)))
    for turn in range(rounds + 1):
        message = state.where(F.col("kind") == MESSAGE)
        seated = scratch.put(f"words-{turn}", _grouped(words.where(F.col("kind") == WORDS).unionByName(message), _seat_words(deal.codes, turn, root, turn == rounds), deal.word_bits))
        words, answers = seated.where(F.col("kind") == WORDS), seated.where(F.col("kind") == ANSWER)
        root = Root(_total(words, "q"), _total(words, "p"), model.vocabulary, root.discount)
        # the messages have been read: only what is small of the round stays
        tables = scratch.put(f"tables-{turn}", state.where(F.col("kind").isin(TABLES, HEAVY)))
        if turn == 0:
            scratch.drop("words")
        else:
            scratch.drop(f"contexts-{turn - 1}", *[] if turn - 1 > rounds - kept else [f"words-{turn - 1}", f"tables-{turn - 1}"])
        heavy_tables = np.zeros(len(deal.heavy), np.int64)
        for r in tables.where(F.col("kind") == HEAVY).groupBy("k").agg(F.sum("p").alias("p")).collect():
            heavy_tables[r.k] = r.p
        tables = tables.where(F.col("kind") == TABLES)
        if turn > rounds - kept:
            model.kept.append(Round(root, tables.unionByName(answers), words, heavy_tables))
        if turn < rounds:
            state = scratch.put(f"contexts-{turn}", _grouped(model.pairs.unionByName(tables).unionByName(answers), _seat_contexts(deal, turn, root, model.discount, heavy_tables), deal.context_bits))
    return model


def _of_count(n: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int((unsmall(opened(y)) == n).sum()) for y in batch.column("y").to_pylist()], pa.int64())], names=["n"])

    return run


# ---- scoring ---------------------------------------------------------------------------------------


def _pack_entries(deal: Deal):
    """Pairs of each piece with the rows they stand in, a row a bucket."""

    def run(batches):
        C.hold("pitman_yor")
        for base, context, word, row in _pieces(batches, True):
            known, before, own = _ids(context, word)
            low = int(row[0])
            key, n = np.unique((before << 42) | (own << 21) | (row - low), return_counts=True)
            u, w, row = known[key >> 42], known[key >> 21 & 0x1FFFFF], key & 0x1FFFFF
            b = deal.of_pairs(u, w)
            order = np.argsort(b, kind="stable")
            u, w, n, b, row = u[order], w[order], n[order], b[order], row[order]
            out = []
            for a, m in zip(*(x.tolist() for x in _group(b)), strict=True):
                part = slice(a, a + m)
                at, size = _group(u[part])
                out.append(_row(ENTRY, int(b[a]), base + low, encode(u[part][at], deal.codes), encode(w[part], deal.codes), small(row[part]), small(size) + small(n[part]), p=len(size)))
            yield _batch(out)

    return run


def _partial(base: int, order: int, row: np.ndarray, n: np.ndarray, score: np.ndarray, plain: np.ndarray, known: np.ndarray) -> tuple:
    """Sums over entries (n times log probabilities) of each row."""
    rows, at = np.unique(row, return_inverse=True)
    total = lambda x: np.bincount(at, x, len(rows))
    return _row(PARTIAL, base, order, small(rows), total(n * score).astype("<f8").tobytes(), total(n * plain).astype("<f8").tobytes(), small(total(n * known).astype(np.int64)) + small(total(n).astype(np.int64)), p=len(rows))


def _plain(count: np.ndarray, tokens: int, vocabulary: int) -> np.ndarray:
    return np.log10((count + 1.0) / (tokens + vocabulary + 1.0))


def _score_bucket(deal: Deal, n_tokens: int, vocabulary: int, discount: float, roots: list[Root], heavy: list[np.ndarray]):
    def run(key, table):
        C.hold("pitman_yor")
        rows = _rows(table)
        b = rows[0]["k"]
        own = Bucket(next((r for r in rows if r["kind"] == PAIRS), None), deal)
        customers = own.customers()
        # what each context leaves to the parent: those here, an unknown one, and the heavy ones wherever they are
        share, lead = np.zeros(len(own.c)), np.ones((len(roots), len(own.u) + 1 + len(deal.heavy)))
        parent = np.zeros((len(roots), len(own.words)))
        count = np.zeros(len(own.words), np.int64)
        for s, (root, heavy_tables) in enumerate(zip(roots, heavy, strict=True)):
            if len(deal.heavy):
                lead[s, len(own.u) + 1 :] = (STRENGTH + discount * heavy_tables) / (STRENGTH + deal.heavy_customers)
            if not len(own.u):
                continue
            # the rows of kept round s are told by their q
            answers = [r for r in rows if r["kind"] == ANSWER and r["q"] == s]
            parent[s] = root.probability(np.concatenate([np.frombuffer(r["x"], "<f4") for r in answers]).astype(float))
            count = np.concatenate([unsmall(r["y"]) for r in answers])  # of the last round, at last
            t = np.ones(len(own.c), np.int64)
            t[own.many] = next(unsmall(r["x"]) for r in rows if r["kind"] == TABLES and r["q"] == s)
            tables = own.tables(t[own.many])
            if len(heavy_tables):
                tables = np.where(own.heavy >= 0, heavy_tables[own.heavy], tables)
            share += (own.c - discount * t) / (STRENGTH + customers[own.ui]) / len(roots)
            lead[s, : len(own.u)] = (STRENGTH + discount * tables) / (STRENGTH + customers)
        plain = _plain(count, n_tokens, vocabulary)
        out, new = [], []
        for r in rows:
            if r["kind"] != ENTRY:
                continue
            u, w, row = decode(r["x"], deal.codes), decode(r["y"], deal.codes), unsmall(r["z"])
            cut = 1 + r["v"][0] * r["p"]
            n, size = unsmall(r["v"][cut:]), unsmall(r["v"][:cut])
            ui = np.repeat(own.contexts(u), size)
            wi = np.minimum(np.searchsorted(own.words, w), max(0, len(own.words) - 1))
            met = own.words[wi] == w if len(own.words) else np.zeros(len(w), bool)
            if not met.all():
                miss = ~met
                new.append((w[miss], lead[:, ui[miss]], np.full(int(miss.sum()), r["j"]), row[miss], n[miss]))
                ui, wi, row, n = ui[met], wi[met], row[met], n[met]
            if len(wi):
                key = ui << 32 | wi
                at = np.minimum(np.searchsorted(own.key, key), len(own.key) - 1)
                p = np.where(own.key[at] == key, share[at], 0.0) + (lead[:, ui] * parent[:, wi]).mean(axis=0)
                out.append(_partial(r["j"], 2 * b, row, n, np.log10(p), plain[wi], np.ones(len(wi))))
        if new:
            w, base, row, n = (np.concatenate([x[i] for x in new]) for i in (0, 2, 3, 4))
            mass = np.concatenate([x[1] for x in new], axis=1)
            order = np.argsort(w, kind="stable")
            w, base, row, n, mass = w[order], base[order], row[order], n[order], mass[:, order].astype("<f4")
            for a, m in zip(*(x.tolist() for x in _group(deal.of_words(w))), strict=True):
                part = slice(a, a + m)
                out.append(_row(NEW, int(deal.of_words(w[a : a + 1])[0]), b, encode(w[part], deal.codes), np.ascontiguousarray(mass[:, part]).tobytes(), base[part].tobytes(), small(row[part]) + small(n[part])))
        return _table(out)

    return run


def _score_new(deal: Deal, n_tokens: int, vocabulary: int, roots: list[Root]):
    """Words that their bucket of contexts has not met: what the context leaves to the parent, times the parent's probability."""

    def run(key, table):
        C.hold("pitman_yor")
        rows = _rows(table)
        owns = [r for r in rows if r["kind"] == WORDS]
        words = np.frombuffer(owns[0]["x"], C.U) if owns else np.zeros(0, C.U)
        counts = unsmall(owns[0]["y"]) if owns else np.zeros(0, np.int64)
        masses = [np.frombuffer(next(r["v"] for r in owns if r["p"] == s), "<f4").astype(float) if owns else np.zeros(0) for s in range(len(roots))]
        out = []
        for r in rows:
            if r["kind"] != NEW:
                continue
            w, base = decode(r["x"], deal.codes), np.frombuffer(r["z"], np.int64)
            lead = np.frombuffer(r["y"], "<f4").reshape(len(roots), len(w)).astype(float)
            cut = 1 + r["v"][0] * len(w)
            row, n = unsmall(r["v"][:cut]), unsmall(r["v"][cut:])
            at = np.minimum(np.searchsorted(words, w), max(0, len(words) - 1))
            met = words[at] == w if len(words) else np.zeros(len(w), bool)
            p = np.zeros(len(w))
            for s, root in enumerate(roots):
                p += lead[s] * root.probability(np.where(met, masses[s][at], 0.0) if len(words) else np.zeros(len(w))) / len(roots)
            c = np.where(met, counts[at], 0) if len(words) else np.zeros(len(w), np.int64)
            plain = _plain(c, n_tokens, vocabulary)
            order = np.argsort(base, kind="stable")
            for a, m in zip(*(x.tolist() for x in _group(base[order])), strict=True):
                part = order[a : a + m]
                out.append(_partial(int(base[part[0]]), 2 * r["j"] + 1, row[part], n[part], np.log10(p[part]), plain[part], c[part] > 0))
        return _table(out)

    return run


_SCORES = "key bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _sum_partials(key, table):
    rows = _rows(table)
    at = [unsmall(r["x"]) for r in rows]
    n = 1 + max(int(a[-1]) for a in at)
    sums = np.zeros((4, n))
    for a, r in zip(at, rows, strict=True):
        cut = 1 + r["v"][0] * r["p"]
        for i, x in enumerate((unsmall(r["v"][cut:]), unsmall(r["v"][:cut]), np.frombuffer(r["z"], "<f8"), np.frombuffer(r["y"], "<f8"))):
            sums[i][a] += x
    some = np.flatnonzero(sums[0] > 0)
    return pa.table({"key": rows[0]["k"] + some, "n_tokens": sums[0][some].astype(np.int64), "n_known": sums[1][some].astype(np.int64), "base_score": sums[2][some], "score": sums[3][some]})


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` (text and any others) with n_tokens, n_known, base_score (add-one unigrams) and score, base-10 logarithms of the whole text's probability."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "pitman_yor-score", tidy=True)
    deal = model.deal
    rows = C.settled(docs, scratch).withColumn("key", F.monotonically_increasing_id())
    texts = rows.select("key", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = texts.mapInArrow(_pack_entries(deal), ROW)
    roots = [r.root for r in model.kept] or [Root(0, 0, 0, 0.5)]
    if model.pairs is not None:
        parts = parts.unionByName(model.pairs)
    for i, r in enumerate(model.kept):
        parts = parts.unionByName(r.seated.withColumn("q", F.lit(i).cast("bigint")))
    heavy = [r.heavy_tables for r in model.kept] or [np.zeros(0, np.int64)]
    scored = scratch.put("scored", _grouped(parts, _score_bucket(deal, model.tokens, model.vocabulary, model.discount, roots, heavy), deal.context_bits))
    new = scored.where(F.col("kind") == NEW)
    for i, r in enumerate(model.kept):
        new = new.unionByName(r.words.withColumn("p", F.lit(i).cast("bigint")))
    more = _grouped(new, _score_new(deal, model.tokens, model.vocabulary, roots), deal.word_bits)
    sums = scored.where(F.col("kind") == PARTIAL).unionByName(more).groupBy("k").applyInArrow(_sum_partials, _SCORES)
    by_row = sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return rows.select("key", *keep).join(by_row, "key").drop("key")


def fold() -> F.Column:
    """The fold that training never sees: crc32(doc_id as text) mod 7 is 2 (a null doc_id is not held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity for every row of ``docs`` (doc_id, text; further columns are ignored); trained on the other fold.

    Null, empty and blank texts are one token, the end; texts of any length are read whole, repeated rows count and are scored one by one, an empty table gives no rows. Where nothing is trained on, every word is unknown.
    """
    model = train(docs.where(~fold()))
    out = score(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", fold().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
