"""Row-local scoring of many queries against many texts: what the passes over the texts need, as Arrow batch functions.

A block of queries is a small object: its words, which queries have each and how often, and its groups. One pass over the texts keeps, for each, which words it holds and how often (a few bytes a word);
document frequencies and scores are read from that. Every text is scored in its own row and each query's best rows are kept, so no posting is ever shuffled: a partition sends on a query's best ``n`` rows,
whatever its size. What a task holds is a batch of texts, the matches of TEXTS of them and a table of queries and TEXTS: nothing of it grows with the table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from ..functions import minhash as M

#: BM25's k1 and b, and the least idf.
K1, B_LEN, LEAST_IDF = 1.2, 0.75, 1e-6
#: Terms whose words are remembered, and texts scored at a time.
REMEMBERED, TEXTS = 100_000, 512
#: Cells of a table of queries and words that a block of queries may have.
CELLS = 4 << 20
DIGITS = 9


@dataclass
class Asked:
    """Queries ``qids`` over ``words`` (term, prefix). Query ``has[i]`` has the word w, ``times[i]`` times, for i from start[w] to start[w + 1]; alone[i]: the word completes it by itself.
    groups: (query, words) of those of two terms or more."""

    qids: list
    words: list[tuple[str, bool]]
    start: np.ndarray
    has: np.ndarray
    times: np.ndarray
    alone: np.ndarray
    groups: list[tuple[int, np.ndarray]]
    exact: dict[str, list[int]] = field(default_factory=dict)
    begins: dict[str, int] = field(default_factory=dict)
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[object, list[tuple[int, str, bool]]]]) -> Asked:
        """rows: a query's id and its phrases (group, term, prefix)."""
        place: dict[tuple[str, bool], int] = {}
        for _, phrases in rows:
            for _, term, prefix in phrases:
                place.setdefault((term, prefix), len(place))
        times: dict[tuple[int, int], int] = {}
        single, groups = set(), []
        for q, (_, phrases) in enumerate(rows):
            by: dict[int, set[int]] = {}
            for grp, term, prefix in phrases:
                w = place[term, prefix]
                times[w, q] = times.get((w, q), 0) + 1
                by.setdefault(grp, set()).add(w)
            for ws in by.values():
                if len(ws) == 1:
                    single.add((next(iter(ws)), q))
                else:
                    groups.append((q, np.array(sorted(ws))))
        pairs = sorted(times)
        start = np.searchsorted(np.array([w for w, _ in pairs], np.int64), np.arange(len(place) + 1))
        out = cls([i for i, _ in rows], list(place), start, np.array([q for _, q in pairs], np.int64), np.array([times[p] for p in pairs], float), np.array([p in single for p in pairs], bool), groups)
        for i, (term, prefix) in enumerate(out.words):
            if prefix:
                out.begins[term] = i
            else:
                out.exact.setdefault(term, []).append(i)
        return out

    @property
    def word_type(self) -> str:
        return "<u2" if len(self.words) <= 1 << 16 else "<u4"

    def matches(self, term: str) -> tuple[int, ...]:
        """The words that ``term`` is, or begins with."""
        got = self.seen.get(term)
        if got is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            got = self.seen[term] = (*self.exact.get(term, ()), *[self.begins[p] for i in range(1, len(term) + 1) if (p := term[:i]) in self.begins])
        return got

    def counts(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, how many of its terms match the word), by text and word, of the texts (a list column), and the texts' lengths in terms."""
        off = terms.offsets.to_numpy().astype(np.int64)
        flat = terms.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
        if isinstance(flat, pa.ChunkedArray):
            flat = flat.combine_chunks()
        size, names = np.diff(off), flat.dictionary.to_pylist()
        none = np.zeros(0, np.int64)
        if not len(flat) or not len(self.words):
            return none, none, none, size
        own = np.repeat(np.arange(len(size)), size)
        pair, n = np.unique(own * len(names) + flat.indices.to_numpy(), return_counts=True)
        words = [self.matches(t) for t in names]
        many = np.fromiter(map(len, words), np.int64, len(words))
        flat_words = np.fromiter((w for ws in words for w in ws), np.int64, int(many.sum()))
        own, name = pair // len(names), pair % len(names)
        times, at = _spread(np.cumsum(many) - many, many, name)
        key, back = np.unique(np.repeat(own, times) * len(self.words) + flat_words[at], return_inverse=True)
        return key // len(self.words), key % len(self.words), np.bincount(back, np.repeat(n, times), len(key)).astype(np.int64), size


def _spread(start: np.ndarray, many: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many entries each of ``of`` has, and the places of all of them; the entries of i are start[i], start[i] + 1, ..., many[i] of them."""
    times = many[of]
    return times, np.repeat(start[of] - (np.cumsum(times) - times), times) + np.arange(times.sum())


def _slices(batch: pa.RecordBatch):
    for i in range(0, batch.num_rows, TEXTS):
        yield batch.slice(i, TEXTS)


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(values: np.ndarray, n: np.ndarray, kind: str) -> pa.Array:
    """Rows of ``n`` values each as binaries."""
    raw = values.astype(kind)
    off = np.concatenate([[0], np.cumsum(n)]) * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(raw)])


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, and how many each has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).astype(np.int64), np.fromiter(map(len, rows), np.int64, len(rows)) // np.dtype(kind).itemsize


#: Columns that ``met`` puts in the place of a text's terms.
MET = "len int, words binary, times binary"


def met(asked: Asked):
    """Rows (terms, ...) with the words that a text holds and how often instead of its terms."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                own, word, n, size = asked.counts(part.column("terms"))
                many = np.bincount(own, minlength=len(size))
                rest = [i for i, name in enumerate(part.schema.names) if name != "terms"]
                cols = [pa.array(size, pa.int32()), _packed(word, many, asked.word_type), _packed(n, many, "<u4")]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in rest], *cols], names=[*[part.schema.names[i] for i in rest], "len", "words", "times"])

    return run


def count_words(asked: Asked):
    """(word, df, len) of rows of ``met``: in how many texts each word stands; word -1: texts and their terms."""

    def run(batches):
        df, n, size = np.zeros(len(asked.words), np.int64), 0, 0
        for batch in batches:
            for part in _slices(batch):
                df += np.bincount(_unpacked(part.column("words"), asked.word_type)[0], minlength=len(df))
                n, size = n + part.num_rows, size + int(part.column("len").to_numpy(zero_copy_only=False).sum())
        word = np.concatenate([[-1], np.flatnonzero(df)])
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.int32()), pa.array(np.concatenate([[n], df[df > 0]]), pa.int64()), pa.array([size] + [0] * (len(word) - 1), pa.int64())], names=["word", "df", "len"])

    return run


class Kept:
    """Rows (query, key, whole, order, id, extra) of which each query keeps its first ``n`` by (key, order, id), of all rows and of the whole ones."""

    def __init__(self, n: int | None, width: int, extra: int = 0):
        self.n, self.rows = n, [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), np.zeros((0, width)), np.zeros(0, np.int64), np.zeros((0, extra))]

    def add(self, *more: np.ndarray) -> None:
        rows = [np.concatenate([a, b]) for a, b in zip(self.rows, more, strict=True)]
        if self.n is None:
            self.rows = rows
            return
        query, key, whole, order, ids, _ = rows
        at = np.lexsort((ids, *order.T[::-1], key, query))
        keep = np.zeros(len(at), bool)
        for of in (np.ones(len(at), bool), whole):
            sel = at[of[at]]
            q = query[sel]
            first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]])))
            keep[sel[rank < self.n]] = True
        self.rows = [r[keep] for r in rows]


def best_texts(asked: Asked, idf: np.ndarray, mean_len: float, n: int | None, width: int, qid_type: pa.DataType):
    """(qid, id, bm25, whole, order): the best ``n`` texts of each query in this partition (None: all), of all hits and of the whole ones."""

    def out(kept: Kept):
        q, key, whole, order, ids, _ = kept.rows
        cols = [pa.array([asked.qids[i] for i in q.tolist()], qid_type), pa.array(ids), pa.array(key), pa.array(whole.astype(np.int32)), pa.array(list(order), pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(cols, names=["qid", "id", "bm25", "whole", "order"])

    many, grouped = np.diff(asked.start), np.full(len(asked.words), -1)
    some = np.unique(np.concatenate([np.zeros(0, np.int64), *[ws for _, ws in asked.groups]]))
    grouped[some] = np.arange(len(some))

    def run(batches):
        kept = Kept(n, width)
        for batch in batches:
            for part in _slices(batch):
                (word, each), (f, _) = _unpacked(part.column("words"), asked.word_type), _unpacked(part.column("times"), "<u4")
                text, lens = np.repeat(np.arange(part.num_rows), each), part.column("len").to_numpy(zero_copy_only=False)
                ok = part.column("ok").to_numpy(zero_copy_only=False).astype(bool)
                score = idf[word] * f * (K1 + 1) / (f + K1 * (1 - B_LEN + B_LEN * lens / mean_len)[text])
                times, at = _spread(asked.start[:-1], many, word)
                cell, shape = asked.has[at] * part.num_rows + np.repeat(text, times), (len(asked.qids), part.num_rows)
                total = np.bincount(cell, asked.times[at] * np.repeat(score, times), shape[0] * shape[1]).reshape(shape)
                whole = np.zeros(shape, bool)
                whole.reshape(-1)[cell[asked.alone[at]]] = True
                if asked.groups:
                    have, mine = np.zeros((len(some), part.num_rows), bool), grouped[word] >= 0
                    have[grouped[word[mine]], text[mine]] = True
                    for q, ws in asked.groups:
                        whole[q] |= have[grouped[ws]].all(axis=0)
                hit = (total > 0) & ok  # no idf is below LEAST_IDF
                q, d = np.nonzero(hit)
                order = np.array([part.column(f"o{i}").to_numpy(zero_copy_only=False) for i in range(width)], float).reshape(width, part.num_rows).T
                kept.add(q, -np.round(total[q, d], DIGITS), whole[q, d], order[d], _ids(part)[d], np.zeros((len(q), 0)))
            if n is None:
                yield out(kept)
                kept = Kept(n, width)
        yield out(kept)

    return run


def alike_texts(qids: list, signatures: np.ndarray, least: float, n: int, qid_type: pa.DataType):
    """(qid, id, sim, decayed): each query's ``n`` texts of the highest share of equal signature places in this partition, of ``least`` or more. A text comes with its signature (ds), or with its content, which is
    signed here."""

    def run(batches):
        kept = Kept(n, 0, 1)
        for batch in batches:
            for part in _slices(batch):
                ds = part.column("ds") if "ds" in part.schema.names else M.minhash.func(part.column("content"))
                part, ds = part.filter(ds.is_valid()), ds.drop_null()
                sig = ds.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, signatures.shape[1])
                same = np.zeros((len(qids), len(sig)), np.int16)
                for k in range(sig.shape[1]):
                    same += signatures[:, k, None] == sig[None, :, k]
                q, d = np.nonzero(same >= least * sig.shape[1])
                decayed = part.column("decayed").to_numpy(zero_copy_only=False).astype(float)
                kept.add(q, -(same[q, d] / sig.shape[1]), np.zeros(len(q), bool), np.zeros((len(q), 0)), _ids(part)[d], decayed[d, None])
        q, key, _, _, ids, decayed = kept.rows
        yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in q.tolist()], qid_type), pa.array(ids), pa.array(-key), pa.array(decayed[:, 0])], names=["qid", "id", "sim", "decayed"])

    return run
