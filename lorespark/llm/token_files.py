"""Token-id files with Elias-Fano document boundaries.

A segment is one file image: a header, the Elias-Fano code of the end offset of every document, the Elias-Fano code of the document
ids (ascending), samples for ``select``, and the concatenated id array. Elias-Fano keeps n ascending numbers below u in about
``2 + log2(u/n)`` bits each; ``select`` finds the i-th without decoding the others, so there is no table of 64-bit offsets.

Documents are range-partitioned by id, encoded in that order and cut into segments; segments are stored as binary rows of a
Parquet table in the shared folder, which every Spark file system can hold, and are read back from it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import SLICE, default_vocabulary, encoder

#: Fixed format values: magic, version; ids of one segment (target); distance of select samples.
MAGIC, VERSION = b"LSEF", 1
SEGMENT_IDS = 1 << 20
SAMPLE = 64
#: Text bytes that one task encodes.
BYTES_PER_TASK = 256 << 20
_HEAD = struct.Struct("<4sBBxxQQQ")
_EF = struct.Struct("<BxxxxxxxQQq")


class EliasFano:
    """n ascending integers; ``lows`` l bits each, ``highs`` a bit vector with a one at (x >> l) + i for the i-th number x."""

    def __init__(self, n: int, universe: int, base: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.base, self.low_bits, self.lows, self.highs, self.samples = n, universe, base, low_bits, lows, highs, samples
        self._highs: bytes | None = None

    @classmethod
    def of(cls, x: np.ndarray) -> EliasFano:
        n = len(x)
        base = int(x[0]) if n else 0
        v = (x.astype(np.int64) - base).astype(C.U) if n else np.zeros(0, C.U)
        u = int(v[-1]) + 1 if n else 1
        low_bits = max(0, (u // max(n, 1)).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(low_bits, dtype=C.U)) & C.U(1)).astype(np.uint8) if low_bits else np.zeros((n, 0), np.uint8)
        ones = (v >> C.U(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, u, base, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def dump(self) -> bytes:
        return _EF.pack(self.low_bits, self.n, len(self.highs), self.base) + self.lows.tobytes() + self.highs.tobytes() + self.samples.tobytes()

    @classmethod
    def load(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        low_bits, n, n_high, base = _EF.unpack_from(raw, at)
        at += _EF.size
        n_low, n_samples = -(-n * low_bits // 8), -(-n // SAMPLE)
        lows = np.frombuffer(raw, np.uint8, n_low, at)
        highs = np.frombuffer(raw, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(raw, "<u4", n_samples, at + n_low + n_high)
        return cls(n, 0, base, low_bits, lows, highs, samples), at + n_low + n_high + 4 * n_samples

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        chunk = int.from_bytes(self._lows[a // 8 : (a + self.low_bits + 7) // 8], "little")
        return (chunk >> (a % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th number: from the sample before it, ones are counted forward through at most SAMPLE - 1 of them."""
        if self._highs is None:  # plain bytes are quicker to index one by one
            self._highs, self._lows, self._samples = self.highs.tobytes(), self.lows.tobytes(), self.samples.tolist()
        highs = self._highs
        pos, left = self._samples[i // SAMPLE], i % SAMPLE
        byte = pos >> 3
        word = highs[byte] >> (pos & 7) << (pos & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = highs[byte]
        for _ in range(left):
            word &= word - 1
        bit = (word & -word).bit_length() - 1
        return self.base + (((byte << 3) + bit - i) << self.low_bits | self._low(i))

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        v = (ones - np.arange(self.n)).astype(C.U) << C.U(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(C.U)
            v = v | (bits << np.arange(self.low_bits, dtype=C.U)).sum(axis=1, dtype=C.U)
        return v.astype(np.int64) + self.base


def pack_segment(doc_ids: list[int | None], encoded: list[bytes]) -> bytes:
    """A segment of documents (u32 id bytes each) in ascending id order, those without an id first."""
    ends = np.cumsum([0, *(len(e) // 4 for e in encoded)])
    ids = np.frombuffer(b"".join(encoded), "<u4")
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    head = _HEAD.pack(MAGIC, VERSION, width, len(doc_ids), len(doc_ids) - len(known), len(ids))
    return head + EliasFano.of(ends).dump() + EliasFano.of(known).dump() + ids.astype(f"<u{width}").tobytes()


class Segment:
    """Random access to one segment: ``bounds(i)`` by select, ``ids(i)`` a view of the array."""

    def __init__(self, raw: bytes):
        view = memoryview(raw)
        magic, version, width, self.n, self.nameless, n_ids = _HEAD.unpack_from(view, 0)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token-id segment")
        self.ends, at = EliasFano.load(view, _HEAD.size)
        self.names, at = EliasFano.load(view, at)
        self.array = np.frombuffer(view, f"<u{width}", n_ids, at)

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i), self.ends.select(i + 1)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.array[a:b]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nameless + [self.names.select(i) for i in range(self.names.n)]


_SEGMENTS = "part int, seg int, n_docs bigint, n_ids bigint, payload binary"


def _write(path: str, end_id: int):
    end = struct.pack("<I", end_id)

    def run(batches):
        part, seg, size, names, codes = TaskContext.get().partitionId(), 0, 0, [], []

        def flush():
            cols = ([part], [seg], [len(names)], [size], [pack_segment(names, codes)])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "seg", "n_docs", "n_ids", "payload"])

        enc = encoder(path)
        for batch in batches:
            ids, text = batch.column("doc_id").to_pylist(), batch.column("text")
            _, off = C.utf8(text)
            for i, j in C.slices(off, SLICE):
                for d, e in zip(ids[i:j], enc.encode([t or "" for t in text[i:j].to_pylist()]), strict=True):
                    names.append(d)
                    codes.append(e + end)
                    size += len(e) // 4 + 1
                    if size >= SEGMENT_IDS:
                        yield flush()
                        seg, size, names, codes = seg + 1, 0, [], []
        if names:
            yield flush()

    return run


def write_token_files(docs: DataFrame, scratch: C.Scratch, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode ``docs`` (doc_id, text; null text: empty), append end_id to each, write segments in ascending doc_id order; the table read back."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(C.shuffle_partitions(spark), -(-size // BYTES_PER_TASK))
    ranged = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    out = ranged.mapInArrow(_write(path or default_vocabulary(), end_id), _SEGMENTS)
    return scratch.put("segments", out)


_READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _read(batches):
    for batch in batches:
        for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
            s = Segment(payload.as_py())
            raw = memoryview(s.array.astype("<u4").tobytes())
            place, size, crc, a = [], [], [], s.ends.select(0)
            for i in range(s.n):  # a document ends where the next one begins, so one select each
                b = s.ends.select(i + 1)
                place.append(start + a)
                size.append(b - a)
                crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                a = b
            yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids(), pa.int64()), *(pa.array(c, pa.int64()) for c in (place, size, crc))], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the segments alone, by ``select``. Empty segments tables give no rows.

    Segment sizes (one number for a million ids) are summed in one pass to place each segment in the whole array.
    """
    w = Window.orderBy("part", "seg")
    size = segments.select("part", "seg", "n_ids").withColumn("start", F.sum("n_ids").over(w) - F.col("n_ids")).drop("n_ids")
    rows = segments.select("part", "seg").count()
    return segments.select("part", "seg", "payload").join(C.maybe_broadcast(size, rows), ["part", "seg"]).select("start", "payload").mapInArrow(_read, _READ)


def token_index(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write and read back; one row per row of ``docs`` (further columns are ignored). A null or empty text is its end id alone, a long one is whole and may fill a segment by
    itself. Null ids come first, repeated ids keep a row each, in no set order among them. An empty table gives no rows."""
    return read_token_files(write_token_files(docs, C.Scratch(docs.sparkSession, "tokens"), path, end_id))
