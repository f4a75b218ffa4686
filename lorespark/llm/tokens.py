"""Token ids by the ``tokenizers`` library, with repeated pieces encoded once per worker.

Byte-level BPE first cuts a text into pieces (words with their leading space, numbers, marks, white space) and merges inside a piece
only, so a text's ids are its pieces' ids in a row. Texts of common characters are cut here, many at a time, by the classes of
neighbouring characters; each distinct piece is encoded by the library once and remembered (in bounded Arrow tables, which take some 50 bytes a
piece); any other text goes to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as C

_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_RARE = re.compile("[^\t\n\r -~¡-ɏ‐-‧‰-›€]")
_CONTROL = re.compile("[^\t\n\r -~]")
#: Classes of characters: what stands between texts, the blank, other white space, letters, numbers, other marks.
_BETWEEN, _BLANK, _WHITE, _LETTER, _NUMBER, _MARK = range(6)
_CLASS = np.full(0x2100, _MARK, np.uint8)
_CLASS[[ord(c) for c in map(chr, range(0x2100)) if re.match(f"[{_L}]", c)]] = _LETTER
_CLASS[[ord(c) for c in map(chr, range(0x2100)) if re.match(f"[{_N}]", c)]] = _NUMBER
_CLASS[[9, 10, 13]] = _WHITE
_CLASS[[0, 32]] = _BETWEEN, _BLANK
#: Pieces remembered in each of two generations, and pieces that one call of the library encodes.
REMEMBERED = 150_000
PER_CALL = 10_000
#: Text bytes that are best encoded at once, and characters that are cut at once: cutting takes some 20 bytes for each of them.
SLICE = 8 << 20
CUT = 1 << 18


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(texts: list[str]) -> pa.Array:
    """The pieces of ``texts`` (of common characters) in a row, as ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\sLN]+|\\s+(?!\\S)|\\s+`` cuts them; a NUL before each text and at the end."""
    joined = "\0" + "".join([t + "\0" for t in texts])
    raw = np.frombuffer(joined.encode(), np.uint8)
    char = raw if len(raw) == len(joined) else np.frombuffer(joined.encode("utf-32-le"), "<u4")
    kind = _CLASS[char]
    white = (kind == _BLANK) | (kind == _WHITE)
    solid = ~white & (kind != _BETWEEN)
    start = kind == _BETWEEN
    # a run of white space is a piece but for its last character, which goes to what follows if it is a blank and else stands alone
    start[1:] |= white[1:] & ~white[:-1] | solid[1:] & (kind[1:] != kind[:-1]) & (kind[:-1] != _BLANK)
    start[:-1] |= white[:-1] & solid[1:]
    at = np.flatnonzero((char == 39) & start)
    at = at[at < len(char) - 2]
    one, two = char[at + 1], char[at + 2]
    short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
    long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[at[short | long] + 1] = False
    start[at[short] + 2] = True
    start[at[long] + 3] = True
    if char is not raw:
        lead = (raw & 0xC0) != 0x80
        lead[lead] = start
        start = lead
    return _binary(np.append(np.flatnonzero(start), len(raw)), raw)


def _binary(off: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64, copy=False)), pa.py_buffer(data)])


_NONE = pa.array([], pa.large_binary())


class Encoder:
    """``encode(texts)``: each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        if hasattr(self.tok.model, "_resize_cache"):  # what reaches the library is new to it, so its own cache never hits
            self.tok.model._resize_cache(0)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.simple = repr(self.tok.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in repr(self.tok.pre_tokenizer) and self.tok.normalizer is None
        #: The same model for pieces that are cut already: their bytes stand as the characters that byte-level vocabularies write for them. No piece holds a NUL, so its id stands between two.
        self.cut = Tokenizer(self.tok.model)
        self.cut.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = dict(enumerate(map(chr, range(256)))) | dict(zip(sorted(set(range(256)) - set(own)), map(chr, range(256, 324)), strict=True))
        self.nul = self.tok.token_to_id(self.letters[0])
        self.simple = self.simple and self.nul is not None and set(self.letters.values()) == set(pre_tokenizers.ByteLevel.alphabet())
        self.letters[0] = f" {self.letters[0]} "
        #: Pieces and their ids, of this generation and the one before.
        self.memo, self.old = (_NONE, _NONE), (_NONE, _NONE)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, t: str) -> bool:
        return self.simple and (t.isascii() and not _CONTROL.search(t) or not _RARE.search(t)) and not any(s in t for s in self.specials)

    def _learn(self, pieces: pa.Array) -> pa.Array:
        """The ids of pieces, many of them in a call of the library."""
        out = [_NONE]
        for i in range(0, len(pieces), PER_CALL):
            part = pieces[i : i + PER_CALL].to_pylist()
            got = np.asarray(self.cut.encode_batch_fast([b"\0".join([*part, b""]).decode("latin-1").translate(self.letters)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(got == self.nul)
            out.append(_binary(4 * np.concatenate([[0], ends - np.arange(len(part))]), np.delete(got, ends)))
        return pa.concat_arrays(out)

    def _ids(self, pieces: pa.Array) -> pa.Array:
        """The ids of ``pieces`` (distinct), from the memo, the generation before or the library; all are then in the memo."""
        if len(self.memo[0]) > REMEMBERED:
            self.old, self.memo = self.memo, (_NONE, _NONE)
        at = pc.index_in(pieces, self.memo[0]).fill_null(-1).to_numpy().astype(np.int64)
        new = pieces.take(pa.array(np.flatnonzero(at < 0)))
        before = pc.index_in(new, self.old[0])
        lost = before.is_null().to_numpy(zero_copy_only=False)
        before = before.drop_null()
        place = np.where(lost, len(before) + np.cumsum(lost), np.cumsum(~lost)) - 1
        at[at < 0] = len(self.memo[0]) + place
        learnt = new.filter(pa.array(lost))
        self.memo = tuple(pa.concat_arrays([m, o.take(before), n]) for m, o, n in zip(self.memo, self.old, (learnt, self._learn(learnt)), strict=True))
        return self.memo[1].take(pa.array(at))

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of common characters."""
        if not texts:
            return []
        chars = np.cumsum([0, *map(len, texts)])
        coded = pa.chunked_array([cut(texts[i:j]) for i, j in C.slices(chars, CUT)]).dictionary_encode()  # of one dictionary
        ids = pa.concat_arrays([pa.array([b""], pa.large_binary()), self._ids(coded.chunk(0).dictionary[1:])])  # the first piece is what stands between texts, and has no ids
        out = []
        for code in (c.indices for c in coded.chunks):
            _, off, data = ids.take(code).buffers()
            ends = np.frombuffer(off, np.int64, len(code) + 1)[np.flatnonzero(code.to_numpy() == 0)].tolist()
            raw = memoryview(data if data is not None else b"")
            out += [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self._plain(t) for t in texts]
        common, odd = [[i for i, p in enumerate(plain) if p == x] for x in (True, False)]
        out = [b""] * len(texts)
        for at, how in ((common, self._joined), (odd, self.whole)):
            for i, b in zip(at, how([texts[i] for i in at]), strict=True):
                out[i] = b
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    C.hold("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
