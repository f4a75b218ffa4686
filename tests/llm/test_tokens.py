import random
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import regex

from lorespark.llm import tokens

REPO = str(Path(tokens.__file__).parents[2])
HELD = """
import gc, random
import pyarrow as pa
from lorespark.llm import tokens
def held():
    return int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) / 1024
r, enc = random.Random(7), tokens.Encoder(tokens.default_vocabulary())
text = lambda: " ".join("".join(r.choices("etaoinshrdlu", k=9)) for _ in range(500))
enc.encode([text() for _ in range(100)])
gc.collect()
before = held()
for _ in range(13):
    enc.encode([text() for _ in range(100)])
gc.collect()
pa.default_memory_pool().release_unused()
print(held() - before)
"""


def test_remembered_pieces_take_little_memory():
    """650,000 pieces took 73 MB in dictionaries of strings, 25 MB in Arrow tables."""
    said = subprocess.run([sys.executable, "-c", HELD], cwd=REPO, capture_output=True, text=True, check=True)
    assert float(said.stdout.split()[-1]) < 48


PEAK = """
import random, resource
from lorespark.llm import tokens
most = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
r, enc = random.Random(7), tokens.Encoder(tokens.default_vocabulary())
words = ["".join(r.choices("etaoinshrdlu", k=5)) for _ in range(20000)]
for k in (1, 200):
    texts = [" ".join(r.choices(words, k=7000)) + " \u2013" for _ in range(k)]
    before = most()
    enc.encode(texts)
print(most() - before)
"""


def test_texts_encoded_at_once_take_little_memory():
    """Encoding 8 MB of texts took 114 MB more where they were cut all at once, 33 MB in parts."""
    said = subprocess.run([sys.executable, "-c", PEAK], cwd=REPO, capture_output=True, text=True, check=True)
    assert float(said.stdout.split()[-1]) < 70


def test_cuts_of_many_texts_share_a_dictionary(monkeypatch):
    """No text goes lost or wrong where a call is cut in parts, empty texts and texts longer than a part included."""
    monkeypatch.setattr(tokens, "CUT", 9)
    enc, texts = tokens.Encoder(tokens.default_vocabulary()), ["", "a b", "It's a naïve   café", "", "b a", "", "a b"]
    assert enc.encode(texts) == enc.whole(texts)
    assert enc.encode([]) == [] and enc.encode([""]) == [b""] and enc.encode(["\x00"]) == enc.whole(["\x00"])


def test_pieces_are_not_cut_again_by_the_library():
    """Twice the CPU seconds of learning a piece before: the library cut the pieces once more."""
    enc, texts = tokens.Encoder(tokens.default_vocabulary()), ["It's a naïve   café\n\n x 12", "a\tb "]
    want, asked = enc.whole(texts), []
    enc.tok = SimpleNamespace(encode_batch_fast=lambda t, **_: asked.extend(t) or [])
    assert enc.encode(texts) == want and not asked


def awkward_texts(n=4000):
    r = random.Random(5)
    common = ["a", "b", "é", "É", " ", " ", "  ", "\n", "\t", "\r", "'", "'", "s", "t", "re", "ve", "m", "ll", "d", "l", "1", "²", "½", "!", "¡", "×", "÷", "–", "“", "€", "…", "S", "ª", "ɏ", "...", "-"]
    odd = ["\xa0", "中", "\x00", " ", "<|endoftext|>", "😀", "\x85", "́"]
    hand = ["", "'", "''", " 's", "a's", "'s't", "  ", "\n", " \n a", "a \n", "'ll", "'l", "'rex", "x'", "<|endoftext|>"]
    return hand, ["".join(r.choices(common, k=r.randint(0, 25))) for _ in range(n)], ["".join(r.choices(common + odd, k=r.randint(0, 25))) for _ in range(n // 4)]


def test_cut_is_the_expression():
    gpt2 = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    texts = [t for t in sum(awkward_texts()[:2], []) if "<|" not in t]
    want = [x.encode() for t in texts for x in ["\0", *gpt2.findall(t)]] + [b"\0"]
    assert tokens.cut(texts).to_pylist() == want


def test_batches_and_generations_equal_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 300)
    monkeypatch.setattr(tokens, "PER_CALL", 50)
    texts = sum(awkward_texts(), [])
    enc = tokens.Encoder(tokens.default_vocabulary())
    want = [np.asarray(e.ids, "<u4").tobytes() for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    for step in (7, 500, len(texts)):
        assert sum((enc.encode(texts[i : i + step]) for i in range(0, len(texts), step)), []) == want
    assert len(enc.old[0])
