import pyarrow as pa

from lorespark.functions import minhash as M


def test_signatures_of_a_batch(monkeypatch):
    """Texts of a batch are taken one by one; short, long, empty and missing ones give what one text alone gives."""
    monkeypatch.setattr(M, "SLICE_RUNES", 10)
    texts = [None, "", "a", "ab", "abc", "The quick brown fox jumps over the lazy dog", "é\U0001f600x", "zz" * 30, "abcd", "12345678901"]
    got = M.minhash.func(pa.array(texts)).to_pylist()
    assert got == [None if not t else M.signature(t).tolist() for t in texts]
