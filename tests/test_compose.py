"""NFC of texts in Arrow, a few as Python strings at a time."""

import tracemalloc
import unicodedata

import pyarrow as pa

from tessella.functions import canon


def test_composed_in_bounded_memory():
    texts = [None, "", "plain", "e\u0301", "\u00e9", "\u1112\u1161\u11ab", *("a\u0308" * 2000 if k % 3 else "x" * 2000 for k in range(6000)), None]
    array = pa.array(texts)
    tracemalloc.start()
    got = canon.composed(array)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [t if t is None else unicodedata.normalize("NFC", t) for t in texts] and got.type == array.type
    assert canon.composed(array[:0]).to_pylist() == [] and canon.composed(array.slice(3, 2)).to_pylist() == ["\u00e9", "\u00e9"]
    assert peak < 8 << 20  # the strings of all texts are over 20 MB
