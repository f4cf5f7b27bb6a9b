import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import words as w

UPPER = {c: c + 32 for c in range(65, 91)}
PATTERNS = ((w.SPACED, r"[^\x20\x09-\x0D]+"), (w.LETTERED, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="aB é\n1.", max_size=200)), max_size=12))
def test_words_match_the_patterns(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    data, offsets = w.string_buffers(pa.array(texts, pa.string()))
    for table, pattern in PATTERNS:
        h, row, s, e = w.hash_words(data, offsets, table)
        found = [(r, bytes(table[data[a:b]])) for r, a, b in zip(row.tolist(), s.tolist(), e.tolist(), strict=True)]
        wanted = [(i, m.encode().replace(b"\0", b"\xff")) for i, t in enumerate(texts) for m in re.findall(pattern, (t or "").translate(UPPER))]
        assert found == wanted
        assert h.tolist() == [w.hash_word(m.replace(b"\xff", b"\0"), table) for _, m in wanted]


def test_long_words_and_pieces():
    text = "x" * 1_200_000 + " tail " + "y " * 400_000
    data, offsets = w.string_buffers(pa.array(["a b", text, "c"]))
    h, row, s, e = w.hash_words(data, offsets, w.SPACED)
    assert np.bincount(row).tolist() == [2, 400_002, 1]
    assert int(e[2] - s[2]) == 1_200_000 and len(np.unique(h)) == 6


def test_shingles():
    data, offsets = w.string_buffers(pa.array(["a b c d", "", "a b", "c d"]))
    h, row, _, _ = w.hash_words(data, offsets, w.SPACED)
    sh, at, first = w.shingles(h, row, 4, 3)
    assert at.tolist() == [0, 0, 2, 3] and first.tolist() == [0, 1, 4, 6] and len(set(sh.tolist())) == 4
