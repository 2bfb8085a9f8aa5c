import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import words as W

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB01 é漢\t\n-%", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_patterns(texts):
    for table, pattern in ((W.SPACE_WORDS, r"[^\x20\x09-\x0D]+"), (W.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for piece in (3, 1 << 19):
            W.PIECE_BYTES = piece
            w = W.words(pa.array(texts, pa.string()), table)
            expect = [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
            assert np.diff(w.first).tolist() == [len(e) for e in expect]
            assert [w.text(i) for i in range(len(w.hash))] == [x for e in expect for x in e]
            seen = {}
            assert all(seen.setdefault(w.text(i), h) == h for i, h in enumerate(w.hash.tolist())) and len(set(seen.values())) == len(seen)
    W.PIECE_BYTES = 1 << 19


@settings(max_examples=40, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_shingles_count_like_tuples(texts, size):
    w = W.words(pa.array(texts, pa.string()), W.SPACE_WORDS)
    h, d, _ = W.shingles(w, size)
    _, cut = W.distinct_by_doc(h, d, len(texts))
    for k, t in enumerate(texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        whole = {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set()
        assert cut[k + 1] - cut[k] == len(whole)
