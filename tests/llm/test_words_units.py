import numpy as np

from gleaner.llm import units as U
from gleaner.llm import words as W


def test_hashes_follow_words():
    texts = [b"a bb a", None, b"", b" \t\n", b"bb\x0ba", b"x" * 3000000 + b" a", b"\xc2\xa0 a"]
    h, n = W.hash_texts(texts)
    assert n.tolist() == [3, 0, 0, 0, 2, 2, 2]
    assert h[0] == h[2] == h[4] == h[6] == h[8] and h[1] == h[3] and len(set(h.tolist())) == 4


def test_lower_folds_ascii_only():
    h, _ = W.hash_texts(["Ab É".encode(), "aB É".encode(), "ab é".encode()], lower=True)
    assert h[0] == h[2] == h[4] and h[1] == h[3] != h[5]


def test_planes_round_trip():
    v = np.array([0, 1, 2**39, 2**40 - 1], np.uint64)
    assert (U.unplanes(U.planes(v, 5), 5) == v).all() and len(U.unplanes(b"", 5)) == 0
