"""Runs of spaces are part of the piece lattice."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from plumbline.llm import subword


def test_runs_of_spaces_follow_the_lattice():
    p = subword.Pieces()
    ids = [(t, i) for i, t in enumerate(p.text) if t and i not in set(p.byte_id.tolist())] + [(p.text[i], int(i)) for i in p.byte_id]
    assert sum(t.count(b" ") > 1 for t, _ in ids) == 14

    def cuts(rest):
        if not rest:
            yield (), 0.0
        for t, i in ids:
            if rest.startswith(t):
                for tail, w in cuts(rest[len(t) :]):
                    yield (i, *tail), w + p.weight[i]

    text, n = "    if", 20_000
    want = dict(cuts(text.encode()))
    z = sum(math.exp(w) for w in want.values())
    data, off = subword.text_buffers(pa.array([text] * n))
    piece, poff = subword.encode(np.arange(n), data, off, p)
    got = Counter(tuple(piece[a:b].tolist()) for a, b in zip(poff[:-1], poff[1:], strict=True))
    assert set(got) <= set(want)
    for cut, w in want.items():
        share = math.exp(w) / z
        assert abs(got[cut] / n - share) < 5 * math.sqrt(share / n) + 1e-3
    assert sum(k for cut, k in got.items() if any(p.text[i].count(b" ") > 1 for i in cut)) > n / 10


def test_spaces_everywhere_decode_to_the_text():
    p = subword._of(subword.MODEL)
    texts = ["", " ", "  ", "a" + " " * 100 + "b  ", None, "   x", " " * 5_000, "\n    a\n        b", "  "]
    data, off = subword.text_buffers(pa.array(texts))
    piece, poff = subword.encode(np.arange(len(texts)), data, off, p)
    back, boff = subword.decode(piece, poff, p)
    assert [back[a:b].tobytes().decode() for a, b in zip(boff[:-1], boff[1:], strict=True)] == [t or "" for t in texts]
