import random

import numpy as np
import pyarrow as pa
from cohortflow.llm.common import slice_words


def test_words_are_hashed_as_they_are():
    rng = random.Random(3)
    pieces = ["a", "ab", "Ünï", "𝒳y", "12345678", "123456789", "w" * 40, "v" * 10_000, "v" * 9_999 + "w", "z" * 5000, " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\xa0", "\x85", " "]
    texts = [None, "", " ", "one", "one ", " one"] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", None]
    known = {}
    for kind in (pa.string(), pa.binary()):
        col = pa.array([None if t is None else t.encode() for t in ["left out", *texts, "x"]], pa.binary()).cast(kind)[1:-1]
        h, at = slice_words(col)
        assert len(at) == len(texts) + 1 and at[0] == 0 and at[-1] == len(h)
        for i, t in enumerate(texts):
            words = (t or "").encode().split()
            assert at[i + 1] - at[i] == len(words)
            for w, x in zip(words, h[at[i]:at[i + 1]].tolist(), strict=True):
                assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known) > 300
    assert [len(x) for x in slice_words(pa.array([], pa.string()))] == [0, 1] and slice_words(pa.array([None]))[1].tolist() == [0, 0]


def test_hashes_are_spread():
    words = [f"{i:x}" for i in range(200_000)]
    h, _ = slice_words(pa.array([" ".join(words)]))
    assert len(np.unique(h)) == len(words)
    for shift in (0, 20, 48, 56):
        n = np.bincount(((h >> np.uint64(shift)) & np.uint64(255)).astype(int), minlength=256)
        assert n.min() > 600 and n.max() < 970
