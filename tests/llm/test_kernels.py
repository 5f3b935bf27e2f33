import random

import numpy as np
import pyarrow as pa

from quantweft.llm import kernels as K


def test_words_and_grams_match_python():
    rng = random.Random(1)
    texts = [None, "", "  ", "a", "é \x0b\x1c b", *["".join(rng.choice("ab \n\té") for _ in range(rng.randint(0, 40))) for _ in range(200)]]
    seen = {}
    for chunk in K.text_chunks(pa.array(texts), limit=64):
        w = K.Words(chunk)
        grams, fits = w.grams(3), w.fits(3)
        for i, row in enumerate(chunk.rows):
            words = (texts[row] or "").encode().split()
            a, b = w.bounds[i], w.bounds[i + 1]
            assert [chunk.buf[s:e].tobytes() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] == words
            for j in range(len(words)):
                assert fits[a + j] == (j + 3 <= len(words))
                if fits[a + j]:
                    key = tuple(words[j : j + 3])
                    assert seen.setdefault(key, grams[a + j]) == grams[a + j]
    assert len(set(seen.values())) == len(seen)


def test_sliding_argmin():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 6, 100).astype(np.uint64) << np.uint64(40)
    for w in (1, 2, 3, 7, 16, 100):
        assert [int(x) for x in K.sliding_argmin(v, w)] == [i + int(np.argmin(v[i : i + w])) for i in range(100 - w + 1)]
    assert len(K.sliding_argmin(v, 101)) == 0
