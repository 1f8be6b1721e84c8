"""Work of Python within Arrow batches, against its plain definition."""

import zlib

import numpy as np
import pandas as pd

from lumenbase.sources.tables import hashed_embedding


def test_a_batch_is_hashed_at_once():
    texts = pd.Series(["Một hai một", None, "", " \x1c  ", "Σας İ é\x85d 😀", "a b c " * 200], index=[3, 1, 4, 7, 9, 2])
    got = hashed_embedding(texts)
    assert list(got.index) == list(texts.index) and all(x.dtype == np.float32 for x in got) and len(hashed_embedding(pd.Series([], dtype=object))) == 0
    for text, vector in zip(texts, got, strict=True):
        v = np.zeros(64)
        for h in (zlib.crc32(w.encode()) for w in (text or "").lower().split()):
            v[h % 64] += 1 if h & 65536 else -1
        n = np.linalg.norm(v)
        assert np.array_equal((v / n if n else v).astype(np.float32), vector)
