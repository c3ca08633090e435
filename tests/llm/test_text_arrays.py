import re

import numpy as np
import pyarrow as pa

from oddslake.llm.text_arrays import slices


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_equal_hashes_for_equal_words_only():
    texts = ["", " ", "One two\tone", "ONE", "é É é\x85ß", "x" * 3000 + " y", "\n\nab a b\r\n", "", "one", "𝔘 a" * 50, "end"]
    batch = pa.record_batch({"text": pa.array(texts)}).slice(1)
    for size, rows in ((1 << 20, 1000), (16, 2), (1, 1)):
        names: dict = {}
        seen = 0
        for first, n, hashes, ends in slices(batch, most=size, rows=rows):
            assert first == seen and len(ends) == n
            seen += n
            for row, a, b in zip(range(first, first + n), np.r_[0, ends[:-1]], ends):
                own = words(texts[1 + row])
                assert b - a == len(own)
                for w, h in zip(own, hashes[a:b].tolist()):
                    assert names.setdefault(w, h) == h
        assert seen == len(texts) - 1 and len(set(names.values())) == len(names)
