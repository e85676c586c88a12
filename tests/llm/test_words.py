"""Words of texts that are longer than a segment."""

import random
import re

import numpy as np

from tallyspark.llm import words


def test_segments_change_nothing(monkeypatch):
    r = random.Random(1)
    texts = [None, "", " ", "a", "x" * 5000, "x" * 64, "x" * 65 + " y", " " * 200 + "z", "\u00e9" * 90 + "\t" + "\U0001f600" * 40]
    texts += ["".join(r.choice("aB \n.") for _ in range(r.randrange(1, 700))) for _ in range(60)]
    whole = words.word_hashes(texts)
    loose = words.word_hashes(texts, words.LOOSE_GAPS)
    for t, w in zip(texts, whole):
        parts = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert len(w) == len(parts) and len(set(w.tolist())) == len({x.encode().lower() for x in parts})
    words._powers.cache_clear()
    monkeypatch.setattr(words, "SEGMENT", 64)
    try:
        assert all(np.array_equal(a, b) for a, b in zip(words.word_hashes(texts), whole))
        assert all(np.array_equal(a, b) for a, b in zip(words.word_hashes(texts, words.LOOSE_GAPS), loose))
    finally:
        words._powers.cache_clear()
