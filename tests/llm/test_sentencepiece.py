import random

import numpy as np
import pytest

from tallyspark.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def pieces():
    return S.Pieces.load(S.MODEL_FILE)


def brute(p, text):
    """Viterbi over the whole text by plain dictionaries; markers that the text holds are bytes."""
    own = set(p.byte_ids.tolist())
    words = {t.decode().replace(" ", "▁"): i for i, t in enumerate(p.texts) if t and i not in own}
    raw = [("▁", False), *(("▁", False) if c == " " else (c, c == "▁") for c in text)]
    best, back = [0.0] + [-np.inf] * len(raw), [None] * (len(raw) + 1)
    for i in range(len(raw)):
        for j in range(i + 1, min(len(raw), i + 48) + 1):
            if raw[j - 1][1]:
                break
            v = words.get("".join(c for c, _ in raw[i:j]))
            if v is not None and best[i] + p.scores[v] > best[j]:
                best[j], back[j] = best[i] + p.scores[v], (i, [v])
        if raw[i][1] or raw[i][0] not in words:
            b = raw[i][0].encode()
            if best[i] + p.fallback * len(b) > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + p.fallback * len(b), (i, p.byte_ids[list(b)].tolist())
    ids, at = [], len(raw)
    while at:
        at, part = back[at]
        ids = part + ids
    return best[-1], ids


def score(p, ids):
    b = set(p.byte_ids.tolist())
    return sum(p.fallback if i in b else p.scores[i] for i in ids)


TEXTS = ["hello world", "  two  spaces\n\nand lines \n x", "naïve café 😀 日本語 ▁ literal", "a", " ", "\n", "tab\tand\r\nreturn", "ünïcödé" * 30, "x" * 300, "\u0000\u0001", "1,234.5e-6 == 'q' // end.", "🙂" * 60]


def test_best_segmentation_and_round_trip(pieces):
    r = random.Random(5)
    texts = TEXTS + ["".join(r.choice("the ofandé \nß.,▁日") for _ in range(r.randrange(1, 120))) for _ in range(60)]
    codec = S.Codec(pieces)
    for t, raw in zip(texts, codec.encode_batch(texts)):
        ids = np.frombuffer(raw, np.int32)
        assert codec.decode(ids) == t
        want, _ = brute(pieces, t)
        assert score(pieces, ids.tolist()) == pytest.approx(want, rel=1e-12), t
    assert codec.encode_batch([None, ""]) == [b"", b""]


def test_long_units_agree_with_short_ones(pieces):
    codec = S.Codec(pieces)
    for u in ["▁thethethe", "ñandú", "日本語テキスト", "aaaaabbbbb" * 5]:
        assert codec.viterbi([u.encode()]) == [codec.viterbi_long(u.encode())]


def test_trie(pieces):
    t = S.DoubleArray({b"ab": 3, b"abc": 4, b"b": 5, b"\xff\x00": 6})

    def find(w):
        s = 0
        for c in w:
            n = t.base[s] + c
            if t.check[n] != s:
                return None
            s = n
        return t.value[s]

    assert [find(w) for w in (b"ab", b"abc", b"b", b"\xff\x00", b"a", b"c", b"abcd")] == [3, 4, 5, 6, -1, None, None]


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = S.op2_sentencepiece(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count() and all(r["round_trip"] for r in rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "", 2), (3, "x" * 200_000, 3), (3, "same", 3), (3, "same", 3)], "doc_id long, text string, ids int")
    shared = S.share(spark)
    got = S.decode(S.encode(df, shared), shared).collect()
    assert sorted(len(r["text"]) for r in got) == [0, 0, 4, 4, 200_000]
    assert S.decode(S.encode(df.limit(0), shared), shared).collect() == []
