import hashlib
import random

import numpy as np
import pytest
from public_tokenizers import PATTERN

from tallyspark.llm import byte_bpe as B


@pytest.fixture(scope="module")
def ranks():
    return B.read_ranks(B.RANKS_FILE)


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pattern():
    return B.library_pattern(PATTERN)


def random_text(r):
    alphabet = r.choice(["ab", "the and 're'll\n", " \n\t 　x", "'rvesltdm", "aé日🙂▁՘\U00011de1 1٣", "\x1c\x1f \x85a?", "0123456789abcdef", "\r\n  ."])
    return "".join(r.choice(alphabet) * r.choice([1, 1, 1, 2, 9]) for _ in range(r.randrange(0, 90)))


def test_texts_as_the_library_encodes_them(ranks, library, pattern, monkeypatch):
    r = random.Random(8)
    for leaf, short in ((1, 2), (2, 6), (5, 4), (37, 20), (2048, 128)):
        monkeypatch.setattr(B, "LEAF_CHARS", leaf)
        monkeypatch.setattr(B, "SHORT_UNIT", short)
        codec = B.Codec(ranks, pattern)
        for _ in range(500):
            t = random_text(r)
            ids = codec.encode(t)
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t), (leaf, t)
            assert codec.decode(ids).decode() == t


def test_long_units(ranks, library, pattern):
    codec = B.Codec(ranks, pattern)
    r = random.Random(9)
    texts = ["a" * 30_001, " " * 20_000 + "x", "ab" * 10_000 + "!", "日本" * 5_000, "".join(r.choice("abcdefgh0123/+") for _ in range(60_000)), "-" * 9_999 + "\n\n" + "é" * 7_001, "x " * 20_000]
    for t in texts:
        ids = np.frombuffer(codec.encode(t), "<u4").tolist()
        assert ids == library.encode_ordinary(t), t[:9]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == t.encode()


def test_joins_cuts_and_heap(ranks):
    b, r = B.Ranks(ranks), random.Random(10)
    words = [t for t in ranks if len(t) > 2]
    for _ in range(3000):
        raw = b"".join(r.choice(words) for _ in range(r.randrange(1, 9))) if r.random() < 0.7 else bytes(r.choice(b"aab e\xc3\xa9") for _ in range(r.randrange(1, 80)))
        whole = b._merged_by_heap(raw)
        at = r.randrange(len(raw) + 1)
        assert b.join(b.merged(raw[:at]), b.merged(raw[at:])) == whole == b.encode(raw)
        assert b.cut(whole, at) == (b.merged(raw[:at]), b.merged(raw[at:]))
        x, y, z = (b.merged(p) for p in (raw[: at // 2], raw[at // 2 : at], raw[at:]))
        assert b.join(b.join(x, y), z) == b.join(x, b.join(y, z)) == whole


def test_other_ranks_than_those_of_merges(pattern):
    """Tokens that no merges give: whole matches are looked up first, as the library does."""
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 257, b"ab": 258, b"cab": 259, b"xyzw": 260, b"aa": 261, b"aaaa": 262}
    theirs, r = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), random.Random(11)
    codec = B.Codec(ranks, pattern)
    for _ in range(2000):
        t = "".join(r.choice("abcxyzw ") for _ in range(r.randrange(40)))
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == theirs.encode_ordinary(t), t


def test_query(spark, library):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = B.op12_byte_bpe(spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(library.encode_ordinary(docs[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest())


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "same", 3), (2, "same", 3), (None, "x" * 100_000, 4)], "doc_id long, text string, ids int")
    shared = B.share(spark)
    got = B.decode(B.encode(df, shared), shared).collect()
    assert sorted(bytes(r.decoded) for r in got) == [b"", b"", b"same", b"same", b"x" * 100_000]
    assert B.decode(B.encode(df.limit(0), shared), shared).collect() == []
