import hashlib
import random
from collections import Counter

import pytest

from tallyspark.llm import cross_tokenizer as C


@pytest.fixture(scope="module")
def tokens():
    with open(C.BYTE_FILE, encoding="utf-8") as f, open(C.PIECE_FILE, "rb") as g:
        return C.Tokenizers(f.read(), g.read())


def whole(tokens, text):
    """Both libraries' ids of a whole text, with the bytes of each token; None if these differ from it."""
    if not text:
        return None
    a = [(i, tokens.a_bytes[i]) for i in tokens.a.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, tokens.b_bytes[i]) for i in tokens.b.encode(text)]
    return (a, b) if all(b"".join(x for _, x in s) == (" " + text).encode() for s in (a, b)) else None


def spans(side):
    at, out = 0, []
    for i, raw in side:
        out.append((at, at + len(raw), i))
        at += len(raw)
    return out


def brute(tokens, docs):
    """(doc_id, text) rows: groups by offsets, links by comparing all spans of a group, counts by sets."""
    rows, held = [], Counter()
    for doc_id, text in docs:
        both = whole(tokens, text)
        a, b = (spans(s) for s in both) if both else ([], [])
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, links, at = [], [], 0
        ia = ib = 0
        for c in cuts:
            ga, gb = [], []
            while ia < len(a) and a[ia][1] <= c:
                ga.append(a[ia])
                ia += 1
            while ib < len(b) and b[ib][1] <= c:
                gb.append(b[ib])
                ib += 1
            groups.append(",".join(str(x[2]) for x in ga) + "|" + ",".join(str(x[2]) for x in gb))
            links += [(x[2], y[2]) for x in ga for y in gb if max(x[0], y[0]) < min(x[1], y[1])]
        rows.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
        held.update(set(links))
    top = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    return sorted((str(d), na, nb, ng, len(ls), sum(held[x] == top[x[0]] for x in ls), sum(held[x] for x in ls), sha(g)) for d, na, nb, ng, ls, g in rows)


def plain(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def random_texts(n):
    r = random.Random(13)
    alphabets = ["the and of re'll\n", " \n\t\r\x0b　x.", "aé日🙂 ß\n", "ab ", "<|endoftext|> ", "\x00\x1c\x1f \x85 a\n", "0123456789abcdef<0xA>", "a▁ b"]
    return ["".join(r.choice(a) * r.choice([1, 1, 2, 5]) for _ in range(r.randrange(0, 60))) for a in alphabets for _ in range(n)]


def test_units_are_tokenised_as_whole_texts_are(tokens):
    texts = random_texts(150) + ["<|endoftext|>", "x <|endoftext|>y", "tab\t end", "trailing \n ", "\n", " ", "a\tb \t c"]
    numbers, per_text = tokens.units(texts)
    sides = [tokens.encoded(numbers, side) for side in (0, 1)]
    at = [0, 0]
    unit = 0
    for t, n in zip(texts, per_text.tolist()):
        want = whole(tokens, t)
        assert (n == 0) == (want is None), t
        for side, (ids, count) in enumerate(sides):
            k = int(count[unit : unit + n].sum())
            assert ids[at[side] : at[side] + k].tolist() == ([i for i, _ in want[side]] if want else []), t
            at[side] += k
        unit += n


def test_query_against_brute_force(spark, sf, tokens):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert plain(C.op13_cross_tokenizer(spark, sf)) == brute(tokens, [tuple(d) for d in docs])


def test_random_texts_in_small_blocks_and_caches(spark, tokens):
    docs = [(i, t) for i, t in enumerate(random_texts(12))] + [(5, "again and again"), (5, "again and again"), (None, "again"), (None, None), (7, ""), (8, "x" * 60_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert plain(C.aligned(df, C.share(spark))) == brute(tokens, docs)


def test_blocks_end_and_caches_are_cleared(tokens, monkeypatch):
    monkeypatch.setattr(C, "WINDOWS", 50)
    texts = [t for t in random_texts(20) if whole(tokens, t)]
    aligner = C.Aligner(tokens)
    held = Counter()
    for s in range(0, len(texts), 7):
        part = texts[s : s + 7]
        n_a, n_b, n_groups, n_links, written, packed = aligner.texts(*tokens.units(part))
        for t, g, p, n in zip(part, written, packed, n_links):
            code, times = C._unpacked(p)
            assert times.sum() == n and g.decode().count(";") + 1 == n_groups[part.index(t)]
            held.update(code.tolist())
    code, a, b, n = aligner.block_pairs()
    assert dict(zip(code.tolist(), n.tolist())) == dict(held)
    aligner.new_block()
    assert not aligner.pairs and not aligner.known


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "has ▁", 3), (3, "fine", 4)], "doc_id long, text string, block int")
    shared = C.share(spark)
    got = {r.doc_id: r for r in C.aligned(df, shared, with_groups=True).collect()}
    assert (got[1].n_a, got[1].n_best, got[1].groups_sha256) == (0, 0, "") == (got[2].n_links, got[2].count_sum, got[2].groups_sha256)
    assert got[3].n_groups >= 1 and hashlib.sha256(got[3].groups.encode()).hexdigest() == got[3].groups_sha256
    assert C.aligned(df.limit(0), shared).collect() == []
