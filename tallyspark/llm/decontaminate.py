"""Operator 8: benchmark decontamination by spaced-seed hashing.

Words are compared without case (A-Z) and without ASCII punctuation. Fixed masks take 7 words
of a span and skip the rest, so a hit survives substituted words at the skipped places. All
seeds of the benchmark are hashed; each position of each document is looked up, and a hit
puts an item over the document at an offset. Around the hits of an offset the overlap is
verified word by word: it grows to both sides while its score (1 for an equal word, -2 for
another) isn't ``DROP`` below its best. Overlaps of one item at different offsets (words may
have been put in or left out) add up by the item's words that they cover.

A document is contaminated where an item has ``MATCHED`` words covered, or ``SHARE`` of its
words if it is shorter, at least ``LEAST``.

The benchmark's index is sent to all tasks in blocks of at most ``BLOCK_WORDS`` words, whatever
its size: one block for most, else one pass over the documents for each. Documents are never
shuffled, so hot passages cost nothing more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, id_text, over_texts, table
from .words import LOOSE_GAPS, mix, word_hashes

MASKS = ["11101011011", "110100110101011", "1111111"]
MATCHED, SHARE, LEAST = 13, 0.7, 7
OTHER, DROP = 2, 8
BLOCK_WORDS = 1_000_000  # about 80 MB of index in each Python worker
FILTER_BITS = 22
_STEP = np.uint64(0xD6E8FEB86659FD93)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash at each position where the mask's span fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out = out * _STEP + words[j : j + n]
    return mix(out)


def index(items: list[tuple[int, str]]) -> dict:
    """Seeds of the items, sorted, with item and position; plain arrays only."""
    words = word_hashes([t for _, t in items], LOOSE_GAPS)
    hashes, owner, at = [], [], []
    for i, w in enumerate(words):
        for m in MASKS:
            s = seeds(w, m)
            hashes.append(s)
            owner.append(np.full(len(s), i))
            at.append(np.arange(len(s)))
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    return {
        "ids": np.array([i for i, _ in items], np.int64), "words": words, "h": h[order],
        "owner": np.concatenate(owner)[order] if hashes else h, "at": np.concatenate(at)[order] if hashes else h,
    }


def overlap(doc: np.ndarray, item: np.ndarray, offset: int, hits: np.ndarray) -> np.ndarray:
    """Positions of the item's words that are equal in overlaps around hits at an offset
    (document position less item position)."""
    lo, hi = max(0, -offset), min(len(item), len(doc) - offset)
    same = doc[lo + offset : hi + offset] == item[lo:hi]
    found = np.zeros(hi - lo, bool)
    for p in hits - lo:
        if found[p]:
            continue
        ends = []
        for step in (1, -1):
            score = best = 0
            at = stop = p - (step < 0)
            while 0 <= at < len(same) and best - score <= DROP:
                score += 1 if same[at] else -OTHER
                if score > best:
                    best, stop = score, at + (step > 0)
                at += step
            ends.append(stop if best else p)
        a, z = ends[1], ends[0]
        found[a:z] = True
    return lo + np.flatnonzero(found & same)


def contaminated(words: np.ndarray, positions: np.ndarray, entries: np.ndarray, ix: dict) -> list[tuple[int, int, int, int, int]]:
    """(item_id, matched, item_words, start, end) of a document's verified overlaps."""
    out = []
    owner, offset, at = ix["owner"][entries], positions - ix["at"][entries], ix["at"][entries]
    for i in np.unique(owner):
        own = owner == i
        item, covered, first, last = ix["words"][i], set(), None, 0
        for o in np.unique(offset[own]):
            p = overlap(words, item, int(o), np.unique(at[own & (offset == o)]))
            if len(p):
                covered.update(p.tolist())
                first = min(x for x in (first, int(p[0] + o)) if x is not None)
                last = max(last, int(p[-1] + o + 1))
        if len(covered) >= max(LEAST, min(MATCHED, int(np.ceil(SHARE * len(item))))):
            out.append((int(ix["ids"][i]), len(covered), len(item), first, last))
    return out


def scan(texts: list[str | None], ix: dict, bits: np.ndarray) -> list[list[tuple]]:
    each = word_hashes(texts, LOOSE_GAPS)
    out: list[list[tuple]] = [[] for _ in texts]
    if not len(ix["h"]):
        return out
    all_words = np.concatenate(each) if each else np.zeros(0, np.uint64)
    bounds = np.cumsum([0, *map(len, each)])
    at, entry = [], []
    for m in MASKS:
        s = seeds(all_words, m)
        p = np.flatnonzero(bits[(s >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(ix["h"], s[p], "left"), np.searchsorted(ix["h"], s[p], "right")
        n = hi - lo
        at.append(np.repeat(p, n))
        entry.append(np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    at, entry = np.concatenate(at), np.concatenate(entry)
    doc = np.searchsorted(bounds, at, "right") - 1
    order = np.argsort(doc, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(doc[order]) > 0]) if len(order) else []
    for a, z in zip(starts, [*starts[1:], len(order)]):
        pick = order[a:z]
        d = int(doc[pick[0]])
        p = at[pick] - bounds[d]
        fits = p + 1 <= len(each[d])  # a seed that runs over the text's end still has its first word here
        out[d] = contaminated(each[d], p[fits], entry[pick][fits], ix)
    return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The benchmark in blocks of about ``BLOCK_WORDS`` words at most, each item in one."""
    b = benchmark.select(col(id_col).cast("long").alias("item_id"), col(text_col).alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    words = b.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    n = max(1, int(np.ceil(words / BLOCK_WORDS * 1.25)))
    return [b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, matched, item_words,
    start_word, end_word (of the document, end exclusive).

    Null and empty texts on either side overlap with nothing, nor do items of fewer than 7
    words. Repeated documents are reported each; equal items under different ids each.
    Documents with a null id are reported with it. No documents or no benchmark: no rows. Other
    columns are ignored. Texts of any length are read whole; memory follows the longest one.
    """
    d, out = id_text(docs, id_col, text_col), None
    for part in blocks(benchmark, item_col, item_text_col):
        ix = index(sorted((r["item_id"], r["text"]) for r in part.collect()))
        shared = docs.sparkSession.sparkContext.broadcast(ix)

        def start(shared=shared):
            ix = shared.value
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(ix["h"] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

            def judge(texts):
                found = [(i, *x) for i, own in enumerate(scan(texts, ix, bits)) for x in own]
                rows, *values = zip(*found) if found else [()] * 6
                return rows, values

            return judge

        one = over_texts(d, start, "item_id long, matched int, item_words int, start_word int, end_word int")
        out = one if out is None else out.unionByName(one)
    return out


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``leaks`` of all documents and the whole benchmark: doc_id, item_id, matched, item_words,
    start_word, end_word. Nulls, empty, long and repeated texts, ties: as stated there."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
