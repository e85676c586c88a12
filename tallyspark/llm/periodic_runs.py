"""Operator 11: periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period q and at least max(6, 4 q) words that no
neighbouring word extends. Each of its words occurs at least four times in it, so a word that
occurs less often within its segment stands in no run there: such words split the segment. The
parts are counted anew, those that split once more, until nothing changes. What survives is
scanned by lags, all segments of a slice together. Lags from Q to 2 Q - 1 are scanned where the
stretches of 2 Q words repeat: within a run, such a stretch first returns exactly q words later,
so a run shows as consecutive positions of one distance, and its ends are exact. Stretches are
named by sorting pairs of names of half the length, never by hashes. Segments shorter than 4 Q
leave the scan, so it takes n log n steps for each doubling of Q.

Null and empty texts have no words and no runs. Repeated rows and null ids are rows like any
other, ties between runs go to the smallest start, then period; no rows give no rows. Other
columns are ignored, whatever their names. Texts are whole, of any length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, slices, table, tidy

TIMES, LEAST = 4, 6  # a run has so many periods, and so many words, at least

#: What a text's words become before the scan: (start, period) of a tail that repeats, or nothing.
Tiling = Callable[[int | None, int], tuple[int, int] | None]


def _names(key: np.ndarray) -> np.ndarray:
    """Equal keys get one small number."""
    return np.unique(key, return_inverse=True)[1]


def split_by_frequency(word: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments that are left of ``word[start:end]`` when words too rare within their segment
    split it, until none does. Segments that didn't change aren't counted again."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        long = end - start >= LEAST
        start, end = start[long], end[long]
        if not len(start):
            break
        size = end - start
        first = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(size)), size)
        at = np.arange(size.sum()) - first[seg] + start[seg]
        name = _names(seg * (int(word.max()) + 1) + word[at])
        keep = np.bincount(name)[name] >= TIMES
        whole = np.logical_and.reduceat(keep, first)
        done.append((start[whole], end[whole]))
        edge = np.zeros(len(at) + 1, bool)  # where a part begins or ends
        inside = keep & ~whole[seg]
        edge[0], edge[-1] = inside[0], inside[-1]
        edge[1:-1] = (inside[1:] != inside[:-1]) | ((seg[1:] != seg[:-1]) & (inside[1:] | inside[:-1]))
        cut = np.flatnonzero(edge)
        begins = cut[inside[np.minimum(cut, len(at) - 1)] & (cut < len(at))]
        ends = cut[(cut > 0) & inside[cut - 1]]
        start, end = at[begins], at[ends - 1] + 1
    if not done:
        return start, end
    start, end = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(start)
    return start[order], end[order]


def lag_scan(word: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs in the segments ``word[start:end]``, by start, then period."""
    found: list[tuple[np.ndarray, ...]] = []
    size = end - start
    seg = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - (np.cumsum(size) - size)[seg] + start[seg]
    name = _names(seg * (int(word.max(initial=0)) + 1) + word[at])  # of stretches of Q words from here
    left = end[seg] - at  # words from here to the segment's end
    Q = 1
    while len(at):
        twice = np.flatnonzero(left >= 2 * Q)  # the name Q words on: positions of a segment stand together
        pair = _names(name[twice] * (int(name.max()) + 1) + name[twice + Q])
        order = np.argsort(pair, kind="stable")
        gap = np.zeros(len(at), np.int64)
        again = pair[order[1:]] == pair[order[:-1]]
        here, there = twice[order[:-1][again]], twice[order[1:][again]]
        gap[here] = at[there] - at[here]
        gap[(gap < Q) | (gap >= 2 * Q)] = 0
        edge = np.flatnonzero(np.diff(gap, prepend=0, append=0))
        for_each = edge[:-1][gap[edge[:-1]] > 0] if len(edge) else edge
        if len(for_each):
            q = gap[for_each]
            length = edge[np.searchsorted(edge, for_each) + 1] - for_each - 1 + q + 2 * Q
            ok = length >= np.maximum(LEAST, TIMES * q)
            found.append((at[for_each][ok], length[ok], q[ok]))
        Q *= 2
        fits = size >= TIMES * Q
        kept = fits[seg]
        longer = np.full(len(at), -1, np.int64)
        longer[twice] = pair
        at, name, left, seg = at[kept], longer[kept], left[kept], seg[kept]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    s, n, q = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, s))
    return s[order], n[order], q[order]


def runs_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of several texts, whose word numbers ``words[bounds[i]:bounds[i + 1]]`` are."""
    return lag_scan(words, *split_by_frequency(words, bounds[:-1], bounds[1:]))


def _slice(ids: list, texts: list, tiling: Tiling | None) -> tuple[list, list]:
    numbers: dict[bytes, int] = {}
    known, parts = [], []
    for i, text in zip(ids, texts):
        words = (text or "").encode().split()  # at space and the controls 9 to 13
        own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        if tiling and len(words) and (how := tiling(i, len(words))):
            a, p = how
            own = np.concatenate([own[:a], own[a + np.arange(len(words) - a) % p]])
        parts.append(own)
    known = list(numbers)
    bounds = np.cumsum([0, *map(len, parts)])
    words = np.concatenate([*parts, np.zeros(0, np.int64)])
    s, n, q = runs_of(words, bounds)
    over = np.zeros(len(words) + 1, np.int64)  # runs that hold a word after their first period
    np.add.at(over, s + q, 1)
    np.add.at(over, s + n, -1)
    keep = np.cumsum(over)[:-1] == 0
    doc = np.searchsorted(bounds, s, "right") - 1
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    runs, collapsed = [], []
    for i in range(len(texts)):
        a, z = bounds[i], bounds[i + 1]
        at = slice(first[i], first[i + 1])
        runs.append([{"start": x, "length": y, "period": w} for x, y, w in zip((s[at] - a).tolist(), n[at].tolist(), q[at].tolist())])
        collapsed.append(b" ".join([known[w] for w in words[a:z][keep[a:z]].tolist()]).decode())
    return runs, collapsed


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tiling: Tiling | None = None) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, collapsed): the runs of each row's words,
    numbered from 0, by start and period, and the words without the repeats of runs, with single
    spaces. One row per input row, in one pass without a shuffle."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                runs, collapsed = _slice(part.column(0).to_pylist(), part.column(1).to_pylist(), tiling)
                kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs, kind), pa.array(collapsed, pa.string())], names=["doc_id", "runs", "collapsed"])

    return id_text(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The contract's repeated tails: of one document in ten by the checksum of its id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document's words, planted tails included: their number, the one of the
    greatest length / period, digests of all of them and of the words left without repeats.

    A null id has no planted tail. Empty and null texts: no runs, null columns of the best, digests
    of the empty text."""
    found = periodic_runs(table(spark, sf_dir, "documents"), tiling=planted_tail)
    # the first of equals stays, and runs stand by start, then period
    best = F.expr("reduce(runs, cast(null as struct<start: long, length: long, period: long>), (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("b.length * 1000 div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
