"""Operator 9: toxicity by compression distance.

Two zstandard dictionaries are made from labelled text, one of toxic and one of ordinary
documents, in the same way: the byte 5-grams of words that are far more frequent on that side
mark pieces of words, and the dictionary holds the marked pieces. A word counts once for each
pair of neighbours, so copies of a document add nothing. A text is read in windows of about
``WINDOW`` bytes of whole words; each is compressed with either dictionary, and the margin is
what the toxic one saves. Both dictionaries end in a primer that each window begins with: all
frames so have the same parts, and margins compare from window to window.

A document's evidence, the margins beyond a calibrated threshold and the largest margin, goes
through a logistic calibration fitted on labelled documents that the dictionaries haven't
seen. Both samples are bounded: about ``DICTIONARY_ROWS`` and ``CALIBRATION_ROWS`` documents of
each label by a hash of the id, ``PARTS`` parts of at most ``PART`` characters of each.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import col, over_texts, table
from .language_id import remainder

WINDOW, LONG_WORD = 24, 64
GRAM, SUPPORT, RATIO, DICTIONARY_BYTES = 5, 10, 8.0, 16384
DICTIONARY_ROWS, CALIBRATION_ROWS = {1: 1500, 0: 4000}, {1: 800, 0: 4000}
PARTS, PART = 4, 2000
QUIET = 1e-3  # share of ordinary windows that may reach the threshold
CUT = 0.7
PRIMER = bytes(np.random.default_rng(3).integers(1, 9, 64, dtype=np.uint8))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words (A-Z only); a long one in overlapping slices."""
    out = []
    for w in (text or "").encode().lower().split():
        if len(w) <= LONG_WORD:
            out.append(w)
        else:
            out += [w[i : i + LONG_WORD] for i in range(0, len(w) - 8, LONG_WORD - 8)]
    return out


def windows_of(words: list[bytes]) -> list[bytes]:
    out, own, n = [], [PRIMER], 0
    for w in words:
        own.append(w)
        n += len(w) + 1
        if n >= WINDOW:
            own.append(b"")
            out.append(b" ".join(own))
            own, n = [PRIMER], 0
    if n:
        own.append(b"")
        out.append(b" ".join(own))
    return out


def contexts(texts: list[str]) -> Counter:
    """How many different neighbours each word has."""
    seen: set = set()
    for t in texts:
        w = words_of(t)
        seen.update(zip([b"", *w[:-1]], w, [*w[1:], b""]))
    return Counter(w for _, w, _ in seen)


def gram_counts(words: Counter) -> Counter:
    out: Counter = Counter()
    for w, n in words.items():
        w = b" " + w + b" "
        for g in {w[i : i + GRAM] for i in range(len(w) - GRAM + 1)}:
            out[g] += n
    return out


def dictionary(own: Counter, other: Counter) -> bytes:
    """The pieces of words whose grams are typical of this side, the most frequent ones last."""
    a, b = gram_counts(own), gram_counts(other)
    n, m = max(1, own.total()), max(1, other.total())
    typical = {g for g, k in a.items() if k >= SUPPORT and k / n > RATIO * (b[g] + 1) / m}
    pieces: Counter = Counter()
    for w, k in own.items():
        w = b" " + w + b" "
        end = start = -1
        for i in range(len(w) - GRAM + 1):
            if w[i : i + GRAM] in typical:
                if i > end:
                    if end > 0:
                        pieces[w[start:end]] += k
                    start = i
                end = i + GRAM
        if end > 0:
            pieces[w[start:end]] += k
    ordered = sorted(pieces.items(), key=lambda x: (x[1], x[0]))
    return b"\x00".join(p for p, _ in ordered)[-DICTIONARY_BYTES:]


class Model:
    """Plain values only, so that it can be sent anywhere."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = toxic, ordinary
        self.threshold, self.weights = 4, (-3.0, 1.0, 0.3)

    def compressors(self) -> list:
        p = zstandard.ZstdCompressionParameters(
            window_log=16, chain_log=14, hash_log=14, search_log=3, min_match=4, target_length=16, strategy=zstandard.STRATEGY_BTOPT,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        out = []
        for content in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(content + b"\x00" + PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)
        return out

    def margins(self, text: str | None, compressors: list) -> list[int]:
        ordinary, toxic = compressors
        return [len(ordinary(w)) - len(toxic(w)) for w in windows_of(words_of(text))]

    def evidence(self, margins: list[int]) -> tuple[float, float]:
        t = self.threshold
        return float(sum(m - t + 1 for m in margins if m >= t)), float(max(0, max(margins, default=0)))

    def score(self, margins: list[int]) -> float:
        total, most = self.evidence(margins)
        a, b, c = self.weights
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(total) + c * most, -30, 30))))

    def calibrate(self, texts: list[str], labels: np.ndarray) -> Model:
        """The threshold that few ordinary windows reach, then the logistic weights."""
        zs = self.compressors()
        margins = [self.margins(t, zs) for t in texts]
        quiet = np.sort(np.concatenate([np.array(m or [0]) for m, y in zip(margins, labels) if not y] or [np.zeros(1)]))
        self.threshold = max(2, int(quiet[min(len(quiet) - 1, int(len(quiet) * (1 - QUIET)))]) + 1)
        e = np.array([self.evidence(m) for m in margins])
        x = np.stack([np.ones(len(e)), np.log1p(e[:, 0]), e[:, 1]], 1)
        w = np.zeros(3)
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-x @ w))
            w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(3) * 0.5, x.T @ (labels - p) - 0.5 * w)
        self.weights = tuple(map(float, w))
        return self


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(part of use, label, text): bounded samples of the labelled rows that are no held-out ones."""
    y = labels.select(F.col("doc_id").alias("i"), F.col(label).cast("int").alias("y")).filter("i IS NOT NULL AND y IN (0, 1)").filter(remainder("i", 3) != 1)
    y = y.groupBy("i").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    place = F.pmod(F.xxhash64("i", F.lit(9)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = lambda rows: F.coalesce(F.create_map(*[F.lit(x) for k in (0, 1) for x in (k, rows[k] / max(1, counts.get(k, 1)))])[F.col("y")], F.lit(0.0))
    first, both = share(DICTIONARY_ROWS), share({k: DICTIONARY_ROWS[k] + CALIBRATION_ROWS[k] for k in (0, 1)})
    # of few labelled rows, two thirds make the dictionaries
    first = F.least(first, F.lit(2 / 3))
    some = y.withColumn("place", place).filter(F.col("place") < both).withColumn("first", F.col("place") < first)
    d = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")).filter("t IS NOT NULL")
    at = lambda j: F.pmod(F.xxhash64("i", F.lit(j)), F.greatest(F.lit(1), F.length("t") - PART)).cast("int") + 1
    parts = F.when(F.length("t") <= PARTS * PART, F.col("t")).otherwise(F.concat_ws(" ", *[F.substring("t", at(j), F.lit(PART)) for j in range(PARTS)]))
    return d.join(F.broadcast(some), "i").select("i", "first", "y", parts.alias("t"))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    rows = sorted((r["i"], r["first"], r["y"], r["t"]) for r in training_rows(docs, labels).collect())
    texts = {(f, y): [t for _, a, b, t in rows if (a, b) == (f, y)] for f in (True, False) for y in (0, 1)}
    if not all(texts.values()):
        return None
    toxic, ordinary = contexts(texts[True, 1]), contexts(texts[True, 0])
    model = Model(dictionary(toxic, ordinary), dictionary(ordinary, toxic))
    return model.calibrate(texts[False, 0] + texts[False, 1], np.array([0.0] * len(texts[False, 0]) + [1.0] * len(texts[False, 1])))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    ``held_out`` are ids whose crc32 as text, mod 3, is 1 (false for a null id). A null or
    empty text has no evidence and gets the score of that. Without labelled rows of both
    kinds there is no model, and every score is 0. All windows of a text count, however many.
    Repeated rows are scored each; no rows give no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value
        zs = m.compressors() if m else []

        def judge(texts):
            p = [m.score(m.margins(t, zs)) if m else 0.0 for t in texts]
            return None, [p, [int(x >= CUT) for x in p]]

        return judge

    d = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder(id_col, 3) == 1, F.lit(False)).alias("held_out"), col(text_col).cast("string").alias("text"))
    return over_texts(d, start, "score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
