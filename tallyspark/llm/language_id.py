"""Operator 3: language ID by a convolutional network over bytes.

Bytes fall in 64 classes (letters without case, digits, marks, UTF-8 parts). Filters of
widths 2, 3 and 4 slide over windows of ``WINDOW`` bytes; each filter's largest answer in the
window goes through a dense layer and a softmax. The network is trained in numpy, by Adam, on
windows of a bounded sample of labelled rows: about ``PER_LANG`` rows of each language, of all
languages ``MOST_ROWS`` at most, and ``WINDOWS_A_ROW`` windows of each row, chosen by a hash of
the id.

A filter's answer depends on 2 to 4 classes only, so for use it becomes a table, 16 bytes a
row (16 filters of 8 bits, or 8 of 16 bits in two halves for width 4): a window costs one
lookup a byte and table, and a maximum. All windows of a whole text count, by their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import col, durable, over_texts, slices, table, tidy

WINDOW = 256
PER_LANG, WINDOWS_A_ROW, MOST_ROWS = 800, 3, 100_000
EPOCHS, BATCH, RATE, SEED = 3, 64, 0.01, 7
CLASSES = 64
WIDTHS = {2: 16, 3: 16, 4: 8}
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def byte_classes() -> np.ndarray:
    c = np.zeros(256, np.uint8)
    c[1:128] = 29
    c[[32, *range(9, 14)]] = 1
    for i in range(26):
        c[[65 + i, 97 + i]] = 2 + i
    c[48:58] = 28
    c[128:192] = 30 + (np.arange(128, 192) & 31)  # accents of either case fall together
    c[192:224], c[224:] = 62, 63
    return c


BYTE_CLASS = byte_classes()


def windows_of(raw: bytes) -> np.ndarray:
    """The classes of a text's windows, the last one padded with class 0."""
    n = max(1, -(-len(raw) // WINDOW))
    return BYTE_CLASS[np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8)].reshape(n, WINDOW)


class Network:
    def __init__(self, langs: list[str]):
        r = np.random.default_rng(SEED)
        self.langs = langs
        self.filters = {w: (r.standard_normal((w, CLASSES, f)) * 0.1).astype(np.float32) for w, f in WIDTHS.items()}
        self.bias = {w: np.zeros(f, np.float32) for w, f in WIDTHS.items()}
        self.dense = (r.standard_normal((sum(WIDTHS.values()), len(langs))) * 0.1).astype(np.float32)
        self.offset = np.zeros(len(langs), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters.values(), *self.bias.values(), self.dense, self.offset]

    def train(self, x: np.ndarray, y: np.ndarray) -> Network:
        """x: classes of windows, y: numbers of languages. Languages weigh alike."""
        r = np.random.default_rng(SEED)
        weight = (len(y) / np.maximum(np.bincount(y, minlength=len(self.langs)), 1) / len(self.langs)).astype(np.float32)
        ps = self.parameters()
        m, v, t = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps], 0
        for _ in range(EPOCHS):
            order = r.permutation(len(y))
            for at in range(0, len(y), BATCH):
                pick = order[at : at + BATCH]
                grads = self._gradients(x[pick], y[pick], weight)
                t += 1
                for p, g, a, b in zip(ps, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        n, pooled, where = len(x), [], {}
        for w, f in WIDTHS.items():
            z = sum(self.filters[w][j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
            where[w] = z.argmax(1)
            pooled.append(np.take_along_axis(z, where[w][:, None, :], 1)[:, 0] + self.bias[w])
        h = np.concatenate(pooled, 1)
        act = np.maximum(h, 0)
        p = softmax(act @ self.dense + self.offset)
        p[np.arange(n), y] -= 1
        p *= weight[y][:, None] / n
        back = (p @ self.dense.T) * (h > 0)
        gf, gb, at = [], [], 0
        for w, f in WIDTHS.items():
            own = back[:, at : at + f]
            at += f
            g = np.zeros_like(self.filters[w])
            for j in range(w):
                np.add.at(g[j], (np.take_along_axis(x, where[w] + j, 1), np.arange(f)[None, :]), own)
            gf.append(g)
            gb.append(own.sum(0))
        return [*gf, *gb, act.T @ p, p.sum(0)]

    def tables(self) -> Tables:
        return Tables(self)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Tables:
    """The network for use: answers of all filters to all n-grams of classes, in few bits."""

    def __init__(self, net: Network):
        self.langs, self.dense, self.offset = net.langs, net.dense, net.offset
        self.bias = np.concatenate([net.bias[w] for w in WIDTHS])
        f2, f3, f4 = (net.filters[w] for w in (2, 3, 4))
        pair = f2[0][:, None] + f2[1][None]
        triple = f3[0][:, None, None] + f3[1][None, :, None] + f3[2][None, None]
        self.t2, self.s2 = self._eight_bits(pair.reshape(-1, 16))
        self.t3, self.s3 = self._eight_bits(triple.reshape(-1, 16))
        front, rear = (f4[a][:, None] + f4[b][None] for a, b in ((0, 1), (2, 3)))
        self.s4 = 15000 / max(1e-6, np.abs(front).max(), np.abs(rear).max())
        self.t4 = [np.ascontiguousarray(np.round(t.reshape(-1, 8) * self.s4).astype(np.int16)).view(np.complex128)[:, 0] for t in (front, rear)]

    @staticmethod
    def _eight_bits(t: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        low = t.min(0)
        step = np.maximum((t.max(0) - low) / 255, 1e-9)
        return np.ascontiguousarray(np.round((t - low) / step).astype(np.uint8)).view(np.complex128)[:, 0], (low, step)

    @staticmethod
    def _largest(a: np.ndarray, kind) -> np.ndarray:
        """The maximum over the WINDOW positions of 16-byte rows, by halves."""
        a = a.view(kind).reshape(len(a), -1)
        while a.shape[1] * a.itemsize > 16:
            half = a.shape[1] // 2
            a = np.maximum(a[:, :half], a[:, half:])
        return a.astype(np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Languages of windows (classes, n by WINDOW)."""
        c = x.astype(np.int32)
        pair = np.zeros_like(c)
        pair[:, :-1] = c[:, :-1] * CLASSES + c[:, 1:]
        pair[:, -1] = pair[:, 0]
        triple = np.zeros_like(c)
        triple[:, :-2] = pair[:, :-2] * CLASSES + c[:, 2:]
        triple[:, -2:] = triple[:, :1]
        first, last = pair.copy(), np.zeros_like(c)
        last[:, :-3] = pair[:, 2:-1]
        first[:, -3:], last[:, -3:] = first[:, :1], last[:, :1]
        h2 = self._largest(self.t2[pair], np.uint8) * self.s2[1] + self.s2[0]
        h3 = self._largest(self.t3[triple], np.uint8) * self.s3[1] + self.s3[0]
        both = self.t4[0][first].view(np.int16) + self.t4[1][last].view(np.int16)
        h4 = self._largest(both, np.int16) / np.float32(self.s4)
        act = np.maximum(np.concatenate([h2, h3, h4], 1) + self.bias, 0)
        return softmax(act @ self.dense + self.offset)

    def judge(self, texts: list[str | None], most: int = 1024, habits: Habits | None = None, tally: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
        """Language and score of each whole text; ``most`` windows are in memory at a time.
        With ``habits`` each text's counts are added to its row of ``tally``."""
        total, sizes = np.zeros((len(texts), max(1, len(self.langs)))), np.zeros(len(texts))
        owners, held = [], []

        def flush() -> None:
            if held:
                x = np.concatenate(held)
                owner = np.concatenate(owners)
                size = (x != 0).sum(1)
                p = self.probabilities(x)
                np.add.at(total, owner, p * size[:, None])
                if habits is not None:
                    np.add.at(tally, owner, habits.count(x, p.argmax(1)))
                np.add.at(sizes, owner, size)
                held.clear()
                owners.clear()

        known = [bool(self.langs and t and LETTER.search(t)) for t in texts]
        for i, t in enumerate(texts):
            if known[i]:
                raw = t.encode()
                for at in range(0, len(raw), WINDOW * most):
                    x = windows_of(raw[at : at + WINDOW * most])
                    held.append(x)
                    owners.append(np.full(len(x), i))
                    if sum(map(len, held)) >= most:
                        flush()
        flush()
        p = total / np.maximum(sizes, 1)[:, None]
        best = p.argmax(1)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)


class Habits:
    """How many bits each letter costs after the two classes before it, by language: what tells
    text of a language from noise, code and languages that weren't learnt. The softmax can't, as
    it shares out all of its weight among the languages whatever the text.

    A triple of classes counts if one in ``ONE_IN`` of a language's training rows has it, and two
    rows at least, so rows of noise that bear a language's label teach nothing.
    ``noise`` is the mean cost of letters drawn evenly, ``spread`` the deviation of one letter's
    cost in the training windows.
    """

    SMOOTH, STEP, ONE_IN = 8.0, 8, 100  # bits are kept in eighths

    def __init__(self, n_langs: int, x: np.ndarray, y: np.ndarray, row: np.ndarray):
        self.letter = np.zeros(CLASSES, bool)
        self.letter[2:28] = self.letter[30:] = True
        self.bits = np.zeros((n_langs, CLASSES**3), np.uint8)
        for k in range(n_langs):
            c = x[y == k].astype(np.int64)
            triple = (c[:, :-2] * CLASSES + c[:, 1:-1]) * CLASSES + c[:, 2:]
            rows, own = np.unique(row[y == k], return_inverse=True)
            met = np.bincount(np.unique(own[:, None] * CLASSES**3 + triple) % CLASSES**3, minlength=CLASSES**3)
            n3 = np.bincount(triple.ravel(), minlength=CLASSES**3).astype(float)
            n3[met < min(len(rows), max(2, len(rows) // self.ONE_IN))] = 0
            n3 = n3.reshape(CLASSES, CLASSES, CLASSES)
            n3[:, :, 0] = 0
            n2 = n3.sum(0)
            n1 = n2.sum(0)
            p1 = (n1 + 0.5) / (n1.sum() + 0.5 * CLASSES)
            p2 = (n2 + self.SMOOTH * p1) / (n2.sum(1, keepdims=True) + self.SMOOTH)
            p3 = (n3 + self.SMOOTH * p2) / (n3.sum(2, keepdims=True) + self.SMOOTH)
            self.bits[k] = np.clip(np.round(-np.log2(p3) * self.STEP), 0, 255).astype(np.uint8).ravel()
        plain = np.arange(2, 28)
        self.noise = float(self.bits.reshape(-1, CLASSES, CLASSES, CLASSES)[:, plain][:, :, plain][:, :, :, plain].mean() / self.STEP) if n_langs else 0.0
        self.spread = 0.0
        if n_langs:
            cost, met = self._costs(x, y)
            self.spread = float(cost[met].std() / self.STEP) if met.any() else 0.0

    def _costs(self, x: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = x.astype(np.int32)
        return self.bits[lang[:, None], (c[:, :-2] * CLASSES + c[:, 1:-1]) * CLASSES + c[:, 2:]], self.letter[x[:, 2:]]

    def count(self, x: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Of windows and their languages: bits, letters they are of, all letters, all bytes but spaces."""
        cost, met = self._costs(x, lang)
        return np.stack([np.where(met, cost, 0).sum(1) / self.STEP, met.sum(1), self.letter[x].sum(1), (x > 1).sum(1)], 1).astype(float)


def remainder(id_col: str, n: int):
    return F.pmod(F.crc32(col(id_col).cast("string").cast("binary")), F.lit(n))


def training_windows(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> list[tuple[str, str, int]]:
    """(language, part of a text, hash of its row's id): about ``per_lang`` rows of each language by
    a hash of the id, of very many languages less, so that all rows are about ``MOST_ROWS`` at
    most; ``WINDOWS_A_ROW`` parts of each, a quarter of them short."""
    d = labelled.select(col(id_col).alias("i"), col(text_col).alias("t"), col(lang_col).alias("y")).filter("i IS NOT NULL AND y IS NOT NULL AND t RLIKE '\\\\p{L}'")
    counts = durable(d.groupBy("y").agg(F.count(F.lit(1)).alias("k")), "languages")
    langs = counts.count()
    if not langs:
        return []
    rows = min(float(per_lang), MOST_ROWS / langs)
    some = d.join(counts, "y").filter(F.pmod(F.xxhash64("i", F.lit(SEED)), F.lit(1 << 20)) < F.lit(rows) / F.col("k") * (1 << 20))
    at = lambda j: F.pmod(F.xxhash64("i", F.lit(j)), F.greatest(F.lit(1), F.length("t") - WINDOW)).cast("int") + 1
    size = lambda j: F.when(F.pmod(F.xxhash64("i", F.lit(100 + j)), F.lit(4)) == 0, 40).otherwise(WINDOW)
    parts = some.select("y", F.explode(F.array_distinct(F.array(*[F.substring("t", at(j), size(j)) for j in range(WINDOWS_A_ROW)]))).alias("part"), F.xxhash64("i").alias("h"))
    return [(r["y"], r["part"], r["h"]) for r in parts.orderBy("y", "h", "part").collect()]


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> tuple[Tables, Habits]:
    parts = training_windows(labelled, id_col, text_col, lang_col, per_lang)
    langs = sorted({y for y, _, _ in parts})
    if not langs:
        return Tables(Network([])), Habits(0, np.zeros((0, WINDOW), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    number = {y: i for i, y in enumerate(langs)}
    x = np.concatenate([windows_of(t.encode())[:1] for _, t, _ in parts])
    y = np.array([number[y] for y, _, _ in parts])
    return Network(langs).train(x, y).tables(), Habits(len(langs), x, y, np.array([h for _, _, h in parts]))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Tables:
    return learn(labelled, id_col, text_col, lang_col, per_lang)[0]


def identify(docs: DataFrame, model: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    ``held_out`` are ids that training leaves out (crc32 of the id as text, mod 4, is 2; false
    for a null id). A null text, or one without letters, is ``und`` with score 0, and so is
    every text where there was nothing to learn from. Ties go to the language that sorts first.
    Repeated rows are judged each; no rows give no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts):
        return None, shared.value.judge(texts)

    d = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder(id_col, 4) == 2, F.lit(False)).alias("held_out"), col(text_col).cast("string").alias("text"))
    return over_texts(d, lambda: judge, "lang_pred string, score double")


#: A text is rejected from half way between what a letter costs in the corpus and in noise. Short
#: texts may cost more, by this many deviations of their mean.
HALF_WAY, SHORT = 0.5, 4.0
#: ... and so is one with less than this part of the corpus' usual share of letters.
LETTERS = 0.25


def levels(docs: DataFrame, model: Tables, habits: Habits, text_col: str = "text") -> tuple[float, float]:
    """(most bits a letter, least share of letters) that a text of a language has: from the
    medians over all rows, so noise doesn't move them while it is less than half of the rows."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model, habits))

    def start():
        model, habits = shared.value

        def measure(texts):
            tally = np.zeros((len(texts), 4))
            model.judge(texts, habits=habits, tally=tally)
            rows = np.flatnonzero(tally[:, 1] > 0)
            return rows, [tally[rows, 0] / tally[rows, 1], tally[rows, 2] / tally[rows, 3]]

        return measure

    seen = over_texts(docs.select(col(text_col).cast("string").alias("text")), start, "bits double, share double")
    usual = seen.agg(F.percentile_approx("bits", 0.5, 10000).alias("bits"), F.percentile_approx("share", 0.5, 10000).alias("share")).first()
    if usual["bits"] is None:
        return float("inf"), 0.0
    return usual["bits"] + HALF_WAY * max(0.0, habits.noise - usual["bits"]), LETTERS * usual["share"]


def keep(docs: DataFrame, model: Tables, habits: Habits, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is in a language: each window's is the
    network's choice, and the text's letters must follow each other as they do in it."""
    most, least = levels(docs, model, habits, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model, habits))

    def judge(batches):
        model, habits = shared.value
        for batch in batches:
            at = batch.schema.names.index(text_col)
            for b in slices(batch, at):
                texts = b.column(at).to_pylist()
                tally = np.zeros((len(texts), 4))
                langs, _ = model.judge(texts, habits=habits, tally=tally)
                n = np.maximum(tally[:, 1], 1)
                good = (tally[:, 0] / n <= most + SHORT * habits.spread / np.sqrt(n)) & (tally[:, 2] >= least * tally[:, 3])
                yield b.filter(pa.array([bool(g) and y != UNKNOWN for y, g in zip(langs, good)], pa.bool_()))

    return docs.mapInArrow(tidy(judge), docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``identify`` for all documents: doc_id, held_out, lang_pred, score, by a network that has
    seen no held-out row. Nulls, texts without letters, ties, repeats: as stated there."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs.filter(remainder("doc_id", 4) != 2)))
