"""Operator 7: quality by hierarchical empirical Bayes.

A logistic classifier of the text gives each document's evidence. Evidence (labels where they
may be learnt from, the classifier's probability elsewhere) is summed by site and by path of a
site over all documents. Beta priors shrink them: a site toward the global mean, a path toward
its site, each by a strength that the spread of the level's means sets (method of moments), so
sparse sites stay near the prior. A document's posterior odds are its classifier's odds moved
from the prior of training to that of its path, as the other documents there have it.

The site is ``source`` and the path within it ``lang``, as documents have no urls. The
classifier is fitted on a bounded sample of labelled rows, about ``FIT_ROWS`` by a hash of the
id, ids whose crc32 as text, mod 4, is 3 left out; all sums are over all documents. Groups of
any size are aggregated map-side, and the join back has one row per path on one side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import col, durable, over_texts, table
from .language_id import remainder

FIT_ROWS = 6000
BYTE_KINDS = [range(65, 91), range(97, 123), range(48, 58), [32], [10], [44, 46], [33, 35, 36, 37, 38, 42, 124], range(128, 256)]
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def features(text: str | None) -> list[float]:
    """Of a whole text: shares of byte kinds, lengths, repetition of words and lines."""
    t = text or ""
    raw = t.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(1, len(raw))
    words, lines = raw.split(), raw.split(b"\n")
    return [
        *(float(counts[list(k)].sum()) for k in BYTE_KINDS),
        float(np.log1p(len(raw))), len(raw) / max(1, len(words)) / 10, len(set(words)) / max(1, len(words)),
        len(set(lines)) / len(lines), float(np.log1p(len(raw) / len(lines))),
        max((len(w) for w in words), default=0) ** 0.5 / 10,
    ]


class Logistic:
    """Standardised features, Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._z(x)
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w = w + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.eye(len(w)), z.T @ (y - p) - w)
        self.weights, self.prior = w, float(np.clip(y.mean(), 1e-3, 1 - 1e-3))

    def _z(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, z * z / 8], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._z(x) @ self.weights, -12, 12)


def fit(docs: DataFrame, labels: DataFrame) -> Logistic | None:
    """Executors measure the sampled whole texts; only the features come to the driver."""
    n = labels.count()
    some = labels.filter(F.pmod(F.xxhash64("i", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, FIT_ROWS / max(1, n))))
    sample = docs.join(F.broadcast(some), "i").select("i", "y", "t")
    rows = over_texts(sample, lambda: lambda texts: (None, [[features(t) for t in texts]]), "x array<double>").collect()
    rows = sorted((r["i"], r["y"], r["x"]) for r in rows)
    y = np.array([float(r[1]) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    return Logistic(np.array([x for _, _, x in rows]), y)


def strength(means: DataFrame) -> float:
    """The Beta prior's weight from the spread of a level's means: (mean, n, prior) rows. The
    noise that groups of their size have anyway is taken off first."""
    r = means.agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("prior"), 2)).alias("spread"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))).alias("v"),
    ).first()
    if not r["k"] or not r["n"] or not r["v"]:
        return MOST_STRENGTH
    each = r["v"] / r["n"]
    between = (r["spread"] - r["k"] * each) / r["n"]
    return float(np.clip(each / between - 1, LEAST_STRENGTH, MOST_STRENGTH)) if between > 0 else MOST_STRENGTH


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, evidence, site_mean, path_mean, score, predicted.

    Null sites and null paths are groups of their own; a null text is an empty one. Labels
    that contradict each other count as their mean, at least half being good. Rows with a null
    id have no label. Repeated rows each count and are each scored. Without labels of both
    kinds the evidence is even (0.5) and so is every score. Ties of score go to good. No rows
    give no rows; whole texts of any length are read; other columns are ignored. ``site_mean``
    and ``path_mean`` leave the row's own evidence out.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(col(id_col).cast("long").alias("i"), col(text_col).alias("t"), F.coalesce(col(site_col).cast("string"), F.lit("\x00")).alias("site"), F.coalesce(col(path_col).cast("string"), F.lit("\x00")).alias("path"))
    y = labels.select(col("doc_id").cast("long").alias("i"), col("quality").cast("double").alias("y")).filter("i IS NOT NULL AND y IS NOT NULL").filter(remainder("i", 4) != 3)
    y = durable(y.groupBy("i").agg((F.avg("y") >= 0.5).cast("int").alias("y")), "labels")
    model = fit(d, y)
    shared = spark.sparkContext.broadcast(model)

    def start():
        m = shared.value

        def judge(texts):
            x = np.array([features(t) for t in texts]).reshape(len(texts), -1)
            return None, [m.logit(x) if m else np.zeros(len(texts))]

        return judge

    seen = over_texts(d.select("i", "site", "path", "t"), start, "logit double")
    known = seen.join(y, "i", "left").withColumn("e", F.coalesce(F.col("y").cast("double"), 1 / (1 + F.exp(-F.col("logit"))))).drop("y")
    known = durable(known, "evidence")
    paths = durable(known.groupBy("site", "path").agg(F.sum("e").alias("e"), F.count(F.lit(1)).alias("n")), "paths")
    sites = durable(paths.groupBy("site").agg(F.sum("e").alias("e"), F.sum("n").alias("n")), "sites")
    total = sites.agg(F.sum("e").alias("e"), F.sum("n").alias("n")).first()
    prior = float(np.clip((total["e"] or 0.0) / max(1, total["n"] or 0), 1e-3, 1 - 1e-3)) if total["n"] else 0.5
    ks = strength(sites.select((F.col("e") / F.col("n")).alias("mean"), "n", F.lit(prior).alias("prior")))
    at_site = lambda e, n: (e + ks * prior) / (n + ks)
    both = paths.join(sites.select("site", F.col("e").alias("se"), F.col("n").alias("sn")), "site")
    kp = strength(both.select((F.col("e") / F.col("n")).alias("mean"), "n", at_site(F.col("se"), F.col("sn")).alias("prior")))
    both = durable(both.select("site", "path", F.col("e").alias("pe"), F.col("n").alias("pn"), "se", "sn"), "sums")
    odds = lambda c: F.log(c / (1 - c))
    base = float(np.log(model.prior / (1 - model.prior))) if model else 0.0
    # a document's own evidence, its label above all, is taken off before its path judges it
    out = known.join(both, ["site", "path"]).withColumn("site_mean", at_site(F.col("se") - F.col("e"), F.col("sn") - 1))
    out = out.withColumn("path_mean", (F.col("pe") - F.col("e") + kp * F.col("site_mean")) / (F.col("pn") - 1 + kp))
    held = F.least(F.greatest(F.col("path_mean"), F.lit(1e-3)), F.lit(1 - 1e-3))
    p = 1 / (1 + F.exp(-(F.col("logit") - base + odds(held)))) if model else F.lit(0.5)
    out = out.select(
        F.col("i").alias("doc_id"), F.coalesce(remainder("i", 4) == 3, F.lit(False)).alias("held_out"),
        (1 / (1 + F.exp(-F.col("logit")))).alias("evidence"), "site_mean", "path_mean", p.alias("score"),
    )
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quality`` of all documents; nulls, ties, empty and repeated rows: as stated there."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
