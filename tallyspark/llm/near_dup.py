"""Operator 6: n-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when their sets of distinct 5-word shingles have a Jaccard similarity of
0.75 or more. The result is exact up to 64-bit hashes of shingles.

1. A sketch of fixed size counts, over all documents, how many hold each shingle bucket.
   Shingles are ordered from rare to frequent by it.
2. Each document takes a prefix of its ordered set. A link needs an overlap of c = ceil(0.75 n),
   so two linked documents share at least l tokens of their prefixes of length n - c + l. Each
   document picks the l of least estimated cost: the listed lengths of its prefix tokens,
   plus the candidates to verify, which a larger l makes fewer.
3. Documents with equal sets become one class.
4. Star links: classes that share three of six minima of random orders are verified against
   the most typical such class only, then, where components differ still, against the ends of
   finer groups. Large families of near copies so become one component, or few, at linear
   cost.
5. The multi-match join: classes of different components that share as many prefix tokens as
   a link needs are candidates. Tokens that one component alone holds (nearly
   all, those of large families too) drop out of an aggregate before anything is paired, of
   tokens held by the same classes all but the first do, and within a token the largest component
   is paired only against the others. Pairs are made where they first meet, not on each token. No link between
   different components is lost; those within one can't change a component.
6. Candidates are verified on whole sets, and the components joined.

Sets are made anew for candidates only; what all documents write is their prefix (a quarter
of their shingles).
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, id_text, over_texts, slices, table, tidy
from .graph import components
from .words import mix, shingle_sets

PERCENT = 75
BITS = 19  # of the sketch: 4 MB
BLOCKS = 64
FAN = 256
MOST_MATCHES, VERIFY = 8, 4.0  # largest l; cost of a verification, in list entries
MINIMA = [0x9E3779B97F4A7C15 * k % 2**64 for k in range(1, 7)]
STAR_MINIMA = 3  # shared ones before a star link is verified
BEFORE = 4  # tokens before one, of which none may be shared where a pair is made
#: Log of the bits of the broadcast bitmaps: 8 to 16 a key, within these bounds (1 to 8 MB).
FILTER_BITS = 23, 26


def frequency_sketch(docs: DataFrame) -> np.ndarray:
    """Documents by shingle bucket, over all rows. Tasks give arrays of fixed size, which are
    added up in levels of at most ``FAN``."""

    def count(batches):
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1).to_pylist())
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        if total.any():
            counts = [x.astype(np.uint32).tobytes() if x.max(initial=0) < 2**32 else x.tobytes() for x in np.split(total, BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * BLOCKS, pa.int64()), pa.array(range(BLOCKS), pa.int32()), pa.array(counts, pa.binary())], names=["part", "block", "counts"])

    def numbers(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.uint32 if len(raw) == 4 * (1 << BITS) // BLOCKS else np.int64).astype(np.int64)

    def add(group):
        total = np.zeros((1 << BITS) // BLOCKS, np.int64)
        for raw in group.column("counts"):
            total += numbers(raw.as_py())
        return pa.table({"part": group.column("part")[:1], "block": group.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part long, block int, counts binary"
    n, level = docs.rdd.getNumPartitions(), docs.mapInArrow(tidy(count), schema)
    while n > 1:
        level = level.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part", "block").applyInArrow(add, schema)
        n = -(-n // FAN)
    out = np.zeros((BLOCKS, (1 << BITS) // BLOCKS), np.int64)
    for r in level.collect():  # BLOCKS rows
        out[r["block"]] = numbers(bytes(r["counts"]))
    return out.reshape(-1)


def matches_needed(weights: np.ndarray, n: int, must: int) -> int:
    """The l of least cost; weights: estimated list lengths of the ordered tokens."""
    most = min(MOST_MATCHES, must)
    if most <= 1:
        return 1
    ls = np.arange(1, most + 1)
    ends = n - must + ls
    listed = np.cumsum(weights[: ends[-1]])[ends - 1]
    return int(ls[np.argmin(ends + listed * (1 + VERIFY / ls))])


def signatures(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(doc_id, n, l, rare, sig, prefix, minima) of each row; rare: tokens with no sign of a
    second document."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    usual = float(np.median(sketch))
    noise = usual + 3 * usual**0.5

    def start():
        counts = shared.value

        def sign(texts):
            rows = []
            for s in shingle_sets(texts):
                n = len(s)
                must = (PERCENT * n + 99) // 100
                est = counts[(s >> np.uint64(64 - BITS)).astype(np.int64)]
                order = np.argsort(est, kind="stable")  # ties by hash: s is sorted
                l = matches_needed(np.maximum(est[order] - noise, 0.0), n, must) if n else 0
                prefix = s[order[: n - must + l]].astype(np.int64)
                minima = np.array([mix(s ^ np.uint64(x)).min() for x in MINIMA] if n else [], np.uint64).astype(np.int64)
                rows.append((n, l, int((est <= noise).sum()), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), prefix, minima))
            return None, list(zip(*rows))

        return sign

    return over_texts(docs, start, "n long, l int, rare long, sig binary, prefix array<long>, minima array<long>")


class Bitmap:
    """Which values a column may have: a broadcast of bits of its values' hashes.

    Its size follows the number of rows up to a bound. Far beyond that most bits are set, and it
    keeps back little: joins are then what they would be without it.
    """

    def __init__(self, keys: DataFrame, *columns: str):
        keys = keys.select(*columns)
        self.bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (8 * keys.count()).bit_length()))
        b = keys.select(self._bit(*columns).alias("bit"))
        words = b.groupBy(F.shiftright("bit", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("_bits"))
        self.words = durable(words, "bitmap")

    def _bit(self, *columns):
        return F.pmod(F.xxhash64(*columns), F.lit(1 << self.bits))

    def mark(self, df: DataFrame, hit: str, *columns) -> DataFrame:
        """``df`` with a column ``hit``: true for all rows with such values, and few others."""
        at = df.withColumn("_bit", self._bit(*columns)).withColumn("_word", F.shiftright("_bit", 6)).join(F.broadcast(self.words), "_word", "left")
        return at.withColumn(hit, F.coalesce(F.expr("(shiftright(_bits, cast(_bit & 63 as int)) & 1L) = 1"), F.lit(False))).drop("_bit", "_word", "_bits")


def maybe_in(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose column has one of the keys, and few others."""
    return Bitmap(keys, key).mark(df, "_hit", column).filter("_hit").drop("_hit")


def linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose whole shingle sets are similar enough."""
    pairs = durable(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    some = maybe_in(docs.filter("doc_id IS NOT NULL"), "doc_id", ids, "doc_id")
    sets = over_texts(some, lambda: lambda texts: (None, [[s.astype(np.int64) for s in shingle_sets(texts)]]), "s array<long>")
    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    both = two.withColumn("k", F.size(F.array_intersect("sa", "sb")))  # row by row: no batch holds many long sets
    similar = both.filter(f"k > 0 AND 100L * k >= {PERCENT} * (size(sa) + size(sb) - k)")
    return durable(similar.select(*pairs.columns), "links")


SIMILAR_SIZES = f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"
#: Shared prefix tokens that a link needs. Its overlap is at least 3/7 of both sizes, and the
#: document whose prefix ends first in the order has no more than c - l tokens after it.
_AFTER = lambda s: f"floor(({PERCENT} * n{s} + 99) / 100) - l{s}"
NEED = f"greatest(least(la, lb), ceil({PERCENT} * (na + nb) / {100 + PERCENT}) - greatest({_AFTER('a')}, {_AFTER('b')}))"


def star_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): each class with one that shares enough of its minima: the one with the fewest
    rare tokens, which in a family of copies is nearest to what they were copied from."""
    each = classes.select("rep", "n", "rare", F.posexplode("minima").alias("j", "m"))
    first = durable(each.groupBy("j", "m").agg(F.min(F.struct("rare", "rep", "n")).alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1"), "firsts")
    p = each.join(first, ["j", "m"]).select(F.col("rep").alias("a"), F.col("first.rep").alias("b"), F.col("n").alias("na"), F.col("first.n").alias("nb"))
    return p.filter(f"a <> b AND {SIMILAR_SIZES}").groupBy("a", "b").count().filter(f"count >= {STAR_MINIMA}").select("a", "b")


def finer_star_pairs(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, ca, cb): each class with those of the fewest and the most rare tokens that share
    three given minima, where their components differ still."""
    three = [F.xxhash64(F.lit(i), *[F.col("minima")[k] for k in t]) for i, t in enumerate(combinations(range(len(MINIMA)), STAR_MINIMA)) if i % 2]
    own = F.struct("rare", "rep", "n", "comp")
    each = classes.join(labels.select("rep", "comp"), "rep").select(own.alias("own"), F.explode(F.array(*three)).alias("key"))
    ends = each.groupBy("key").agg(F.min("own").alias("first"), F.max("own").alias("last"), F.min("own.comp").alias("lo"), F.max("own.comp").alias("hi"))
    ends = durable(ends.filter("lo <> hi").select("key", F.array("first", "last").alias("ends")), "ends")
    p = each.join(ends, "key").select("own", F.explode("ends").alias("end")).filter("own.comp <> end.comp")
    p = p.select(F.col("own.rep").alias("a"), F.col("end.rep").alias("b"), F.col("own.comp").alias("ca"), F.col("end.comp").alias("cb"), F.col("own.n").alias("na"), F.col("end.n").alias("nb"))
    return p.filter(SIMILAR_SIZES).select("a", "b", "ca", "cb").distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, row, sig, comp) after links (ca, cb) between components."""
    m = components(links, "ca", "cb").select(F.col("node").alias("comp"), F.col("comp").alias("final"))
    return durable(labels.join(m, "comp", "left").select("rep", "row", "sig", F.coalesce("final", "comp").alias("comp")), "labels")


def meetings(signed: DataFrame, labels: DataFrame) -> DataFrame:
    """(ra, rb, ca, cb): classes of different components that meet on a prefix token, nearly always once.

    Of all tokens that two linked documents share the first in the order is in both prefixes. From
    there on each of them has the whole overlap, at least ceil(3/7 (na + nb)) tokens, so it is among
    the first n - ceil(6n/7) + 1 of the shorter one, and as many tokens of its prefix that span
    components as a link needs. Pairs are made on tokens where that holds, and not where they share
    one of the ``BEFORE`` tokens before: there they have met. Of tokens with the same
    documents the first tells as much as all.
    """
    own = signed.select("row", "n", "l", "prefix").join(labels.select("row", "rep", "comp"), "row")
    t = own.select(F.posexplode("prefix").alias("pos", "token"), "rep", "n", "l", "comp").withColumn("early", F.expr(f"pos <= n - ceil({2 * PERCENT} * n / {100 + PERCENT})"))
    spanning = durable(t.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("early").alias("any")).filter("lo <> hi").select("token", "any"), "spanning")
    some = maybe_in(t.drop("early"), "token", spanning, "token")
    x = durable(some.join(spanning, "token"), "tokens")
    main = x.filter("any").groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"), F.expr("bit_xor(xxhash64(rep))").alias("h1"), F.expr("bit_xor(xxhash64(rep, 1))").alias("h2"), F.min(F.struct("rep", "pos")).alias("at"))
    main = main.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("k"), F.expr("bit_xor(h1)").alias("h1"), F.expr("bit_xor(h2)").alias("h2"), F.min("at").alias("at"))
    kept = durable(main.groupBy("k", "h1", "h2").agg(F.min_by(F.struct("token", "main"), "at").alias("f")).select("f.*"), "kept")
    # no more of a prefix can be shared from a token on than its tokens that span components
    by = Window.partitionBy("rep").orderBy("pos")
    x = x.join(kept, "token", "left").withColumn("w", F.count(F.lit(1)).over(Window.partitionBy("rep")) - F.row_number().over(by) + 1).filter("main IS NOT NULL")
    x = durable(x.withColumn("before", F.collect_list("token").over(by.rowsBetween(-BEFORE, -1))).drop("any"), "tokens")
    side = lambda s: x.select("token", "main", *[F.col(c).alias(d + s) for c, d in (("rep", "r"), ("n", "n"), ("l", "l"), ("comp", "c"), ("pos", "p"), ("w", "w"), ("before", "b"))])
    # the documents of the token's largest component meet the others only, never one another
    p = side("a").filter("ca <> main").join(side("b").drop("main"), "token").filter(f"ca <> cb AND (cb = main OR ra < rb) AND {SIMILAR_SIZES} AND least(na - pa, nb - pb) >= ceil({PERCENT} * (na + nb) / {100 + PERCENT}) AND least(wa, wb) >= {NEED} AND NOT arrays_overlap(ba, bb)")
    return p.select("ra", "rb", "ca", "cb")


def cross_pairs(signed: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, ca, cb): candidates between classes of different components: those that meet, and
    whose whole prefixes share what a link needs."""
    p = meetings(signed, labels)
    lo = F.col("ra") < F.col("rb")
    pick = lambda c: (F.when(lo, F.col(c + "a")).otherwise(F.col(c + "b")), F.when(lo, F.col(c + "b")).otherwise(F.col(c + "a")))
    (ra, rb), (ca, cb) = pick("r"), pick("c")
    p = durable(p.select(ra.alias("a"), rb.alias("b"), ca.alias("ca"), cb.alias("cb")).distinct(), "candidates")
    ids = p.select(F.explode(F.array("a", "b")).alias("doc_id"))
    held = maybe_in(signed.filter("n > 0").select("doc_id", "n", "l", "prefix"), "doc_id", ids, "doc_id")
    for s in "ab":
        p = p.join(held.select(F.col("doc_id").alias(s), F.col("n").alias("n" + s), F.col("l").alias("l" + s), F.col("prefix").alias("p" + s)), s)
    # written first: an aggregate right above the joins would keep the skew join from splitting a document of many pairs
    return durable(p.filter(F.size(F.array_intersect("pa", "pb")) >= F.expr(NEED)).select("a", "b", "ca", "cb"), "near").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are lower-cased in A-Z only. A text of fewer than five words is one shingle; a null
    or empty text, or one without words, has no shingle, links with nothing and is its own
    component. Equal sets link, so exact copies share a component. component_id is the
    smallest doc_id reachable by links. Rows that repeat a doc_id are one document to others,
    with any of their texts. A null doc_id takes its class's component, null if it is alone.
    No rows give no rows; other columns are ignored.
    """
    d = id_text(docs, id_col, text_col)
    signed = durable(signatures(d, frequency_sketch(d)).withColumn("row", F.monotonically_increasing_id()), "signed")
    first = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    classes = durable(first.select("sig", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("row")), "classes")
    reps = durable(signed.select("row", "n", "rare", "minima").join(classes.select("row", "rep"), "row").drop("row"), "reps")
    labels = classes.select("rep", "row", "sig", F.col("rep").alias("comp"))
    labels = merged(labels, linked(d, star_pairs(reps).select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))))
    labels = merged(labels, linked(d, finer_star_pairs(reps, labels)))
    labels = merged(labels, linked(d, cross_pairs(signed, labels)))
    final = labels.select("sig", F.col("comp").alias("component_id"))
    return signed.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(final, "sig", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all documents; nulls, ties, empty, long and repeated texts: as stated there."""
    return near_duplicates(table(spark, sf_dir, "documents"))
