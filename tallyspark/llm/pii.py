"""Operator 10 [native]: personal data by weak supervision.

1. Candidates: the base patterns of each kind, and looser ones (obfuscated mail addresses,
   national phone numbers). A pattern's matches are placed natively: ``split`` gives the gaps
   between the texts that ``regexp_extract_all`` gives, and a fold adds up their lengths.
2. Labelers vote 1, 0 or -1 on each candidate: the pattern's own check (ranges, digit counts,
   Luhn), a gazetteer (top-level domains, address blocks, issuer digits, calling codes), cue
   words before it, and the characters right beside it.
3. Expectation-maximisation over the counted vote patterns of each kind (at most 3^4 of
   them, whatever the input) estimates how reliable each labeler is.
4. The posteriors are soft labels of a final span classifier, naive Bayes over votes, length,
   distinct digits and surroundings, fitted on grouped sums.
5. Base spans stay; a looser candidate is added where the classifier is sure of it.

Texts are read twice (candidates are written once, without texts) and never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, id_text, span_digest, table

#: Kinds in the order that breaks ties of the digests.
KINDS = ["email", "ip", "card", "phone"]

#: Possessive where nothing that follows could match otherwise, so that no text, however long,
#: is walked twice. A mail address begins a run of its characters or follows the last match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",  # a run that has digits enough, from its start
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]{1,63}){1,8}",
    "phone": r"(?<![0-9+(])\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A text without this has no match of the kind.
HINT = {
    "email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]",
    "loose email": r"[(\[]at[)\]]", "loose phone": r"\([0-9]{3}\)",
}
#: Fixed gazetteers.
TLDS = "com org net edu gov io info biz de fr es uk it nl eu us ca au jp cn in br ru ch at se pl mx co"
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 971 972"
CUES = {
    "email": r"(?i)(mail|contact|write|reach|correo|courriel|kontakt)", "ip": r"(?i)(\bip\b|host|server|addr|login|from|node|adresse)",
    "card": r"(?i)(card|visa|master|amex|pay|credit|karte|carte|tarjeta)", "phone": r"(?i)(call|tel|phone|fax|mobile|cell|ruf|appel|llam)",
}
MATCH = "array<struct<s:int,e:int,t:string,before:string,after:string>>"
LABELERS = ["v_check", "v_gazetteer", "v_context", "v_beside"]
SURE, ROUNDS = 0.95, 25
PART = 128


def parts(array: Column) -> Column:
    """An array in parts of ``PART`` elements."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1)), F.lit(PART)), lambda i: F.slice(array, i, F.lit(PART)))


PAIR = "array<struct<t:string,g:string,h:string>>"


def found_texts(text: Column, pattern: str, hint: str) -> Column:
    """The texts that a pattern matches; only texts with its hint are searched."""
    return F.when(text.rlike(hint), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def with_gaps(text: Column, found: Column, pattern: str) -> Column:
    """Matches (t) with the text before (g) and after (h) each."""
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("t"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"), F.slice(gaps, F.lit(2), F.size(found)).alias("h"))
    return F.when(F.size(found) > 0, pairs.cast(PAIR)).otherwise(F.array().cast(PAIR))


def placed(pairs: Column) -> Column:
    """array<struct<s, e, t, before, after>> of matches, in code points.

    Folds copy what they have built at each step, so many matches are placed part by part, after
    a fold over the parts' lengths: a text of n matches takes about n * PART + (n / PART)^2
    steps of copying, not n^2.
    """
    last = lambda acc: F.element_at(acc, -1)

    def step(acc: Column, p: Column) -> Column:
        s = acc["pos"] + F.length(p["g"])
        e = s + F.length(p["t"])
        one = F.struct(s.alias("s"), e.alias("e"), p["t"].alias("t"), F.right(p["g"], F.lit(24)).alias("before"), F.substring(p["h"], 1, 8).alias("after"))
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    def place(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("pos"), F.array().cast(MATCH).alias("out")), step, lambda acc: acc["out"])

    lengths = F.transform(parts(pairs), lambda part: F.aggregate(part, F.lit(0), lambda n, p: n + F.length(p["g"]) + F.length(p["t"])))
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(last(acc) + n)))
    many = F.flatten(F.zip_with(parts(pairs), F.slice(starts, F.lit(1), F.size(lengths)), place))
    return F.when(F.size(pairs) == 0, F.array().cast(MATCH)).when(F.size(pairs) <= PART, place(pairs, F.lit(0))).otherwise(many)


def luhn(digits: Column) -> Column:
    """Whether a text of 1 to 19 digits passes Luhn's test."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n + 1 - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def digits_of(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def valid(kind: str, t: Column) -> Column:
    """The base check of a match."""
    n = F.length(digits_of(t))
    if kind == "ip":
        octet = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return t.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(F.substring(digits_of(t), 1, 19))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def in_list(value: Column, words: str) -> Column:
    return value.isin(words.split())


def votes(kind: str, loose: bool, m: Column) -> list[Column]:
    """The labelers' votes on a match."""
    t, d = m["t"], digits_of(m["t"])
    sign = lambda c: F.when(c, 1).otherwise(-1)
    if kind == "email":
        check = F.lit(0) if loose else sign(F.length(t) <= 254)
        gaz = sign(in_list(F.lower(F.regexp_extract(t, r"([A-Za-z0-9-]+)$", 1)), TLDS))
    elif kind == "ip":
        first = F.regexp_extract(t, r"^0*([0-9]+)", 1)
        check, gaz = sign(valid(kind, t)), sign((F.length(first) <= 3) & ~in_list(first, "0 127 224 239 240 255"))
    elif kind == "card":
        check, gaz = sign(valid(kind, t)), sign(d.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)"))
    else:
        check = F.lit(0) if loose else sign(valid(kind, t))
        gaz = F.lit(0) if loose else sign(in_list(F.substring(d, 1, 1), CALLING_CODES) | in_list(F.substring(d, 1, 2), CALLING_CODES) | in_list(F.substring(d, 1, 3), CALLING_CODES))
    context = F.when(m["before"].rlike(CUES[kind]), 1).otherwise(0)
    beside = F.when(m["before"].rlike(r"[A-Za-z0-9=\"'/_]$") | m["after"].rlike(r"^[A-Za-z0-9\"'/_]"), -1).when(m["before"].rlike(r"(?:^|[\s(:])$") & m["after"].rlike(r"^(?:$|[\s).,;])"), 1).otherwise(0)
    return [check, gaz, context, beside]


def candidate(kind: str, loose: bool, m: Column) -> Column:
    n = F.length(digits_of(m["t"]))
    v = votes(kind, loose, m)
    return F.struct(
        F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e"),
        (F.lit(False) if loose else valid(kind, m["t"])).alias("base"), F.lit(loose).alias("loose"),
        *[x.cast("int").alias(name) for x, name in zip(v, LABELERS)],
        F.least(F.floor(F.length(m["t"]) / 4), F.lit(8)).cast("int").alias("f_length"),
        F.least(n, F.lit(20)).cast("int").alias("f_digits"),
        F.least(F.size(F.array_distinct(F.split(digits_of(m["t"]), ""))), F.lit(8)).cast("int").alias("f_distinct"),
    )


FEATURES = [*LABELERS, "f_length", "f_digits", "f_distinct"]


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, cands): all candidates of each document, of any kind."""
    kinds = [(k, False) for k in KINDS] + [(k, True) for k in LOOSE]
    name = lambda k, loose: f"loose {k}" if loose else k
    pattern = {name(k, loose): (LOOSE if loose else BASE)[k] for k, loose in kinds}
    col = lambda n: F.col(f"`{n}`")
    # step by step, so that no search is made twice
    d = id_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", *[found_texts(F.col("text"), p, HINT[n]).alias(n) for n, p in pattern.items()])
    d = d.select("doc_id", *[with_gaps(F.col("text"), col(n), p).alias(n) for n, p in pattern.items()])
    d = d.select("doc_id", *[placed(col(n)).alias(n) for n in pattern])
    judged = lambda k, loose: F.transform(col(name(k, loose)), lambda m: candidate(k, loose, m))
    return d.select("doc_id", F.concat(*[judged(k, loose) for k, loose in kinds]).alias("cands"))


def reliabilities(counts: list[tuple], rounds: int = ROUNDS) -> tuple[dict, dict]:
    """EM over (kind, votes..., count): the labelers' P(vote | real or not) of each kind, and
    the posterior of each vote pattern. Starts from the majority vote."""
    tables, posterior = {}, {}
    for kind in sorted({c[0] for c in counts}):
        own = [(c[1:-1], c[-1]) for c in counts if c[0] == kind]
        post = {v: 1 / (1 + math.exp(-sum(v))) for v, _ in own}
        for _ in range(rounds):
            total = [sum(n * (post[v] if y else 1 - post[v]) for v, n in own) for y in (0, 1)]
            all_n = total[0] + total[1]
            prior = [(total[y] + 1) / (all_n + 2) for y in (0, 1)]
            prob = [[{x: (sum(n * (post[v] if y else 1 - post[v]) for v, n in own if v[j] == x) + 1) / (total[y] + 3) for x in (-1, 0, 1)} for y in (0, 1)] for j in range(len(LABELERS))]
            for v, _ in own:
                logit = math.log(prior[1] / prior[0]) + sum(math.log(prob[j][1][x] / prob[j][0][x]) for j, x in enumerate(v))
                post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
        tables[kind] = prob
        posterior |= {(kind, *v): p for v, p in post.items()}
    return tables, posterior


def pattern_key(c) -> Column:
    return F.concat_ws("|", c("kind"), *[c(x).cast("string") for x in LABELERS])


def literal_map(d: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv]) if d else F.lit(None).cast("map<string,double>")


def span_classifier(cands: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds of each kind, and of each (kind, feature, value), from the posteriors.

    What reaches the driver are counts by vote pattern and sums by feature value: a few
    hundred rows at most, since every vote and feature has a small fixed range.
    """
    each = cands.select(F.explode("cands").alias("c")).select("c.*")
    counts = [tuple(r) for r in each.groupBy("kind", *LABELERS).count().collect()]
    if not counts:
        return {}, {}
    _, posterior = reliabilities(counts)
    soft = literal_map({"|".join(map(str, k)): p for k, p in posterior.items()})
    scored = each.withColumn("p", soft[pattern_key(F.col)])
    long = scored.select("kind", "p", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("x")) for f in FEATURES])).alias("fx"))
    sums = long.groupBy("kind", "fx.f", "fx.x").agg(F.sum("p").alias("one"), F.sum(1 - F.col("p")).alias("zero")).collect()
    totals = {k: [sum(r["one"] for r in sums if r["kind"] == k and r["f"] == "v_check"), sum(r["zero"] for r in sums if r["kind"] == k and r["f"] == "v_check")] for k in KINDS}
    bias = {k: math.log((a + 1) / (b + 1)) for k, (a, b) in totals.items()}
    weight = {f"{r['kind']}|{r['f']}|{r['x']}": math.log((r["one"] + 1) / (totals[r["kind"]][0] + 10)) - math.log((r["zero"] + 1) / (totals[r["kind"]][1] + 10)) for r in sums}
    return bias, weight


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of struct<kind, s, e>, offsets in code points, end exclusive.

    ``base`` are the matches of the base patterns that pass their checks; ``spans`` are these
    and the looser candidates of which the span classifier is sure and that touch no base span.
    A null or empty text has none. Rows with repeated or null ids are judged each for itself;
    no rows give no rows; other columns are ignored. Texts without any candidate leave nothing
    to learn from: all spans are then the base spans. The looser patterns take names of up to 64
    characters, domains of up to 63 and endings of up to 8, as mail addresses have them. Texts
    are read whole; their candidates are placed in parts, so many of them cost in proportion.
    """
    c = durable(candidates(docs, id_col, text_col), "pii")
    bias, weight = span_classifier(c)
    slim = lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    w, b = literal_map(weight), literal_map(bias)

    def sure(x: Column) -> Column:
        logit = b[x["kind"]]
        for f in FEATURES:
            logit = logit + F.coalesce(w[F.concat_ws("|", x["kind"], F.lit(f), x[f].cast("string"))], F.lit(0.0))
        return logit > math.log(SURE / (1 - SURE))

    base = F.array_sort(F.transform(F.filter("cands", lambda x: x["base"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    if weight:
        meets = lambda x, y: (y["s"] < x["e"]) & (x["s"] < y["e"])
        # of many base spans whole parts are passed over
        spread = F.transform(parts(F.col("base_all")), lambda p: F.struct(F.get(p, F.lit(0))["s"].alias("s"), F.array_max(p["e"]).alias("e"), p.alias("own")))
        more = F.filter("cands", lambda x: x["loose"] & sure(x) & ~F.exists("spread", lambda y: meets(x, y) & F.exists(y["own"], lambda z: meets(x, z))))
        c = c.withColumn("base_all", base).withColumn("spread", F.when(F.size("base_all") > 0, spread).otherwise(F.array().cast("array<struct<s:int,e:int,own:array<struct<s:int,e:int,kind:string>>>>")))
    else:
        more = F.filter("cands", lambda x: F.lit(False))
        c = c.withColumn("base_all", base)
    return c.select("doc_id", F.transform("base_all", slim).alias("base"), F.concat(F.transform("base_all", slim), F.transform(more, slim)).alias("spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each document, from
    ``find_pii``; what it says of nulls, empty and long texts and repeated rows holds."""
    found = find_pii(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[number(k) for k in KINDS], F.sha2(span_digest(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), span_digest(F.col("spans"), KINDS).alias("spans"))
