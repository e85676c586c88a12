"""Operator 4: secret scans by assignment-aware lexing.

Three base patterns always count. Beside them a lexer reads assignments of source code and
configuration (``name = "literal"``, ``name: value``, ``"name": "value"``, ``name := value``,
``name => value``) into name-literal pairs. A bare name on the right that was assigned before
stands for its literal (constants propagate, over any number of steps), so in
``a = "x9..."; db_password = a`` the first literal is scored under the last name. The score is
that of the name's words (password, token, ...) times that of the literal (length, variety of
characters, no placeholder); from ``SCORE`` on, the literal's span counts as kind ``secret``.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, over_texts, span_digest, table

#: The base patterns, in the order that breaks ties; letters of ``assign`` in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more: the same spans as runs of which shorter ones are dropped
KINDS = ["assign", "access", "hex", "secret"]
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

LEFT = re.compile(r"""(?<![A-Za-z0-9_.-])([A-Za-z_][A-Za-z0-9_.-]*+)["'`]?[\x20\t]*+(:=|=>|=(?!=)|:(?!:))[\x20\t]*+""")
VALUE = re.compile(r"""("(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`|[^\s"'`,;(){}\[\]<>]+)""")
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
#: What may stand between a name's colon and an equals sign. It ends before the next single colon,
#: so what the names of a line look at doesn't overlap.
TYPE = re.compile(r"""((["'])[\w.\[\],|\x20]++\2[\x20\t]*+|(?:::|[\w.\[\]<>(),|&*?!$'\x20\t])++)(?<![!<])=(?![=>])[\x20\t]*+""")
TYPE_WORDS = re.compile(r"(?:'\w+|\b(?:const|mut|dyn|impl|static|readonly|unsigned|long|keyof|typeof|unique))(?=[\x20\t])")
TWO_WORDS = re.compile(r"[\w\])>?][\x20\t]+[\w(]")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: What a word of a name tells.
WORDS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "pass": 0.8, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.5, "access": 0.4, "key": 0.5, "signing": 0.4, "salt": 0.4,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|undefined|todo|test|example|changeme|change_me|your[_-].*|<.*|\$\{.*|\{\{.*|env\..*|os\..*|process\..*)$")
SCORE = 0.6


def name_score(name: str) -> float:
    """Of a name's words together, at most 1: ``api_key`` and ``accessKey`` add up."""
    words = [w.lower() for w in WORD.findall(name)]
    return min(1.0, sum(WORDS.get(w, 0.0) for w in words) + 0.5 * ("api" in words and "key" in words))


def literal_score(text: str) -> float:
    if len(text) < 6 or PLACEHOLDER.match(text) or any(c.isspace() for c in text):
        return 0.0
    entropy = -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())
    kinds = bool(re.search("[a-z]", text)) + bool(re.search("[A-Z]", text)) + bool(re.search("[0-9]", text)) + bool(re.search("[^A-Za-z0-9]", text))
    return min(1.0, entropy / 3.0) * min(1.0, 0.5 + 0.25 * kinds) if kinds > 1 else 0.0


def after_type(text: str, at: int) -> tuple[int, str] | None:
    """Where the value starts if a type annotation of one line and an equals sign come first, and
    the type."""
    m = TYPE.match(text, at)
    if not m:
        return None
    kind = m[1].strip()
    depth = 0
    for c in kind if not m[2] else "":
        depth += (c in "[<(") - (c in "])>")
        if depth < 0 or (c == "," and not depth):
            return None
    if depth or not kind or (not m[2] and TWO_WORDS.search(TYPE_WORDS.sub("", kind))):
        return None
    return m.end(), kind


def assignments(text: str) -> list[tuple[str, int, int]]:
    """(name, start, end): the names that each literal goes to, constants propagated.

    All names of ``a = b = "literal"`` get the literal, and so does the name before a type
    (``a: type = "literal"``), and the type if it is a single name, as in ``note: pwd = x``.
    A bare ``b=literal`` without spaces on the right may also be a literal as a whole, so
    the name on its left gets all of it.
    """
    known: dict[str, tuple[int, int]] = {}
    out = []

    def give(names: list[str], s: int, e: int) -> None:
        if text[s] in "\"'`":
            s, e = s + 1, e - 1
        elif NAME.fullmatch(text, s, e) and text[s:e] in known:
            s, e = known[text[s:e]]
        for n in names:
            known[n] = (s, e)
            out.append((n, s, e))

    at = 0
    while m := LEFT.search(text, at):
        names: list[tuple[str, int]] = []
        while m:
            names.append((m[1], m.start(1)))
            at = m.end()
            if m[2] == ":" and (typed := after_type(text, at)):
                if NAME.fullmatch(typed[1]):
                    names.append((typed[1], at))
                at = typed[0]
            m = LEFT.match(text, at)
            if m and m[2] == ":" and not after_type(text, m.end()):
                m = None
        first = [n for n, _ in names]
        value = VALUE.match(text, at)
        whole = BARE.match(text, names[1][1]) if len(names) > 1 else None
        if whole and whole.end() >= (value.end() if value else at):  # one run of characters
            give(first[:1], *whole.span())
            first = first[1:]
        if value:
            give(first, *value.span())
            at = value.end()
        elif len(names) > 1:
            last = BARE.match(text, names[-1][1])
            give(first[:-1], *last.span())
    return out


def scan(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans of a text: (kind, start, end, score), base spans with score 1."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span(), 1.0) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        base = [(s, e) for _, s, e, _ in found]
        best: dict[tuple[int, int], float] = {}
        for name, s, e in assignments(text):
            if by_name := name_score(name):
                best[s, e] = max(best.get((s, e), 0.0), by_name * literal_score(text[s:e]))
        found += [("secret", s, e, p) for (s, e), p in best.items() if p >= SCORE and not any(a < e and s < z for a, z in base)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, s, e, score>>), offsets in code points, end exclusive.

    One row per input row. A null or empty text has no spans. A span of kind ``secret`` never
    overlaps a base span. Repeated rows and null ids are scanned each for itself; no rows give
    no rows; other columns are ignored. Every pattern walks a text once, whatever its length.
    """

    def judge(texts):
        return None, [[[dict(zip(("kind", "s", "e", "score"), x)) for x in scan(t)] for t in texts]]

    return over_texts(id_text(docs, id_col, text_col), lambda: judge, "spans array<struct<kind:string,s:int,e:int,score:double>>")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document, from
    ``find_secrets``; what it says of nulls, empty and long texts and repeated rows holds."""
    found = find_secrets(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda x: x["kind"] != "secret"))
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[number(k) for k in KINDS[:3]], F.sha2(span_digest(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), span_digest(F.col("spans"), KINDS).alias("spans"))
