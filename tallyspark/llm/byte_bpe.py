"""Operator 12: byte-level BPE encoding and decoding as a reduction of encoded halves.

The encodings of two neighbours are joined without starting anew. Let the tokens of bytes be
*settled* if merging the bytes by rank, from single bytes and leftmost first, gives them. Tokens
are settled exactly if each two neighbours are, alone: before the first merge across a border
both sides have gone through the same merges as they would with these two tokens alone. So only
a window around the border has to be merged anew, and once its outer tokens are settled with
their neighbours beyond, nothing farther away can change; until then it doubles on the side that
isn't. Joins are associative, so bytes are encoded by halves, down to ``LEAF`` bytes.

Texts are halved as well. A match of the pattern never goes on from a character to white space,
so a text can be cut there into units; where the halves' border is no such place, the unit
around it is encoded anew, if it is long from the matches of its two parts: those that end two
characters before the border stay, the others are matched again until a match ends where one did
before. Equal units are encoded once a task; that cache and the others are bounded.

A null text counts as empty: no ids, empty bytes. Repeated rows, ties and null ids are rows like
any other; no rows give no rows. Other columns are ignored, whatever their names. Texts are whole.
The ranks come from a public file, whose path is a parameter; the driver reads it (some 50,000
tokens, about 1 MB) and broadcasts it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import id_text, slices, table, tidy

RANKS_FILE = os.environ.get("TALLYSPARK_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
LEAF, LEAF_CHARS, LEAF_IDS = 4, 2048, 4096  # what isn't halved any more: bytes, characters, ids
SHORT_UNIT, SHORT_PART = 128, 24  # characters of a unit, bytes of a part that caches keep
UNITS, PARTS, PAIRS = 400_000, 400_000, 400_000  # entries of the caches
SIMPLE = 48  # bytes that are merged without a heap

#: White space is what the pattern calls so; Python's class has the separators 28 to 31 besides.
UNIT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
SPACE = re.compile(r"[^\S\x1c-\x1f]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def library_pattern(pattern: str) -> str:
    """The pattern for ``regex`` with letters and numbers as tiktoken knows them: their versions of
    Unicode differ, so each class is corrected by the characters on which they disagree."""
    import regex
    import tiktoken

    chars = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    one_byte = {bytes([i]): i for i in range(256)}

    def corrected(cls: str) -> str:
        own = set(regex.findall(cls, chars))
        theirs = set(bytes(tiktoken.Encoding("class", pat_str=cls, mergeable_ranks=one_byte, special_tokens={}).encode_ordinary(chars)).decode())
        def spans(found: set[str]) -> str:
            codes = np.array(sorted(map(ord, found)))
            parts = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)
            return "".join(f"\\U{p[0]:08x}-\\U{p[-1]:08x}" for p in parts)

        out = f"[{cls}--[{spans(own - theirs)}]]" if own - theirs else cls
        return f"[{out}||[{spans(theirs - own)}]]" if theirs - own else out

    for cls in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(cls, corrected(cls))
    return "(?V1)" + pattern


class Ranks:
    """Merging by rank, and joining what was merged."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.pairs: dict[int, bool] = {}
        self.parts: dict[bytes, list[int]] = {}

    def merged(self, raw: bytes) -> list[int]:
        """The tokens of the bytes: of the neighbours that make a token those of the lowest rank
        merge first, the leftmost of equal ones."""
        rank = self.ranks.get
        if len(raw) > SIMPLE:
            return self._merged_by_heap(raw)
        tokens = [raw[i : i + 1] for i in range(len(raw))]
        none = 1 << 60
        of = [rank(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while of and (least := min(of)) < none:
            i = of.index(least)
            tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]
            del of[i]
            if i:
                of[i - 1] = rank(tokens[i - 1] + tokens[i], none)
            if i < len(of):
                of[i] = rank(tokens[i] + tokens[i + 1], none)
        return [self.ranks[t] for t in tokens]

    def _merged_by_heap(self, raw: bytes) -> list[int]:
        n, rank = len(raw), self.ranks.get
        end, before = [*range(1, n + 1), 0], [*range(-1, n)]  # end 0: no token begins here any more
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, z = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != z:
                continue
            end[i], end[mid], before[z] = z, 0, i
            if z < n and (r := rank(raw[i : end[z]])) is not None:
                heapq.heappush(heap, (r, i, end[z]))
            if (b := before[i]) >= 0 and (r := rank(raw[b:z])) is not None:
                heapq.heappush(heap, (r, b, z))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def settled(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of the bytes of both, which are settled each."""
        if not left or not right or self.settled(left[-1], right[0]):
            return left + right
        a = b = 1  # tokens of the window
        while True:
            window = self.window(b"".join([self.bytes_of[i] for i in left[-a:] + right[:b]]))
            ends_left = a == len(left) or self.settled(left[-a - 1], window[0])
            ends_right = b == len(right) or self.settled(window[-1], right[b])
            if ends_left and ends_right:
                return left[:-a] + window + right[b:]
            a = a if ends_left else min(2 * a, len(left))
            b = b if ends_right else min(2 * b, len(right))

    def window(self, raw: bytes) -> list[int]:
        """The same as ``merged``; of short bytes from the cache."""
        if (known := self.parts.get(raw)) is None:
            known = self._kept(raw, self.merged(raw))
        return known

    def _kept(self, raw: bytes, ids: list[int]) -> list[int]:
        if len(raw) <= SHORT_PART:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            self.parts[raw] = ids
        return ids

    def encode(self, raw: bytes) -> list[int]:
        """The settled tokens of the bytes, by halves."""
        if (known := self.parts.get(raw)) is not None:
            return known
        if len(raw) <= LEAF:
            return self._kept(raw, self.merged(raw))
        half = len(raw) // 2
        return self._kept(raw, self.join(self.encode(raw[:half]), self.encode(raw[half:])))

    def cut(self, ids: list[int], at: int) -> tuple[list[int], list[int]]:
        """The settled tokens of the first ``at`` bytes, and of the others."""
        k = 0
        while k < len(ids) and at >= len(self.bytes_of[ids[k]]):
            at -= len(self.bytes_of[ids[k]])
            k += 1
        if not at:
            return ids[:k], ids[k:]
        raw = self.bytes_of[ids[k]]
        return self.join(ids[:k], self.merged(raw[:at])), self.join(self.merged(raw[at:]), ids[k + 1 :])


class Codec:
    """Encoding and decoding of texts by ranks and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.by = Ranks(ranks)
        self.pattern = regex.compile(pattern)
        self.units: dict[str, bytes] = {}

    def piece(self, text: str) -> list[int]:
        """A match's ids: one that is a token stays whole."""
        raw = text.encode()
        whole = self.by.ranks.get(raw)
        return self.by.encode(raw) if whole is None else [whole]

    def unit(self, unit: str) -> bytes:
        known = self.units.get(unit)
        if known is None:
            if len(self.units) >= UNITS:
                self.units.clear()
            ids = [i for m in self.pattern.findall(unit) for i in self.piece(m)]
            known = self.units[unit] = struct.pack(f"<{len(ids)}I", *ids)
        return known

    def grown(self, unit: str | list) -> list[tuple[str, list[int]]]:
        """The matches of a unit, with their ids."""
        return [(m, self.piece(m)) for m in self.pattern.findall(unit)] if isinstance(unit, str) else unit

    def join_matches(self, left: list[tuple[str, list[int]]], right: list[tuple[str, list[int]]]) -> list[tuple[str, list[int]]]:
        """The matches of the text of both, from those of each."""
        own: list[tuple[str, list[int]]] = []
        tail = 0
        while left and tail < 2:  # a match is sure if two characters after it are known
            own.insert(0, left.pop())
            tail += len(own[0][0])
        k = 1
        while True:
            near = own + right[:k]
            text = "".join(m for m, _ in near)
            ends = set(np.cumsum([tail, *(len(m) for m, _ in right[:k])]).tolist())
            sure = len(text) - 2 if k < len(right) else len(text)
            found, at = [], 0
            while at < len(text) and not (found and at in ends and at <= sure):
                found.append((at, end := self.pattern.match(text, at).end()))
                at = end
            if at <= sure:
                break
            k = min(2 * k, len(right))
        used = int(np.searchsorted(np.cumsum([tail, *(len(m) for m, _ in right[:k])]), at))
        return left + [(text[a:z], self._between(near, text, a, z)) for a, z in found] + right[used:]

    def _between(self, near: list[tuple[str, list[int]]], text: str, a: int, z: int) -> list[int]:
        """The ids of one match over earlier ones: a long one's by joining what they have."""
        if z - a <= SHORT_UNIT:
            return self.piece(text[a:z])
        out, at = [], 0
        for m, ids in near:
            lo, hi = max(a - at, 0), min(z - at, len(m))
            if lo < hi:
                part = self.by.encode(m.encode()) if len(ids) == 1 else ids
                part = self.by.cut(part, len(m[:hi].encode()))[0] if hi < len(m) else part
                part = self.by.cut(part, len(m[:lo].encode()))[1] if lo else part
                out = self.by.join(out, part)
            at += len(m)
        return out

    def tree(self, text: str, a: int, z: int) -> list[str | list]:
        """The units of ``text[a:z]``, by halves: a short one as it is, a long one as its matches."""
        if z - a <= LEAF_CHARS:
            return [u if len(u) <= SHORT_UNIT else self.grown(u) for u in UNIT.findall(text, a, z)]
        half = (a + z) // 2
        left, right = self.tree(text, a, half), self.tree(text, half, z)
        if SPACE.match(text, half) and not SPACE.match(text, half - 1):
            return left + right
        first, last = right[0], left.pop()
        if isinstance(first, str) and isinstance(last, str) and len(first) + len(last) <= SHORT_UNIT:
            left.append(last + first)
        else:
            left.append(self.join_matches(self.grown(last), self.grown(first)))
        left.extend(right[1:])
        return left

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        return b"".join([self.unit(u) if isinstance(u, str) else b"".join([struct.pack(f"<{len(ids)}I", *ids) for _, ids in u]) for u in self.tree(text, 0, len(text))])

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes of ids, halves concatenated; ids that no token has are an error."""
        return self._decode(np.frombuffer(ids or b"", "<u4"))

    def _decode(self, ids: np.ndarray) -> bytes:
        if len(ids) > LEAF_IDS:
            return self._decode(ids[: len(ids) // 2]) + self._decode(ids[len(ids) // 2 :])
        return b"".join([self.by.bytes_of[i] for i in ids.tolist()])


def _codec(shared, held: dict = {}) -> Codec:  # noqa: B006
    """One codec for each Python process and vocabulary."""
    if (key := shared.value["key"]) not in held:
        held.clear()
        held[key] = Codec(shared.value["ranks"], shared.value["pattern"])
    return held[key]


def share(spark: SparkSession, ranks_file: str = RANKS_FILE, pattern: str | None = None):
    """Ranks and pattern as a broadcast; the pattern is that of the public files unless given."""
    ship(spark)
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    ranks, pattern = read_ranks(ranks_file), library_pattern(pattern)
    return spark.sparkContext.broadcast({"key": hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest(), "ranks": ranks, "pattern": pattern})


def encode(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each text as binary, 4 bytes each, little-endian; a row per row."""

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([codec.encode(t) for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, ids binary")


def decode(encoded: DataFrame, shared) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of each row's ids; null ids give no bytes."""

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([codec.decode(x) for x in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, ids binary, decoded binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document and decodes its ids: their number, and digests of both."""
    shared = share(spark)
    return decode(encode(table(spark, sf_dir, "documents"), shared), shared).select(
        "doc_id", F.expr("coalesce(octet_length(ids), 0) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
