"""Operator 13: alignment of two tokenizers' tokens over the bytes of each text, with corpus counts.

A byte-level BPE (A, of space + text) and a piece BPE (B, which adds the space itself) tokenise
each text in full. Byte offsets where tokens of both end cut them into groups; where bytes of an A
token and a B token overlap, the two are linked. Between two neighbouring ends of either side
exactly one A token overlaps one B token, so links are such intervals and are never searched for.

Shared ends before tokens that begin with a space on both sides are anchors: they are verified
(byte offsets are equal), and no group or link crosses one, so windows of token ids between
anchors are aligned apart. Windows recur, so an alignment is kept by its two tuples of ids; new
ones of a slice of texts are aligned together in numpy.

Corpus counts (in how many documents an id pair is linked) take two passes. The first writes, to
the shared folder, each document's distinct links and, for every block of documents, its distinct
pairs with the number of its documents that hold them: pairs are numbered within the block, which
ends at ``BLOCK_PAIRS`` pairs or ``BLOCK_BYTES`` of links. Counts by pair, and the highest by A
id, are aggregates of the blocks' pairs, join back to them, and meet the documents of a block in
a cogroup, whose sides have these bounds. Texts are tokenised once and never shuffled.

Both tokenizers are public libraries with public files, whose paths are parameters. They get
units of text which no token crosses (a unit ends before a space or line break after anything
but white space; checked on load), each once a task.

Texts that are null, empty, or not given back by both sides' bytes (such as those that hold
U+2581) have no tokens: zeros and an empty string. Repeated rows count each; null ids are rows
like any other; no rows give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import durable
from ..shipping import ship
from .common import id_text, slices, table, tidy

BYTE_FILE = os.environ.get("TALLYSPARK_BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.json")
PIECE_FILE = os.environ.get("TALLYSPARK_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
UNITS, WINDOWS = 250_000, 250_000  # that a task keeps
BLOCK_PAIRS, BLOCK_BYTES = 1 << 19, 32 << 20
CHUNK = 4096  # characters of new units that a library gets at once
FIRST = " ."  # stands before them, so that each begins after a character that is no space

_W, _S, _T = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]", r"[^\S \n\x1c-\x1f]"  # white space, anything else, white space but space and line break
UNIT = re.compile(f"{_W}*{_S}+(?:{_T}{_W}*{_S}+)*(?:{_T}{_W}*)?|{_W}+")


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: printable ones as themselves, the others,
    in order, as the letters from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """Both libraries' tokenizers, the bytes of their tokens, and the units they have met."""

    def __init__(self, byte_json: str, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(byte_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        letters = byte_letters()
        own = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(own.values()) + 1)
        for token, i in own.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        if crossing := [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and (MARK in p.lstrip(MARK) or "\n" in p[1:])]:
            raise ValueError(f"piece {crossing[0]!r} crosses a unit's end")
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_space, self.b_space = (np.array([x.startswith(b" ") for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.age = 0
        self.forget()

    def forget(self) -> None:
        """No units are known any more; their numbers begin anew."""
        self.age += 1
        self.number: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32) for _ in "ab"]  # of all units, one after the other
        self.first, self.count = ([np.zeros(0, np.int64) for _ in "ab"] for _ in range(2))  # of each unit; a unit without ids is one that isn't given back

    def _encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space, which B adds itself."""
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)

    def learn(self, new: list[str]) -> None:
        """The ids of new units: many in one text, those that end in white space alone."""
        texts: list[list[str]] = []
        held = CHUNK
        for u in new:
            if MARK in u:
                self._known([u], [(np.zeros(0, np.int32), np.zeros(1, np.int64))] * 2)
                continue
            alone = u[-1].isspace()  # the separators 28 to 31 too, which does no harm
            if alone or held + len(u) > CHUNK:
                texts.append([])
                held = 0
            texts[-1].append(u)
            held = CHUNK if alone else held + len(u)
        if not texts:
            return
        whole = [FIRST + "".join(units) for units in texts]
        names: list[str] = []
        sides: list[list] = [[], []]
        for text, units, *both in zip(whole, texts, *self._encode(whole)):
            raw = text.encode()
            if any(b"".join([table[i] for i in ids]) != raw for table, ids in zip((self.a_bytes, self.b_bytes), both)):
                if len(units) > 1:
                    for u in units:
                        self.learn([u])
                else:
                    self._known(units, [(np.zeros(0, np.int32), np.zeros(1, np.int64))] * 2)
                continue
            bounds = np.cumsum([len(FIRST), *(len(u.encode()) for u in units)])
            for side, ids, size in zip(sides, both, (self.a_size, self.b_size)):
                ids = np.array(ids, np.int32)
                ends = np.cumsum(size[ids])
                at = np.searchsorted(ends, bounds)
                if (ends[at] != bounds).any():
                    raise ValueError("a token crosses a unit's end")
                side.append((ids[at[0] + 1 :], np.diff(at)))
            names += units
        if names:
            self._known(names, [tuple(np.concatenate(x) for x in zip(*side)) for side in sides])

    def _known(self, units: list[str], sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Adds units with their ids, one after the other, and how many each has, on both sides."""
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units))))
        for s, (ids, count) in enumerate(sides):
            self.first[s] = np.concatenate([self.first[s], len(self.ids[s]) + np.cumsum(count) - count])
            self.count[s] = np.concatenate([self.count[s], count])
            self.ids[s] = np.concatenate([self.ids[s], ids])

    def units(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the units of all texts, and how many each text has; none where there are
        no tokens."""
        units = [UNIT.findall(" " + t) if t else [] for t in texts]
        new = set().union(*units).difference(self.number)
        if len(self.number) + len(new) > UNITS:
            self.forget()
            new = set().union(*units)
        self.learn(list(new))
        per_text = np.array([len(us) for us in units], np.int64)
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(units)), np.int64, per_text.sum())
        text_of = np.repeat(np.arange(len(texts)), per_text)
        lost = np.bincount(text_of, self.count[0][numbers] == 0, len(texts)) > 0
        return numbers[~lost[text_of]], np.where(lost, 0, per_text)

    def encoded(self, numbers: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units on one side, and how many each has."""
        count = self.count[side][numbers]
        return self.ids[side][places(self.first[side][numbers], count)], count


def places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, ``count`` numbers."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Aligner:
    """Windows' alignments by their ids; pairs numbered within a block."""

    def __init__(self, tokens: Tokenizers):
        self.t = tokens
        # how a token is written in its group: the last one of a side ends with the side's mark
        self.written = [b"%d%s" % (i, end) for count, ends in ((len(tokens.a_bytes), (b",", b"|")), (len(tokens.b_bytes), (b",", b";"))) for i in range(count) for end in ends]
        self.width = np.array([len(w) for w in self.written], np.int64)
        self.new_block()

    def new_block(self) -> None:
        self.pairs: dict[int, int] = {}
        self.docs = np.zeros(1 << 12, np.int64)
        self.bytes = 0
        self.forget()

    def forget(self) -> None:
        self.age = -1
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.strings: list[bytes] = []
        self.groups, self.first, self.links = (np.zeros(0, np.int64) for _ in range(3))
        self.count = np.zeros(0, np.int64)

    def windows(self, numbers: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows of texts, from their units: their numbers here, how many each text has, and how
        many tokens each text has on both sides.

        An anchor is a shared end before tokens that begin with a space on both sides. Most windows
        are a unit, whose window is then known by the unit's number; the others, and those of new
        units, are known by their ids.
        """
        (a, units_a), (b, units_b) = (self.t.encoded(numbers, side) for side in (0, 1))
        ends_a, ends_b = np.cumsum(self.t.a_size[a]), np.cumsum(self.t.b_size[b])
        at = np.searchsorted(ends_b, ends_a)
        anchor = ends_b[at] == ends_a  # the last token's end is one on both sides
        anchor[:-1] &= self.t.a_space[a[1:]] & self.t.b_space[b[np.minimum(at[:-1] + 1, len(b) - 1)]]
        upto_a, upto_b = np.cumsum(units_a), np.cumsum(units_b)
        last = np.cumsum(per_text) - 1  # unit of each text
        anchor[upto_a[last] - 1] = True
        end_a = np.flatnonzero(anchor) + 1
        end_b = at[end_a - 1] + 1
        begin_a, begin_b = np.concatenate([[0], end_a[:-1]]), np.concatenate([[0], end_b[:-1]])
        unit = np.searchsorted(upto_a, end_a)
        one = (upto_a[unit] == end_a) & (upto_a[unit] - units_a[unit] == begin_a)
        if self.age != self.t.age:
            self.age, self.of_unit = self.t.age, np.zeros(0, np.int64)
        if len(self.of_unit) < len(self.t.number):
            self.of_unit = np.concatenate([self.of_unit, np.full(2 * len(self.t.number) - len(self.of_unit), -1)])
        found = np.where(one, self.of_unit[numbers[unit]], -1)
        open_ = np.flatnonzero(found < 0)
        if len(open_):
            raw_a, raw_b = a.tobytes(), b.tobytes()
            keys = [(raw_a[s:e], raw_b[u:v]) for s, e, u, v in zip(*((4 * x[open_]).tolist() for x in (begin_a, end_a, begin_b, end_b)))]
            new = set(keys).difference(self.known)
            if len(self.known) + len(new) > WINDOWS:
                self.forget()
                return self.windows(numbers, per_text)
            if new:
                self.align(list(new))
            found[open_] = [self.known[k] for k in keys]
            own = open_[one[open_]]
            self.of_unit[numbers[unit[own]]] = found[own]
        return found, np.diff(np.searchsorted(end_a, upto_a[last]), prepend=-1), np.diff(upto_a[last], prepend=0), np.diff(upto_b[last], prepend=0)

    def align(self, new: list[tuple[bytes, bytes]]) -> None:
        """Groups and links of windows, all together: those of one window never meet another's."""
        a, b = (np.frombuffer(b"".join([w[s] for w in new]), "<i4").astype(np.int64) for s in (0, 1))
        ends_a, ends_b = np.cumsum(self.t.a_size[a]), np.cumsum(self.t.b_size[b])
        last_a = np.cumsum([len(w[0]) // 4 for w in new]) - 1
        window_ends = ends_a[last_a]
        any_end = np.union1d(ends_a, ends_b)
        key = a[np.searchsorted(ends_a, any_end)] << 32 | b[np.searchsorted(ends_b, any_end)]
        distinct, place = np.unique(key, return_inverse=True)
        pairs = self.pairs
        links = np.array([pairs.setdefault(k, len(pairs)) for k in distinct.tolist()], np.int64)[place]
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        code = np.concatenate([2 * a + (shared[group_a] == ends_a), 2 * len(self.t.a_bytes) + 2 * b + (shared[group_b] == ends_b)])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        code = code[order]
        tokens = np.cumsum([(len(x) + len(y)) // 4 for x, y in new])
        cuts = np.cumsum(self.width[code])[tokens - 1].tolist()
        text = b"".join([self.written[c] for c in code.tolist()])
        self.strings += [text[s:e] for s, e in zip([0, *cuts], cuts)]
        upto = np.searchsorted(any_end, window_ends) + 1
        self.first = np.concatenate([self.first, len(self.links) + np.concatenate([[0], upto[:-1]])])
        self.count = np.concatenate([self.count, np.diff(upto, prepend=0)])
        self.links = np.concatenate([self.links, links])
        self.groups = np.concatenate([self.groups, np.diff(np.searchsorted(shared, window_ends), prepend=-1)])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))

    def texts(self, numbers: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], list[bytes]]:
        """Of each text, by its units: numbers of A and B tokens, groups and links, groups as written,
        distinct links packed. Every text has units."""
        import zstandard

        numbers, per_text, n_a, n_b = self.windows(numbers, per_text)
        texts = len(per_text)
        text_of = np.repeat(np.arange(texts), per_text)
        count = self.count[numbers]
        links = self.links[places(self.first[numbers], count)]
        if len(self.docs) < len(self.pairs):
            self.docs = np.concatenate([self.docs, np.zeros(2 * len(self.pairs), np.int64)])
        distinct, times = np.unique(np.repeat(text_of, count) << 32 | links, return_counts=True)
        code = distinct & 0xFFFFFFFF
        self.docs += np.bincount(code, minlength=len(self.docs))
        bounds = np.searchsorted(distinct >> 32, np.arange(texts + 1)).tolist()
        steps = np.diff(code, prepend=0)
        steps[[s for s in bounds[:-1] if s < len(code)]] = code[[s for s in bounds[:-1] if s < len(code)]]
        pack = zstandard.ZstdCompressor(level=1).compress
        packed = [pack(steps[s:e].astype("<u4").tobytes() + times[s:e].astype("<u4").tobytes()) for s, e in zip(bounds[:-1], bounds[1:])]
        self.bytes += sum(map(len, packed))
        at = np.cumsum([0, *per_text]).tolist()
        strings, number = self.strings, numbers.tolist()
        written = [b"".join([strings[n] for n in number[s:e]])[:-1] for s, e in zip(at[:-1], at[1:])]
        return n_a, n_b, np.bincount(text_of, self.groups[numbers], texts).astype(np.int64), np.bincount(text_of, count, texts).astype(np.int64), written, packed

    def block_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code, a, b, docs) of the block's pairs."""
        key = np.fromiter(self.pairs, np.int64, len(self.pairs))
        return np.arange(len(key)), key >> 32, key & 0xFFFFFFFF, self.docs[: len(key)]


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<u4").astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def _tokenizers(shared, held: dict = {}) -> Tokenizers:  # noqa: B006
    if (key := shared.value["key"]) not in held:
        held.clear()
        held[key] = Tokenizers(shared.value["json"], shared.value["model"])
    return held[key]


def share(spark: SparkSession, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE):
    """Both vocabulary files as a broadcast of about 3 MB."""
    ship(spark)
    with open(byte_file, encoding="utf-8") as f, open(piece_file, "rb") as g:
        a, b = f.read(), g.read()
    return spark.sparkContext.broadcast({"key": hashlib.sha256(a.encode() + b).hexdigest(), "json": a, "model": b})


DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, packed binary"
PAIR = "code int, a int, b int, docs long"


def links(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Rows of documents (their columns of ``DOC``; ``groups`` where asked for) and rows of the pairs of
    blocks (``PAIR``), told apart by ``code``, which only pairs have. Each has its block."""
    doc_names, pair_names = ([c.split()[0] for c in x.split(", ")] for x in (DOC, PAIR))
    kinds = dict(zip([*doc_names, *pair_names], [*[pa.int64()] * 5, pa.string(), pa.string(), pa.binary(), *[pa.int32()] * 3, pa.int64()]))

    def batch(block: int, n: int, columns: dict) -> pa.RecordBatch:
        arrays = [pa.array(np.full(n, block)), *(pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items())]
        return pa.RecordBatch.from_arrays(arrays, names=["block", *kinds])

    def run(batches):
        tokens = _tokenizers(shared)
        aligner = Aligner(tokens)
        block = TaskContext.get().partitionId() << 24

        def ended():
            code, a, b, n = aligner.block_pairs()
            for s in range(0, len(code), 20_000):
                e = slice(s, s + 20_000)
                yield batch(block, len(code[e]), {"code": code[e].astype(np.int32), "a": a[e].astype(np.int32), "b": b[e].astype(np.int32), "docs": n[e]})
            aligner.new_block()

        for whole in batches:
            for part in slices(whole, 1):
                numbers, per_text = tokens.units(part.column(1).to_pylist())
                own = np.flatnonzero(per_text)
                n_a, n_b, n_groups, n_links = (np.zeros(part.num_rows, np.int64) for _ in range(4))
                written, digests, packed = [""] * part.num_rows, [""] * part.num_rows, [None] * part.num_rows
                if len(own):
                    n_a[own], n_b[own], n_groups[own], n_links[own], texts, packs = aligner.texts(numbers, per_text[own])
                    for i, t, p in zip(own.tolist(), texts, packs):
                        digests[i], packed[i] = hashlib.sha256(t).hexdigest(), p
                        if with_groups:
                            written[i] = t.decode()
                rows = {"doc_id": part.column(0), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests, "packed": packed}
                yield batch(block, part.num_rows, rows | ({"groups": written} if with_groups else {}))
                if len(aligner.pairs) >= BLOCK_PAIRS or aligner.bytes >= BLOCK_BYTES:
                    yield from ended()
                    block += 1
        yield from ended()
        tokens.forget()  # the process may idle on, or serve other stages

    return id_text(docs, id_col, text_col).mapInArrow(tidy(run), f"block long, {DOC}, {PAIR}")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many documents each id pair is linked, and whether no pair of its A id
    is in more, from the pairs of blocks."""
    n = pairs.groupBy("a", "b").agg(F.sum("docs").alias("n"))
    return n.join(n.groupBy("a").agg(F.max("n").alias("top")), "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def aligned(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups): one row per
    input row; ``groups`` (as ``a1,a2|b1;a3|b2``) is null unless asked for."""
    rows = durable(links(docs, shared, id_col, text_col, with_groups), "links")
    pairs = rows.filter("code IS NOT NULL").select("block", "code", "a", "b", "docs")
    scored = pairs.join(pair_counts(pairs), ["a", "b"]).select(F.col("block").alias("of"), "code", "n", "best")
    own = rows.filter("code IS NULL").select("block", *(c.split()[0] for c in DOC.split(", ")))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        code = right.column("code").to_numpy()
        n, best = np.zeros(int(code.max(initial=-1)) + 1, np.int64), np.zeros(int(code.max(initial=-1)) + 1, np.int64)
        n[code], best[code] = right.column("n").to_numpy(), right.column("best").to_numpy()
        sums, bests = [], []
        for packed in left.column("packed").to_pylist():
            at, times = _unpacked(packed) if packed else (code[:0], code[:0])
            sums.append(int((n[at] * times).sum()))
            bests.append(int((best[at] * times).sum()))
        made = left.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))
        return made.select(names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    return own.groupBy("block").cogroup(scored.groupBy("of")).applyInArrow(score, schema)


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligns both tokenizers' tokens in every document: groups, links, and the corpus counts of the
    linked id pairs. Null and empty texts: zeros and an empty string."""
    return aligned(table(spark, sf_dir, "documents"), share(spark)).drop("groups")
