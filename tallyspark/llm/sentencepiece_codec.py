"""Operator 2: encoding and decoding by unigram Viterbi over a double-array trie of pieces.

Pieces with their log scores come from a public SentencePiece model file, whose path is a
parameter; the driver reads it and sends the trie to the tasks. A text gets a leading space,
spaces become whitespace markers, and the best segmentation maximises the sum of scores. A
character that is no piece of its own becomes its UTF-8 bytes, each a byte piece; so does a
marker character that the text itself holds, so decoding gives back every text exactly.

Where markers stand at the start of pieces only and no longer piece holds a line break (both
are checked), no piece crosses the start of a run of spaces or a line break. Texts are cut
there into units, equal units are encoded once a task (the cache is bounded), and new units go
through the Viterbi search together: position by position, over all of them in numpy.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from .common import col, table, tidy

MODEL_FILE = os.environ.get("TALLYSPARK_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
UNIT = re.compile(f" +[^ \n{MARK}]*|[^ \n{MARK}]+|\n|{MARK}")
UNK_PENALTY = 10.0
LONG_UNIT, CACHED, TOGETHER = 96, 150_000, 8_000
ROWS = 128  # of a batch of ids
UNITS = 150_000  # of texts that are encoded together


class DoubleArray:
    """A trie of byte strings: from state s byte c leads to base[s] + c if check there is s."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for w, value in words.items():
            s = 0
            for c in w:
                if c not in children[s]:
                    children[s][c] = len(children)
                    children.append({})
                    ends.append(-1)
                s = children[s][c]
            ends[s] = value
        size = 1024 + 2 * len(children)
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size + 1024)
        used[:256] = b"\x01" * 256  # so every base is positive
        check[0] = -2
        todo, free, dense = [(0, 0)], 256, 256
        while todo:
            node, at = todo.pop()
            value[at] = ends[node]
            codes = sorted(children[node])
            if not codes:
                continue
            while used[free]:
                free += 1
            if len(codes) == 1:  # fits the first free place that its code can reach
                first = free
                free += 1
            else:  # the search starts beyond what is nearly full
                first = begin = dense
                full = 0
                while used[first] or any(used[first - codes[0] + c] for c in codes):
                    full += used[first]
                    first += 1
                if full >= 0.9 * (first - begin + 1):
                    dense = first
            b = first - codes[0]
            if b + 1024 > size:
                grow = size
                base, check, value = (np.concatenate([x, np.full(grow, f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
                used.extend(bytes(grow))
                size += grow
            base[at] = b
            for c in codes:
                used[b + c] = 1
                check[b + c] = at
                todo.append((children[node][c], b + c))
        self.base, self.check, self.value = base, check, value


class Pieces:
    """The vocabulary: plain arrays, a trie, the bytes of each piece."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """(piece, score, kind) by id; kind: normal, byte or other (control, unknown)."""
        self.scores = np.array([s for _, s, _ in pieces])
        self.byte_ids = np.full(256, -1, np.int32)
        self.texts: list[bytes] = []
        words = {}
        for i, (p, _, kind) in enumerate(pieces):
            self.texts.append(b"")
            if kind == "byte":
                b = int(p[3:5], 16)
                self.byte_ids[b] = i
                self.texts[i] = bytes([b])
            elif kind == "normal":
                if MARK in p.lstrip(MARK) or ("\n" in p and p != "\n"):
                    raise ValueError(f"piece {p!r} crosses a unit's end")
                words[p.encode()] = i
                self.texts[i] = p.replace(MARK, " ").encode()
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        self.trie = DoubleArray(words)
        self.longest = max(map(len, words), default=1)
        normal = [self.scores[i] for i in words.values()] or [0.0]
        self.fallback = float(min(normal)) - UNK_PENALTY  # of each byte

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal"
        return cls([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())])


def spelled(unit: str) -> bytes:
    return unit.replace(" ", MARK).encode()


class Codec:
    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.cache: dict[str, bytes] = {}

    def viterbi(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit, as bytes of int32. Of equal scores the first found stays:
        pieces by start, then by length."""
        p, n = self.p, len(units)
        lens = np.array([len(u) for u in units])
        most = int(lens.max(initial=0))
        text = np.zeros((n, most + p.longest), np.uint8)
        for i, u in enumerate(units):
            text[i, : len(u)] = np.frombuffer(u, np.uint8)
        best = np.full((n, most + 1), -np.inf)
        best[:, 0] = 0
        from_len, from_id = np.zeros((n, most + 1), np.int16), np.full((n, most + 1), -1, np.int32)
        for i in range(most):
            rows = np.flatnonzero((lens > i) & np.isfinite(best[:, i]))
            if not len(rows):
                continue
            lead = text[rows, i]
            size = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            alone = np.zeros(len(rows), bool)
            state, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
            for k in range(p.longest):
                t = p.trie.base[state].astype(np.int64) + text[rows[live], i + k]
                ok = (p.trie.check[t] == state) & (lens[rows[live]] > i + k)
                live, state = live[ok], t[ok]
                if not len(live):
                    break
                ids = p.trie.value[state]
                end = ids >= 0
                if end.any():
                    r, ids, own = rows[live[end]], ids[end], live[end]
                    alone[own] |= size[own] == k + 1
                    score = best[r, i] + p.scores[ids]
                    better = score > best[r, i + k + 1]
                    r = r[better]
                    best[r, i + k + 1] = score[better]
                    from_len[r, i + k + 1] = k + 1
                    from_id[r, i + k + 1] = ids[better]
            r, s = rows[~alone], size[~alone]
            if len(r):
                score = best[r, i] + p.fallback * s
                better = score > best[r, i + s]
                r, s = r[better], s[better]
                best[r, i + s] = score[better]
                from_len[r, i + s] = s
                from_id[r, i + s] = -1
        out = np.zeros((n, most), np.int32)
        at, fill = lens.copy(), np.full(n, most)
        while (live := np.flatnonzero(at > 0)).size:
            ids, step = from_id[live, at[live]], from_len[live, at[live]].astype(np.int64)
            whole = ids >= 0
            r = live[whole]
            fill[r] -= 1
            out[r, fill[r]] = ids[whole]
            for x, s in zip(live[~whole], step[~whole]):
                fill[x] -= s
                out[x, fill[x] : fill[x] + s] = p.byte_ids[text[x, at[x] - s : at[x]]]
            at[live] -= step
        return [out[i, fill[i] :].tobytes() for i in range(n)]

    def viterbi_long(self, unit: bytes) -> bytes:
        """The same for one long unit. Open ends are kept for the length of a piece only, the way
        back as 6 bytes a byte, so memory is in proportion to the unit, at a small rate."""
        p, n = self.p, len(unit)
        base, check, value, scores = p.trie.base, p.trie.check, p.trie.value, p.scores
        ring = max(p.longest, 4) + 1
        best = [float("-inf")] * ring
        from_len, from_id = np.zeros(n + 1, np.int16), np.full(n + 1, -1, np.int32)
        best[0] = 0.0
        for i in range(n):
            own, best[i % ring] = best[i % ring], float("-inf")
            if own == float("-inf"):
                continue
            c = unit[i]
            size = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            state, alone = 0, False
            for j in range(i, min(n, i + p.longest)):
                t = int(base[state]) + unit[j]
                if check[t] != state:
                    break
                state = t
                if (v := int(value[t])) >= 0:
                    alone |= j + 1 - i == size
                    if (s := own + float(scores[v])) > best[(j + 1) % ring]:
                        best[(j + 1) % ring], from_len[j + 1], from_id[j + 1] = s, j + 1 - i, v
            if not alone and (s := own + p.fallback * size) > best[(i + size) % ring]:
                best[(i + size) % ring], from_len[i + size], from_id[i + size] = s, size, -1
        ids, fill, at = np.zeros(n, np.int32), n, n
        while at:
            step, v = int(from_len[at]), from_id[at]
            one = 1 if v >= 0 else step
            ids[fill - one : fill] = v if v >= 0 else p.byte_ids[list(unit[at - step : at])]
            fill, at = fill - one, at - step
        return ids[fill:].tobytes()

    def learn(self, units: list[str]) -> None:
        if len(self.cache) > CACHED:
            self.cache.clear()
        short = []
        for u in units:
            if u == MARK:
                self.cache[u] = self.p.byte_ids[list(MARK.encode())].astype(np.int32).tobytes()
            elif len(raw := spelled(u)) <= LONG_UNIT:
                short.append((len(raw), u, raw))
        short.sort()
        for k in range(0, len(short), TOGETHER):
            part = short[k : k + TOGETHER]
            self.cache.update(zip((u for _, u, _ in part), self.viterbi([raw for _, _, raw in part])))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes of int32; none for a null or empty text."""
        out, group, size = [], [], 0
        for t in [*texts, None]:
            units = UNIT.findall(" " + t) if t else []
            group.append(units)
            size += len(units)
            if size > UNITS or len(group) + len(out) > len(texts):
                new = {u for g in group for u in g}.difference(self.cache)
                if len(self.cache) + len(new) > CACHED:
                    self.cache.clear()
                    new = {u for g in group for u in g}
                self.learn(list(new))
                held = self.cache.get  # of short units
                out += [b"".join([held(u) or self.viterbi_long(spelled(u)) for u in g]) for g in group]
                group, size = [], 0
        return out[: len(texts)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; what is no UTF-8, as ids of other origin may be, is replaced."""
        raw = b"".join([self.p.texts[i] for i in ids.tolist()])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _codec(shared, held: dict = {}) -> Codec:  # noqa: B006
    """One codec and cache for each Python process and model."""
    key = shared.value["key"]
    if key not in held:
        held.clear()
        p = Pieces.__new__(Pieces)
        p.__dict__.update(shared.value["state"])
        trie = DoubleArray.__new__(DoubleArray)
        trie.base, trie.check, trie.value = shared.value["trie"]
        p.trie = trie
        held[key] = Codec(p)
    return held[key]


def share(spark: SparkSession, model_file: str = MODEL_FILE):
    """The vocabulary as a broadcast of plain values: about 3 MB for 32,000 pieces."""
    ship(spark)
    p = Pieces.load(model_file)
    state = {k: v for k, v in vars(p).items() if k != "trie"}
    trie = p.trie.base, p.trie.check, p.trie.value
    key = hashlib.sha256(pickle.dumps((state, trie))).hexdigest()  # a file may change under its path
    return spark.sparkContext.broadcast({"key": key, "state": state, "trie": trie})


def encode(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, text_sha256): one row per input row.

    A null or empty text has no ids and the digest of the empty text. Repeated rows and null
    ids are encoded each; no rows give no rows; other columns are ignored.
    """

    def run(batches):
        codec = _codec(shared)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                texts = part.column(1).to_pylist()
                ids = [np.frombuffer(x, np.int32) for x in codec.encode_batch(texts)]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                digests = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())), pa.array(digests, pa.string())], names=["doc_id", "ids", "text_sha256"])
        codec.cache.clear()  # the process may idle on, or serve other stages

    d = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return d.mapInArrow(tidy(run), "doc_id long, ids array<int>, text_sha256 string")


def decode(encoded: DataFrame, shared) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, text_sha256, text): the texts of ids, and the ids' digest
    (of their little-endian 32-bit form). Null ids decode to the empty text."""

    def run(batches):
        codec = _codec(shared)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                lists, offsets = part.column(1), part.column(1).offsets.to_numpy()
                values = lists.values.to_numpy(zero_copy_only=False)
                ids = [values[a:z].astype(np.int32) for a, z in zip(offsets[:-1], offsets[1:])]
                arrays = [part.column(0), lists, pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]), part.column(2), pa.array([codec.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "n_tokens", "ids_sha256", "text_sha256", "text"])

    return encoded.select("doc_id", "ids", "text_sha256").mapInArrow(tidy(run), "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, text_sha256 string, text string")


def round_trip(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, text_sha256, round_trip): encodes each text, decodes
    its ids and tells whether the text came back; one Python stage, row for row as ``encode``."""

    def run(batches):
        codec = _codec(shared)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                texts = part.column(1).to_pylist()
                ids = [np.frombuffer(x, np.int32) for x in codec.encode_batch(texts)]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                arrays = [
                    part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256((t or "").encode()).hexdigest() for t in texts], pa.string()),
                    pa.array([codec.decode(x) == (t or "") for x, t in zip(ids, texts)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids", "ids_sha256", "text_sha256", "round_trip"])
        codec.cache.clear()

    d = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return d.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, text_sha256 string, round_trip boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document, decodes its ids, and tells whether the text came back."""
    return round_trip(table(spark, sf_dir, "documents"), share(spark)).drop("ids")
