"""SentencePiece encoding with seeded merge-dropout, and decoding.

A merge-type (BPE) model is applied by its agenda: of all neighbouring symbols whose
concatenation is a piece, the pair of the best score, leftmost on ties, is merged, until
none is left. With dropout, a candidate taken from the agenda is skipped with probability
``dropout``; what was skipped comes back after the next merge, and a unit is done once all
its candidates are skipped in a row. Whether one is skipped is a keyed hash of the seed, the
document, the unit's text and its place in the document, the number of merges made and the
position: no random state, so reruns agree on any cluster, and every occurrence of a unit
(spaces and the word after them; no piece has a space after another character, or a line feed
or tab at all) draws its own skips. The model's own segmentation of a unit and the candidates
that it takes are computed once and remembered; an occurrence that skips none of those
candidates has that segmentation, and only the others go through the agenda again.

Units of up to ``LONG`` symbols go through the agenda side by side in numpy; longer ones go
one by one through a heap, by the same rule and with the same result.

Decoding restores the text exactly: characters without a piece become byte pieces, and so
do literal U+2581 characters, which decoding would otherwise turn into spaces.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import prepare
from .text import U64, buffers, byte_lengths, characters, mix, pieces, ragged

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 2024
#: Symbols of the longest unit that numpy handles; units that a worker remembers.
LONG, REMEMBERED = 48, 1_500_000
_NONE = np.int64(1) << 40


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """The fields of one protobuf message: (number, wire type, value)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, kind, value


@dataclass
class Model:
    """The pieces of a merge-type model: their texts, their merges by pair, and bytes."""

    texts: list[bytes]
    byte_id: np.ndarray
    char_id: dict[int, int]
    pair: np.ndarray  # left << 32 | right, ascending
    merged: np.ndarray
    rank: np.ndarray  # 0 merges first
    low: np.ndarray = field(default=None)  # ids of the first 65,536 code points, -1: none
    starts: np.ndarray = field(default=None)
    sizes: np.ndarray = field(default=None)
    data: np.ndarray = field(default=None)
    slots: np.ndarray = field(default=None)

    def __post_init__(self):
        self.low = np.full(1 << 16, -1, np.int64)
        for c, i in self.char_id.items():
            if c < 1 << 16:
                self.low[c] = i
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        # an open-addressed table of the pairs, at most a quarter full
        bits = int(np.ceil(np.log2(4 * len(self.pair))))
        self.slots = np.full(1 << bits, -1, np.int64)
        left = np.arange(len(self.pair))
        at = self._slot(self.pair)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several, the last stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (mix(pairs.astype(U64)) & U64(len(self.slots) - 1)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The index of each pair's merge, -1 where there is none."""
        pairs = (left << 32) | right
        at = self._slot(pairs)
        out = np.full(len(pairs), -1, np.int64)
        open_ = np.arange(len(pairs))
        while len(open_):
            index = self.slots[at]
            hit = index >= 0
            open_, at, index = open_[hit], at[hit], index[hit]
            same = self.pair[index] == pairs[open_]
            out[open_[same]] = index[same]
            open_, at = open_[~same], (at[~same] + 1) & (len(self.slots) - 1)
        return out


@lru_cache(maxsize=4)
def load(raw: bytes) -> Model:
    """The model in the bytes of its file."""
    found, normalizer, trainer = [], {}, {}
    for number, _, value in _fields(raw):
        if number == 1:
            piece = dict((n, v) for n, _, v in _fields(value))
            found.append((piece[1], float(np.frombuffer(piece.get(2, bytes(4)), np.float32)[0]), piece.get(3, 1)))
        elif number == 2:
            trainer = dict((n, v) for n, _, v in _fields(value))
        elif number == 3:
            normalizer = dict((n, v) for n, _, v in _fields(value))
    if trainer.get(3) != 2 or normalizer.get(2) or not trainer.get(35):
        raise ValueError("a merge-type model with byte fallback and no normalisation is needed")
    normal = {p: (i, s) for i, (p, s, kind) in enumerate(found) if kind == 1}
    byte_id = np.zeros(256, np.int64)
    texts = []
    for i, (p, _, kind) in enumerate(found):
        if kind == 6:
            byte_id[int(p[3:5], 16)] = i
            texts.append(bytes([int(p[3:5], 16)]))
        else:
            texts.append(p.replace("▁".encode(), b" ") if kind == 1 else b"")
    char_id = {ord(c): i for p, (i, _) in normal.items() if len(c := p.decode()) == 1}
    merges = []
    for p, (i, s) in normal.items():
        chars = p.decode()
        if any("▁" == c for c in chars.lstrip("▁")) or any(c in "\t\n" for c in chars):
            raise ValueError("a piece crosses the bounds of units")
        for k in range(1, len(chars)):
            a, b = normal.get(chars[:k].encode()), normal.get(chars[k:].encode())
            if a and b:
                merges.append(((a[0] << 32) | b[0], i, s))
    merges.sort()
    scores = np.array([m[2] for m in merges])
    _, rank = np.unique(-scores, return_inverse=True)
    return Model(texts, byte_id, char_id, np.array([m[0] for m in merges], np.int64), np.array([m[1] for m in merges], np.int64), rank.astype(np.int64))


def _turn(made, position) -> np.ndarray:
    """64 bits for the candidate at ``position`` after ``made`` merges."""
    with np.errstate(over="ignore"):
        return mix(np.asarray(made, U64) * U64(0x9E3779B97F4A7C55) + np.asarray(position, U64) * U64(0xC2B2AE3D27D4EB4F) + U64(1))


def _drawn(key, turn, dropout: float):
    """Whether the candidate of ``turn`` is skipped in the unit of ``key``."""
    with np.errstate(over="ignore"):
        x = mix(np.asarray(key, U64) ^ turn)
    return (x >> U64(11)).astype(np.float64) * 2.0**-53 < dropout


def _skipped(key, made, position, dropout: float):
    return _drawn(key, _turn(made, position), dropout)


def segment_one(symbols: list[int], key: int, model: Model, dropout: float, taken: list[int] | None = None) -> list[int]:
    """The agenda with a heap, for a unit of any length; adds the merged positions to ``taken``."""
    n = len(symbols)
    ids, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    alive, made = [True] * n, 0
    heap: list[tuple[int, int, int, int, int]] = []

    def push(lefts: list[int]) -> None:
        lefts = [i for i in lefts if i >= 0 and after[i] < n]
        if lefts:
            at = model.find(np.array([ids[i] for i in lefts], np.int64), np.array([ids[after[i]] for i in lefts], np.int64))
            for i, m in zip(lefts, at.tolist(), strict=True):
                if m >= 0:
                    heapq.heappush(heap, (int(model.rank[m]), i, ids[i], ids[after[i]], m))

    push(list(range(n - 1)))
    held: list[tuple] = []
    while heap:
        item = heapq.heappop(heap)
        _, i, a, b, m = item
        if not alive[i] or ids[i] != a or after[i] >= n or ids[after[i]] != b:
            continue
        if dropout and bool(_skipped(key, made, i, dropout)):
            held.append(item)
            continue
        if taken is not None:
            taken.append(i)
        j = after[i]
        ids[i], alive[j], after[i] = int(model.merged[m]), False, after[j]
        if after[j] < n:
            before[after[j]] = i
        made += 1
        for x in held:
            heapq.heappush(heap, x)
        held = []
        push([before[i], i])
    return [ids[i] for i in range(n) if alive[i]]


def _segment_block(symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray, model: Model, dropout: float, taken: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The agenda of many units at once: a row of padded symbols each; returns rows and sizes.

    ``taken`` gets the rows and the merged positions of every round. A symbol keeps the position of its first character, which is what the hash reads.
    """
    n, width = symbols.shape
    ids = symbols.copy()
    place = np.broadcast_to(np.arange(width), ids.shape).copy()
    sizes = sizes.copy()
    merge = np.full((n, max(1, width - 1)), -1, np.int64)
    inside = np.arange(width - 1)[None, :] < sizes[:, None] - 1 if width > 1 else np.zeros((n, 1), bool)
    r, c = np.nonzero(inside)
    merge[r, c] = model.find(ids[r, c], ids[r, c + 1])
    made = np.zeros(n, np.int64)
    live = np.flatnonzero((merge >= 0).any(1))
    while len(live):
        now = merge[live]
        r, c = np.nonzero(now >= 0)
        rank = np.full(now.shape, _NONE)
        value = model.rank[now[r, c]]
        if dropout:
            skip = _skipped(keys[live][r], made[live][r], place[live[r], c], dropout)
            r, c, value = r[~skip], c[~skip], value[~skip]
        rank[r, c] = value
        best = rank.argmin(1)
        some = rank[np.arange(len(live)), best] < _NONE
        live, best = live[some], best[some]
        if not len(live):
            break
        if taken is not None:
            taken.append((live, place[live, best]))
        ids[live, best] = model.merged[merge[live, best]]
        made[live] += 1
        # close the gap behind the merged pair
        span = np.arange(width)[None, :]
        source = np.minimum(span + (span > best[:, None]), width - 1)
        rows = np.arange(len(live))[:, None]
        ids[live] = ids[live][rows, source]
        place[live] = place[live][rows, source]
        merge[live] = merge[live][rows, np.minimum(source[:, : merge.shape[1]], merge.shape[1] - 1)]
        sizes[live] -= 1
        for shift in (-1, 0):
            at = best + shift
            ok = (at >= 0) & (at < sizes[live] - 1)
            merge[live[ok], at[ok]] = model.find(ids[live[ok], at[ok]], ids[live[ok], at[ok] + 1])
            gone = (at >= 0) & (at < merge.shape[1]) & ~ok
            merge[live[gone], at[gone]] = -1
        tail = np.arange(merge.shape[1])[None, :] >= sizes[live][:, None] - 1
        merge[live] = np.where(tail, -1, merge[live])
        live = live[(merge[live] >= 0).any(1)]
    return ids, sizes


class Encoder:
    """Encodes columns of texts; remembers the model's own segmentation of units it has seen."""

    def __init__(self, model: Model, dropout: float, seed: int, remembered: int = REMEMBERED):
        self.model, self.dropout, self.seed, self.remembered = model, dropout, U64(seed), remembered
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size, self.flat = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.turn_at, self.turn_size, self.turns = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)

    def units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, first symbol of each unit, hash of each unit, first unit of each text)."""
        offsets, data = buffers(column)
        n = len(offsets) - 1
        some = np.diff(offsets) > 0
        # a space before each text that is not empty, as the model was trained
        lead = np.cumsum(some)
        spread = np.full(len(data) + int(some.sum()), 0x20, np.uint8)
        spread[np.arange(len(data)) + np.repeat(lead, np.diff(offsets))] = data
        offsets = offsets + np.concatenate([[0], lead])
        begins, points = characters(offsets, spread)
        points = points.astype(np.int64)
        length = byte_lengths(points)
        space, control = points == 0x20, (points == 0x0A) | (points == 0x09)
        new = np.ones(len(points), bool)
        new[1:] = (space[1:] & ~space[:-1]) | control[1:] | control[:-1]
        new[begins[:-1][some]] = True
        first = np.flatnonzero(new)
        points = np.where((points >= 0xDC80) & (points < 0xDD00), -1, points)
        points = np.where(space, 0x2581, np.where(points == 0x2581, -1, points))
        symbol = np.where((points >= 0) & (points < 1 << 16), self.model.low[np.clip(points, 0, (1 << 16) - 1)], -1)
        for i in np.flatnonzero(points >= 1 << 16):
            symbol[i] = self.model.char_id.get(int(points[i]), -1)
        missing = symbol < 0
        if missing.any():  # as many symbols as the character has bytes
            byte_at = np.cumsum(length) - length
            sizes = np.where(missing, length, 1)
            out = np.repeat(symbol, sizes)
            out[out < 0] = self.model.byte_id[spread[ragged(byte_at[missing], length[missing])]]
            place = np.concatenate([[0], np.cumsum(sizes)])
            symbol, first = out, place[first]
            starts = np.searchsorted(first, place[begins])
        else:
            starts = np.searchsorted(first, begins)
        power = np.full(len(symbol) + 1, U64(0x9E3779B97F4A7C55))
        power[0] = 1
        power = np.multiply.accumulate(power)
        inverse = np.full(len(symbol) + 1, U64(pow(0x9E3779B97F4A7C55, -1, 1 << 64)))
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        total = np.zeros(len(symbol) + 1, U64)
        np.cumsum(mix((symbol + 1).astype(U64)) * power[:-1], out=total[1:])
        ends = np.append(first[1:], len(symbol))
        hashes = mix((total[ends] - total[first]) * inverse[first]) if len(first) else np.zeros(0, U64)
        return symbol, first, hashes, starts if n else np.zeros(1, np.int64)

    def segment(self, symbol: np.ndarray, first: np.ndarray, size: np.ndarray, keys: np.ndarray, dropout: float, taken: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each unit's pieces start, how many, all pieces); ``taken`` gets (units, merges made, positions)."""
        sizes, at = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        order, parts = [], []
        low = 0
        for width in (4, 8, 12, 16, 24, 32, LONG):
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            for begin in range(0, len(rows), 20_000):
                some = rows[begin : begin + 20_000]
                block = np.zeros((len(some), width), np.int64)
                span = np.arange(width)[None, :] < size[some][:, None]
                block[span] = symbol[ragged(first[some], size[some])]
                rounds = None if taken is None else []
                ids, left = _segment_block(block, size[some], keys[some], self.model, dropout, rounds)
                sizes[some] = left
                order.append(some)
                parts.append(ids[np.arange(width)[None, :] < left[:, None]].astype(np.int32))
                if rounds:
                    taken.extend((some[live], np.full(len(live), made), place) for made, (live, place) in enumerate(rounds))
        for i in np.flatnonzero(size > LONG):
            places = None if taken is None else []
            ids = segment_one(symbol[first[i] : first[i] + size[i]].tolist(), int(keys[i]), self.model, dropout, places)
            sizes[i] = len(ids)
            order.append(np.array([i]))
            parts.append(np.array(ids, np.int32))
            if places:
                taken.append((np.full(len(places), i), np.arange(len(places)), np.array(places)))
        rows = np.concatenate(order) if order else np.zeros(0, np.int64)
        at[rows] = np.cumsum(sizes[rows]) - sizes[rows]
        return at, sizes, np.concatenate([np.zeros(0, np.int32), *parts])

    def learn(self, symbol: np.ndarray, first: np.ndarray, size: np.ndarray, keys: np.ndarray) -> None:
        """Segment units of new, ascending keys without dropout and remember them and what they merged."""
        taken: list = []
        at, sizes, flat = self.segment(symbol, first, size, keys, 0.0, taken if self.dropout else None)
        unit, made, place = (np.concatenate([np.zeros(0, np.int64), *(t[j] for t in taken)]) for j in range(3))
        turn_size = np.bincount(unit, minlength=len(keys)).astype(np.int64)
        turn_at = np.cumsum(turn_size) - turn_size + len(self.turns)
        self.turns = np.concatenate([self.turns, _turn(made, place)[np.argsort(unit, kind="stable")]])
        at += len(self.flat)
        self.flat = np.concatenate([self.flat, flat])
        where = np.searchsorted(self.keys, keys)
        old = (self.keys, self.at, self.size, self.turn_at, self.turn_size)
        self.keys, self.at, self.size, self.turn_at, self.turn_size = (np.insert(o, where, n) for o, n in zip(old, (keys, at, sizes, turn_at, turn_size), strict=True))

    def encode(self, column: pa.Array, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a column of texts; ``salts`` tell the texts apart."""
        symbol, first, hashes, starts = self.units(column)
        counts = np.diff(starts)
        size = np.diff(np.append(first, len(symbol)))
        wanted, example, back = np.unique(hashes, return_index=True, return_inverse=True)
        for attempt in range(2):
            at = np.searchsorted(self.keys, wanted)
            known = np.zeros(len(wanted), bool)
            inside = at < len(self.keys)
            known[inside] = self.keys[at[inside]] == wanted[inside]
            if known.all():
                break
            new = np.flatnonzero(~known)
            if attempt == 0 and len(self.keys) + len(new) > self.remembered:
                self.forget()
                new = np.arange(len(wanted))
            self.learn(symbol, first[example[new]], size[example[new]], wanted[new])
        at = np.searchsorted(self.keys, wanted)[back]
        begins, sizes, flat = self.at[at], self.size[at], self.flat
        if self.dropout:
            row = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(first)) - np.repeat(starts[:-1], counts)
            keys = mix(hashes + mix(mix(salts.astype(np.int64).view(U64)[row] ^ self.seed) + place.astype(U64)))
            turns = self.turn_size[at]
            drawn = _drawn(np.repeat(keys, turns), self.turns[ragged(self.turn_at[at], turns)], self.dropout)
            other = np.flatnonzero(np.bincount(np.repeat(np.arange(len(at)), turns)[drawn], minlength=len(at)))
            own, sizes[other], pieces_ = self.segment(symbol, first[other], size[other], keys[other], self.dropout)
            begins[other] = own + len(flat)
            flat = np.concatenate([flat, pieces_])
        return np.concatenate([[0], np.cumsum(sizes)])[starts], flat[ragged(begins, sizes)]


def decode(offsets: np.ndarray, ids: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the texts of rows of ids, without the leading space."""
    sizes = model.sizes[ids]
    data = model.data[ragged(model.starts[ids], sizes)]
    bounds = np.concatenate([[0], np.cumsum(sizes)])[offsets]
    some = np.diff(bounds) > 0
    keep = np.ones(len(data), bool)
    keep[bounds[:-1][some]] = False
    return bounds - np.concatenate([[0], np.cumsum(some)]), data[keep]


_ENCODERS: dict[tuple, Encoder] = {}


def _encode(raw: bytes, dropout: float, seed: int, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = (hash(raw), dropout, seed)
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(load(raw), dropout, seed)
        encoder = _ENCODERS[name]
        for batch in pieces(batches, limit=1 << 20):
            offsets, ids = encoder.encode(batch.column(0), batch.column(1).fill_null(-1).to_numpy())
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            if not check:
                yield pa.RecordBatch.from_arrays([column, batch.column(2)], ["ids", "row"])
                continue
            bounds, data = decode(offsets, ids.astype(np.int64), encoder.model)
            (own, text), back = buffers(batch.column(0)), data.tobytes()
            text = text.tobytes()
            restored = [back[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            same = [r == text[a:b] for r, a, b in zip(restored, own[:-1].tolist(), own[1:].tolist(), strict=True)]
            digests = [hashlib.sha256(r).hexdigest() for r in restored]
            yield pa.RecordBatch.from_arrays([column, pa.array(digests), pa.array(same), batch.column(2)], ["ids", "decoded_sha256", "lossless", "row"])

    return run


def _decode(raw: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(raw)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                sizes = np.asarray(part.column(0).value_lengths().fill_null(0), np.int64)
                offsets, data = decode(np.concatenate([[0], np.cumsum(sizes)]), part.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64), model)
                text = pa.Array.from_buffers(pa.string(), part.num_rows, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([text, part.column(1)], ["text", "row"])

    return run


def encode_texts(docs: DataFrame, model_file: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, check: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """ids, the pieces of every whole text, and row, a struct of the other columns of ``docs``.

    Null and empty texts have no pieces. A text's segmentation depends on the seed and its
    doc_id, so equal texts under one doc_id are alike. ``dropout`` 0 gives the model's own
    segmentation. With ``check`` the ids are decoded again, which adds decoded_sha256, of
    the restored text, and lossless, whether it equals the input (null as empty) byte for
    byte. The model file is read on the driver and sent with the tasks.
    """
    prepare(docs.sparkSession)
    with open(model_file, "rb") as file:
        raw = file.read()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_column])
    rows = docs.select(F.col(f"`{text_column}`").cast("string").alias("text"), F.col(f"`{id_column}`").cast("long").alias("salt"), row.alias("row"))
    checks = [T.StructField("decoded_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())]
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), *checks[: 2 * check], rows.schema["row"]])
    return rows.mapInArrow(_encode(raw, dropout, seed, check), schema)


def decode_texts(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """text, restored from the column ids, and row, a struct of all columns of ``encoded``."""
    prepare(encoded.sparkSession)
    with open(model_file, "rb") as file:
        raw = file.read()
    rows = encoded.select("ids", F.struct(*encoded.columns).alias("row"))
    return rows.mapInArrow(_decode(raw), T.StructType([T.StructField("text", T.StringType()), rows.schema["row"]]))


def encoded_and_checked(docs: DataFrame) -> DataFrame:
    """doc_id, ids, n_ids, decoded_sha256 and lossless for every row of ``docs``."""
    out = encode_texts(docs.select("doc_id", "text"), check=True)
    return out.select("row.doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "decoded_sha256", "lossless")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table encoded with merge-dropout, and decoded again."""
    return encoded_and_checked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
