"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from the model file and composed with each input as it is read:

* the normaliser: a space marker before a text and in place of each space (identity maps only);
* the pieces: a trie from characters, last one first, to pieces;
* byte fallback: a character that is no piece becomes the pieces of its UTF-8 bytes.

The encoding is the shortest path in the tropical semiring. In a unigram model an arc weighs minus the piece's score. A BPE
model has no such weights: its merge order decides. There a state also knows the last piece, and an arc weighs nothing
where merging the two pieces' characters leaves exactly these two, and infinity elsewhere. A sequence whose neighbours are
all of this kind is what merging gives, so exactly one path of weight 0 is left, the one that the model means, and one
state per position is enough.

No piece runs across the start of a marked word or a line end, nor (where the model's pieces show it) across the end of a
run of letters, so texts are cut there, and the paths of frequent segments are remembered (a bounded number).

Defined results: null gives null ids, an empty text no ids; every other text, however long, is encoded whole and decodes
to itself (but for U+2581, the marker, which decodes to a space, as the format has it); repeated rows are alike. Extra
columns stay as they are.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rapport.llm.shared import col, frugal, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Segments whose paths a worker remembers, and bytes of texts (one at least) that it takes at once.
REMEMBERED, PAIRS, AT_ONCE, SEGMENTS = 400_000, 500_000, 1 << 20, 1 << 16
INFINITE = float("inf")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
#: Cuts before a marked word and around line ends, and (finer) also behind a run of letters.
_COARSE = re.compile(r" *[^ \n]+| +|\n")
_FINE = re.compile(r" *(?:[^\w \n]|[\d_])*[^\W\d_]+| *(?:[^\w \n]|[\d_])+| +|\n")
_LETTER = re.compile(r"[^\W\d_]")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at:at + size]
            at += size


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    bpe: bool
    prefix: bool


def read_model(data: bytes) -> Model:
    """The parts of a model file that encoding needs. Raises where the model asks for what is not built."""
    pieces, scores, kinds, bpe, prefix = [], [], [], False, True
    for number, value in _fields(data):
        if number == 1:
            part = dict(_fields(value))
            pieces.append(part[1].decode())
            scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
            kinds.append(part.get(3, _NORMAL))
        elif number == 2:
            spec = dict(_fields(value))
            kind = spec.get(3, 1)
            if kind not in (1, 2) or spec.get(24):
                raise ValueError("only unigram and BPE models with the marker in front are supported")
            bpe = kind == 2
        elif number == 3:
            spec = dict(_fields(value))
            if spec.get(2) or spec.get(4, 1):
                raise ValueError("only the identity normaliser that keeps all spaces is supported")
            prefix = bool(spec.get(3, 1))
    return Model(pieces, scores, kinds, bpe, prefix)


class Transducer:
    """The composed machine. ``encode`` takes one segment; ``ids_of`` and ``bytes_of`` take many texts."""

    def __init__(self, model: Model):
        self.model, self.size = model, len(model.pieces)
        self.trie: list = [{}, None]       # a node: its children, and the piece that ends here
        self.byte = [0] * 256
        self.known: dict[str, int] = {}
        raw = []
        for i, (piece, kind) in enumerate(zip(model.pieces, model.kinds)):
            if kind in (_NORMAL, _USER, _UNUSED):
                self.known[piece] = i
                node = self.trie
                for ch in reversed(piece):
                    node = node[0].setdefault(ch, [{}, None])
                node[1] = i
            if kind == _BYTE:
                self.byte[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]) if kind == _BYTE else b"" if kind == _CONTROL
                       else " ⁇ ".encode() if kind == _UNKNOWN else piece.replace(MARK, " ").encode())
        self.raw_size = np.array([len(b) for b in raw])
        self.raw_head = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.weight = [0.0] * self.size if model.bpe else [-s for s in model.scores]
        self.fallback = 10.0 - min(model.scores)
        self.legal: dict[int, bool] = {}          # whether a piece may follow another; at most PAIRS, give or take a slice
        across = {a for piece in self.known for a, b in zip(piece, piece[1:]) if _LETTER.match(a) and not _LETTER.match(b)}
        odd = "".join(map(re.escape, sorted(a for a in across if not a.isalpha())))
        self.segment = _COARSE if any(a.isalpha() for a in across) else _FINE
        self.odd = re.compile(f"[{odd}]") if odd else None     # texts with these are cut coarsely
        self.forget()

    def forget(self) -> None:
        """Drop what was remembered; bounds what a worker keeps, within a partition and after it."""
        self.legal.clear()
        self.seen: dict[str, int] = {}
        self.bound = np.zeros(1 << 16, np.int64)        # where each remembered path begins in ``flat``, and the last ends
        self.flat = np.zeros(1 << 18, np.int32)

    def remember(self, paths: list[list[int]], known: int) -> None:
        """Lay down the paths of new segments behind the first ``known`` ones."""
        size = np.fromiter(map(len, paths), np.int64, len(paths))
        start = int(self.bound[known])
        ends = start + np.cumsum(size)
        while known + len(paths) >= len(self.bound):
            self.bound = np.concatenate([self.bound, np.zeros_like(self.bound)])
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.bound[known + 1:known + 1 + len(paths)] = ends
        self.flat[start:ends[-1]] = np.fromiter((piece for path in paths for piece in path), np.int32, int(size.sum()))

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: join the neighbours with the best piece, leftmost first, to the end."""
        parts = list(text)
        known, scores = self.known, self.model.scores
        while True:
            best, at = -INFINITE, -1
            for i in range(len(parts) - 1):
                piece = known.get(parts[i] + parts[i + 1])
                if piece is not None and scores[piece] > best:
                    best, at = scores[piece], i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, last: int, piece: int) -> bool:
        """Whether ``piece`` may come after ``last`` (-1: after nothing it could merge with)."""
        key = (last + 1) * self.size + piece
        found = self.legal.get(key)
        if found is None:
            own = self.model.pieces
            left = [own[last]] if last >= 0 else []
            found = self.merged("".join(left) + own[piece]) == [*left, own[piece]]
            self.legal[key] = found
        return found

    def encode(self, segment: str) -> list[int]:
        """Shortest path through the composition with one segment (spaces already marked)."""
        return (self._merge_paths if self.model.bpe else self._light_paths)([segment])[0]

    def _light_paths(self, segments: list[str]) -> list[list[int]]:
        """Paths of least weight, for models whose pieces have weights."""
        out, weight = [], self.weight
        for segment in segments:
            n = len(segment)
            cost, last, back = [0.0] + [INFINITE] * n, [-1] * (n + 1), [0] * (n + 1)
            for j in range(1, n + 1):
                node, i = self.trie, j
                while i:
                    i -= 1
                    node = node[0].get(segment[i])
                    if node is None:
                        break
                    piece = node[1]
                    if piece is not None and cost[i] + weight[piece] < cost[j]:
                        cost[j], last[j], back[j] = cost[i] + weight[piece], piece, i
                if segment[j - 1] not in self.known and cost[j - 1] + self.fallback < cost[j]:
                    cost[j], last[j], back[j] = cost[j - 1] + self.fallback, -1, j - 1
            out.append(self._path(segment, last, back))
        return out

    def _merge_paths(self, segments: list[str]) -> list[list[int]]:
        """Paths of weight 0: a position is reached by the one piece that may follow there. What a position is reached by
        depends on what lies before it only, so segments in order share the states of their common beginnings."""
        out, size, trie, legal, follows = [], self.size, self.trie, self.legal, self.follows
        before, last, back = "", [-1], [0]
        for segment in segments:
            k = 0
            for x, y in zip(segment, before):
                if x != y:
                    break
                k += 1
            del last[k + 1:], back[k + 1:]
            before = segment
            for j in range(k + 1, len(segment) + 1):
                node, i = trie, j
                while i:
                    i -= 1
                    node = node[0].get(segment[i])
                    if node is None:
                        i = -1
                        break
                    piece = node[1]
                    if piece is not None:
                        ok = legal.get((last[i] + 1) * size + piece)
                        if follows(last[i], piece) if ok is None else ok:
                            break
                else:
                    i = -1
                last.append(piece if i >= 0 else -1)
                back.append(i if i >= 0 else j - 1)          # no piece: bytes
            out.append(self._path(segment, last, back))
        return out

    def _path(self, segment: str, last: list[int], back: list[int]) -> list[int]:
        path = []
        at = len(segment)
        while at:
            piece = last[at]
            path.append([piece] if piece >= 0 else [self.byte[b] for b in segment[at - 1].encode()])
            at = back[at]
        return [piece for part in reversed(path) for piece in part]

    def remembered(self, segments: list[str]) -> np.ndarray:
        """Index of each segment's path in the remembered ones."""
        seen = self.seen
        codes = list(map(seen.get, segments))
        if None in codes:
            known = len(seen)
            missing = [k for k, code in enumerate(codes) if code is None]
            new = sorted({segments[k] for k in missing})
            paths = self._merge_paths if self.model.bpe else self._light_paths
            self.remember(paths([s.replace(" ", MARK) for s in new]), known)
            seen.update(zip(new, range(known, known + len(new))))
            for k in missing:
                codes[k] = seen[segments[k]]
        return np.array(codes, np.int64)

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and where each text's ids begin (and the last end)."""
        segments, counts = [], []
        lead = " " if self.model.prefix else ""
        for text in texts:
            cut = _COARSE if text and self.odd and self.odd.search(text) else self.segment
            own = cut.findall(lead + text) if text else []
            segments += own
            counts.append(len(own))
        done, sizes = [], []
        for at in range(0, len(segments), SEGMENTS):
            if len(self.seen) > REMEMBERED or len(self.flat) > 16 * REMEMBERED:
                self.forget()
            if len(self.legal) > PAIRS:
                self.legal.clear()
            code = self.remembered(segments[at:at + SEGMENTS])
            sizes.append(self.bound[code + 1] - self.bound[code])
            done.append(self.flat[_ranges(self.bound[code], sizes[-1])])
        ids = np.concatenate([*done, np.zeros(0, np.int32)])
        size = np.concatenate([*sizes, np.zeros(0, np.int64)])
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        return ids, ends

    def bytes_of(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The decoded texts, end to end as bytes, and where each begins."""
        size = self.raw_size[ids]
        data = self.raw[_ranges(self.raw_head[ids], size)]
        bound = np.concatenate([[0], np.cumsum(size)])[ends]
        if self.model.prefix:
            first = bound[:-1][bound[1:] > bound[:-1]]
            first = first[data[first] == 0x20]
            data = np.delete(data, first)
            bound = bound - np.searchsorted(first, bound)
        return data, bound


def _ranges(heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """heads[0], heads[0] + 1, ... (sizes[0] of them), heads[1], ..."""
    return np.repeat(heads - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


_compiled: dict[int, Transducer] = {}


def compiled(data: bytes) -> Transducer:
    """One transducer per worker and model."""
    key = hash(data)
    if key not in _compiled:
        _compiled[key] = Transducer(read_model(data))
    return _compiled[key]


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _lists(values: np.ndarray, ends: np.ndarray, nulls: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values), mask=nulls)


FIELDS = {"ids": "array<int>", "n_pieces": "bigint", "n_bytes": "bigint", "round_trip": "boolean"}


def _slices(machine: Transducer, column: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """Some texts of a column at once, with the columns of ``FIELDS``."""
    is_byte = np.zeros(machine.size, bool)
    is_byte[machine.byte] = True
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(column):
        done = sizes[low - 1] if low else 0
        high = min(len(column), max(low + 1, int(np.searchsorted(sizes, done + AT_ONCE, "right"))))
        part = column.slice(low, high - low)
        texts = part.to_pylist()
        ids, ends = machine.ids_of(texts)
        data, bound = machine.bytes_of(ids, ends)
        whole = memoryview(data.tobytes())
        same = [(t or "").replace(MARK, " ").encode() == whole[a:b] for t, a, b in zip(texts, bound, bound[1:])]
        many_bytes = np.concatenate([[0], np.cumsum(is_byte[ids])])[ends]
        yield low, high, [_lists(ids, ends, pc.is_null(part)), pa.array(np.diff(ends)), pa.array(np.diff(many_bytes)),
                          pa.array(same, pa.bool_())]
        low = high


def encoder(spark, path: str = MODEL):
    """A function from a text column to a struct: ids, n_pieces, n_bytes (by byte fallback), round_trip."""
    shared = spark.sparkContext.broadcast(model_bytes(path))

    @F.arrow_udf("struct<" + ",".join(f"{name}:{kind}" for name, kind in FIELDS.items()) + ">")
    @frugal
    def encode(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = compiled(shared.value)
        for batch in column:
            parts = [columns for _, _, columns in _slices(machine, batch)]
            yield pa.StructArray.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], list(FIELDS)) if parts else pa.array(
                [], pa.struct([("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("n_bytes", pa.int64()), ("round_trip", pa.bool_())]))
        machine.forget()

    return encode


def encoded_rows(docs: DataFrame, keep: list[str], text: str = "text", path: str = MODEL) -> DataFrame:
    """The columns ``keep`` of ``docs`` and those of ``FIELDS``, given out some texts at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(path))
    rows = docs.select(*[col(c) for c in keep], col(text).alias("_text"))
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} {k}" for n, k in FIELDS.items()])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(shared.value)
        for batch in batches:
            for low, high, columns in _slices(machine, batch.column(len(keep))):
                yield pa.RecordBatch.from_arrays([c.slice(low, high - low) for c in batch.columns[:-1]] + columns, [*keep, *FIELDS])
        machine.forget()

    return rows.mapInArrow(run, schema)


def decoder(spark, path: str = MODEL):
    """A function from a column of ids to texts."""
    shared = spark.sparkContext.broadcast(model_bytes(path))

    @F.arrow_udf("string")
    @frugal
    def decode(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = compiled(shared.value)
        for batch in column:
            out = []
            for ids in batch:
                if not ids.is_valid:
                    out.append(None)
                    continue
                own = ids.values.to_numpy(zero_copy_only=False)
                data, _ = machine.bytes_of(own, np.array([0, len(own)]))
                out.append(data.tobytes().decode("utf-8", "replace"))
            yield pa.array(out, pa.string())

    return decode


def encoded(docs: DataFrame, text: str = "text", into: str = "pieces", path: str = MODEL) -> DataFrame:
    """``docs`` with the struct column ``into``."""
    return docs.withColumn(into, encoder(docs.sparkSession, path)(col(text)))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id, source and what the text is encoded to."""
    return encoded_rows(docs, ["doc_id", "source"])


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoded_rows(table(spark, sf_dir, "documents"), ["doc_id"])
