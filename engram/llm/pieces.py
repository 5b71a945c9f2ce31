"""SentencePiece encoding and decoding that keeps offsets.

A text is normalised from left to right: the longest prefix that the model's compiled
character map knows is replaced, any other character stays, spaces become the model's space
symbol. For each byte of the normalised text the place in the source that it came from is
recorded, so each piece is projected to a byte span of the original text.

Pieces are then merged by score, the leftmost first among equals. No merge crosses a place
whose two characters are neighbours in no piece: the text is cut there and each part is merged
once a worker, short parts by looking for the best pair, others with a heap over linked
symbols. Characters outside the vocabulary become their bytes, or one unknown piece a run
where the model has no byte pieces.

Nulls encode as empty texts; an empty text has no ids. Texts of any length work in
O(n log n), memory is bounded by the longest text. Other columns pass unchanged.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import trim

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct parts a worker remembers before it forgets all, and characters of the longest.
MEMO, LONGEST = 300_000, 128
#: Characters of a part that is merged without a heap.
SHORT = 40
#: Slots of the table of neighbours; parts that share one are merely not cut.
SLOTS = 1 << 20
_NO = 1 << 62


# ----------------------------------------------------------------------- model


def _fields(raw: bytes):
    """(number, value) of each field of a protobuf message."""
    at, n = 0, len(raw)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = raw[at : at + size]
            at += size
        yield tag >> 3, value


class Model:
    """What a model file says. Its field numbers are fixed values of the file format."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.byte_fallback = self.suffix = False
        self.unknown_surface = " ⁇ "
        self.kind = 1
        self.charmap, self.dummy, self.squeeze, self.escape = b"", True, True, True
        for k, v in _fields(raw):
            if k == 1:
                own = dict(_fields(v))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif k == 2:
                own = dict(_fields(v))
                self.kind, self.suffix, self.byte_fallback = own.get(3, 1), bool(own.get(24, 0)), bool(own.get(35, 0))
                self.unknown_surface = own[44].decode() if 44 in own else self.unknown_surface
            elif k == 3:
                own = dict(_fields(v))
                self.charmap, self.dummy, self.squeeze, self.escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        if self.pieces and self.kind != 2:
            raise ValueError("only models that merge pairs (BPE) can be read")


class CharMap:
    """Longest-prefix replacement through a compiled map: a double array over bytes, and a blob
    of replacements that end with a zero byte."""

    def __init__(self, raw: bytes):
        size = int.from_bytes(raw[:4], "little")
        self.units = np.frombuffer(raw[4 : 4 + size], "<u4").tolist()
        self.texts = raw[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest known prefix of raw[at:]."""
        units, found = self.units, None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        size, start = found
        return size, self.texts[start : self.texts.index(b"\0", start)]


# ----------------------------------------------------------------------- codec


def _slots(text: str) -> np.ndarray:
    """A slot for each two neighbours."""
    x = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return (x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(12)


class Codec:
    def __init__(self, model: bytes):
        self.raw = model
        self._load()

    def __getstate__(self):
        return {"raw": self.raw}

    def __setstate__(self, state):
        self.raw = state["raw"]
        self._load()

    def _load(self) -> None:
        m = self.model = Model(self.raw)
        self.map = CharMap(m.charmap) if m.charmap else None
        mergeable = (NORMAL, USER, UNUSED)
        self.ids = {p: i for i, p in enumerate(m.pieces) if m.kinds[i] in mergeable}
        self.unused = {i for i, k in enumerate(m.kinds) if k == UNUSED}
        self.unknown = next((i for i, k in enumerate(m.kinds) if k == UNKNOWN), -1)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(m.pieces) if m.kinds[i] == BYTE}
        self.user = sorted((p for i, p in enumerate(m.pieces) if m.kinds[i] == USER), key=lambda p: -len(p.encode()))
        self.user_pattern = re.compile("|".join(map(re.escape, self.user))) if self.user else None
        self.surfaces = [{CONTROL: b"", UNKNOWN: m.unknown_surface.encode()}.get(k, bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode()) for p, k in zip(m.pieces, m.kinds)]
        self.controls = {i for i, k in enumerate(m.kinds) if k == CONTROL}
        self.is_byte = [k == BYTE for k in m.kinds]
        order = {x: r for r, x in enumerate(sorted({m.scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[m.scores[i]] for p, i in self.ids.items()}
        self.sizes = [len(p.encode()) for p in m.pieces]
        self.simple = not self.user and not self.unused
        self.neighbours = np.zeros(SLOTS, bool)
        for p in self.ids:
            self.neighbours[_slots(p)] = True
        self.memo: dict[str, tuple[bytes, bytes]] = {}

    # ---------------------------------------------------------- normalisation

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the place in the source's bytes."""
        m, raw = self.model, text.encode()
        if not raw:
            return "", np.zeros(1, np.int32)
        if self.map is None and not m.squeeze and m.escape and self.user_pattern is None:
            out = text.replace(" ", SPACE)
            data = np.frombuffer(raw, np.uint8)
            first = np.where((data & 0xC0) != 0x80, np.arange(len(data), dtype=np.int32), np.int32(0))
            places = np.repeat(np.maximum.accumulate(first), np.where(data == 32, 3, 1))
            n = np.int32(len(raw))
            if m.dummy:
                out, places = (out + SPACE, np.concatenate([places, [n] * 3])) if m.suffix else (SPACE + out, np.concatenate([[0] * 3, places]))
            return out, np.append(places, n).astype(np.int32)
        return self._replaced(raw)

    def _prefix(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """(bytes consumed, what they become) of what stands at a place."""
        if self.user_pattern is not None:
            for p in self.user:
                if raw.startswith(p := p.encode(), at):
                    return len(p), p
        if self.map is not None and (found := self.map.longest(raw, at)):
            return found
        lead = raw[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, raw[at : at + size]

    def _replaced(self, raw: bytes) -> tuple[str, np.ndarray]:
        m, at, n = self.model, 0, len(raw)
        space = SPACE.encode() if m.escape else b" "
        if m.squeeze:
            while at < n and (found := self._prefix(raw, at))[1] == b" ":
                at += found[0]
            if at == n:
                return "", np.zeros(1, np.int32)
        out, places = bytearray(), []
        if m.dummy and not m.suffix:
            out += space
            places += [at] * len(space)
        after_space = m.squeeze
        while at < n:
            size, text = self._prefix(raw, at)
            if after_space:
                text = text.lstrip(b" ")
            if text:
                after_space = m.squeeze and text.endswith(b" ")
                text = text.replace(b" ", space)
                out += text
                places += [at] * len(text)
            at += size
            after_space = after_space and m.squeeze
        end = n
        if m.squeeze:
            while out.endswith(space):
                end = places[len(out) - len(space)]
                del out[-len(space) :], places[-len(space) :]
        if m.dummy and m.suffix:
            out += space
            places += [end] * len(space)
        return out.decode(), np.array([*places, end], np.int32)

    # ---------------------------------------------------------------- merging

    def parts(self, text: str) -> list[str]:
        """The text cut wherever no piece can lie across."""
        cuts = (np.flatnonzero(~self.neighbours[_slots(text)]) + 1).tolist() if text else []
        return [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])] if text else []

    def _best_first(self, part: str) -> list[str]:
        """merge() by looking for the best pair each time."""
        rank, symbols = self.rank.get, list(part)
        ranks = [rank(a + b, _NO) for a, b in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < _NO:
            i = ranks.index(best)
            symbols[i] += symbols.pop(i + 1)
            ranks.pop(i)
            if i:
                ranks[i - 1] = rank(symbols[i - 1] + symbols[i], _NO)
            if i < len(ranks):
                ranks[i] = rank(symbols[i] + symbols[i + 1], _NO)
        return symbols

    def _symbols(self, part: str) -> tuple[list[str], list[bool]]:
        if self.user_pattern is None:
            return list(part), [False] * len(part)
        out, frozen, at = [], [], 0
        for hit in self.user_pattern.finditer(part):
            out += [*part[at : hit.start()], hit.group()]
            frozen += [False] * (hit.start() - at) + [True]
            at = hit.end()
        return out + list(part[at:]), frozen + [False] * (len(part) - at)

    def merge(self, part: str) -> list[str]:
        """The part's pieces: the best score first, the leftmost among equals."""
        if self.simple and len(part) <= SHORT:
            return self._best_first(part)
        symbols, frozen = self._symbols(part)
        ids, scores, push, pop = self.ids.get, self.model.scores, heapq.heappush, heapq.heappop
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        made: dict[str, tuple[str, str]] = {}
        heap: list = []

        def offer(i: int, j: int) -> None:
            if i < 0 or j < 0 or frozen[i] or frozen[j]:
                return
            both = symbols[i] + symbols[j]
            k = ids(both)
            if k is not None:
                push(heap, (-scores[k], i, j, len(both)))
                if k in self.unused:
                    made[both] = (symbols[i], symbols[j])

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = pop(heap)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size or right[i] != j:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = symbols[i] + symbols[j], ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        out, stack = [], [s for s in reversed(symbols) if s]
        while stack:
            s = stack.pop()
            if s in made and ids(s) in self.unused:
                stack += reversed(made[s])
            else:
                out.append(s)
        return out

    def _coded(self, part: str) -> tuple[bytes, bytes]:
        """Ids of a part and bytes of the normalised text under each, as little-endian 32-bit integers."""
        symbols = self.merge(part)
        try:
            ids = list(map(self.ids.__getitem__, symbols))
            return array("I", ids).tobytes(), array("I", map(self.sizes.__getitem__, ids)).tobytes()
        except KeyError:
            ids, sizes = [], []
        for s in symbols:
            k = self.ids.get(s)
            raw = s.encode()
            if k is not None:
                ids.append(k), sizes.append(len(raw))
            elif self.model.byte_fallback:
                ids += [self.bytes[b] for b in raw]
                sizes += [1] * len(raw)
            else:
                ids.append(self.unknown), sizes.append(len(raw))
        return array("I", ids).tobytes(), array("I", sizes).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first byte and the end of each piece in the source."""
        normal, places = self.normalize(text)
        memo, coded = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        for p in self.parts(normal):
            found = memo.get(p)
            if found is None:
                found = self._coded(p)
                if len(p) <= LONGEST:
                    memo[p] = found
            coded.append(found)
        ids, sizes = (np.frombuffer(b"".join([c[k] for c in coded]), "<u4") for k in (0, 1))
        edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        if not self.model.byte_fallback and len(ids):
            first = np.append(True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown))
            ids, edges = ids[first], np.append(edges[:-1][first], edges[-1])
        at = places[edges]
        return ids, at[:-1], at[1:]

    # --------------------------------------------------------------- decoding

    def decode(self, ids: list[int]) -> str:
        surfaces, m = self.surfaces, self.model
        head, k = b"", 0
        if m.dummy or m.squeeze:  # the space before the first piece goes
            while k < len(ids) and not head:
                piece, i = surfaces[ids[k]], ids[k]
                plain = m.kinds[i] not in (BYTE, UNKNOWN, CONTROL)
                strip = plain and piece.startswith(b" ")
                head = piece[1:] if strip else piece
                k += 1
                if (strip and not m.squeeze) or (m.kinds[i] == BYTE):
                    break
        rest = ids[k:]
        if self.controls.isdisjoint(ids):  # they end a run of bytes
            try:
                return (head + b"".join(map(surfaces.__getitem__, rest))).decode()
            except UnicodeDecodeError:
                pass
        return self._by_runs(ids[:k], head, rest)

    def _by_runs(self, first: list[int], head: bytes, rest: list[int]) -> str:
        """Runs of byte pieces one by one; bytes that are no character become U+FFFD each."""
        out, run = bytearray(), bytearray()
        seq = [(head, self.is_byte[first[-1]])] if first else []
        for piece, single in [*seq, *((self.surfaces[i], self.is_byte[i]) for i in rest), (b"", False)]:
            if single:
                run += piece
            else:
                out += _characters(bytes(run)).encode() + piece
                run.clear()
        return out.decode()


def _characters(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


def codec_from(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


# ------------------------------------------------------------------- operators


def _slices(batch: pa.RecordBatch, rows: int = 256):
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
    trim()


def encode_documents(df: DataFrame, codec: Codec, text: str = "text", ids: str = "token_ids", starts: str = "token_starts", ends: str = "token_ends") -> DataFrame:
    """df with the ids of the whole text and the bytes of the original under each (its first
    byte and its end), as array<int>; columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(codec)
    own = (ids, starts, ends)
    out = T.StructType([*[f for f in df.schema.fields if f.name not in own], *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in own]])

    def apply(batches):
        c = shared.value
        for b in batches:
            for part in _slices(b):
                coded = [c.encode(t or "") for t in part.column(text).to_pylist()]
                offsets = pa.array(np.cumsum([0, *(len(x[0]) for x in coded)], dtype=np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *(x[k].astype(np.int32) for x in coded)]))) for k in range(3)]
                keep = [n for n in part.schema.names if n not in own]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], *lists], names=[*keep, *own])

    return df.mapInArrow(apply, out)


def decode_ids(df: DataFrame, codec: Codec, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with a string column of the decoded text; null ids decode to an empty one."""
    shared = df.sparkSession.sparkContext.broadcast(codec)
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.StringType())])

    def apply(batches):
        c = shared.value
        for b in batches:
            for part in _slices(b):
                done = [c.decode(x or []) for x in part.column(ids).to_pylist()]
                keep = [n for n in part.schema.names if n != out]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], pa.array(done, pa.string())], names=[*keep, out])

    return df.mapInArrow(apply, schema)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def digests(df: DataFrame, codec: Codec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: how many ids, and SHA-256 of the ids, of the text they decode to and of the
    pieces' spans in the original (first byte and end as little-endian 32-bit integers)."""
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def apply(batches):
        c = shared.value
        for b in batches:
            for part in _slices(b):
                cols: list[list] = [[], [], [], []]
                for t in part.column(1).to_pylist():
                    ids, start, end = c.encode(t or "")
                    ids = ids.tolist()
                    spans = np.stack([start, end], 1).astype("<u4").tobytes()
                    for col, v in zip(cols, (len(ids), *(hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), c.decode(ids).encode(), spans)))):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(cols[0], pa.int64()), *[pa.array(x, pa.string()) for x in cols[1:]]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return df.select(key, text).mapInArrow(apply, DIGEST)
