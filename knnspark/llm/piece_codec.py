"""SentencePiece BPE encoding and decoding as vectorised merge rounds.

All distinct words of a batch lie in one flat numpy array of symbols. In each round every word
finds its lowest pair rank by a segmented minimum, the leftmost disjoint pairs of that rank merge at once, the array
is compacted, and words without a pair leave; it ends when no pair remains. Symbols outside
the vocabulary become byte pieces. The model file is read, never trained.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import flat, mix64, slices, span_hashes, tidy

SPACE = "\u2581"
_FAR = np.int64(1) << 60


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size


class PieceModel:
    """The vocabulary of a BPE model file with byte fallback, as tables for the merge rounds."""

    def __init__(self, raw: bytes) -> None:
        self.mark = sha256(raw).hexdigest()
        pieces, normal = [], {}
        trainer = {}
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]), piece.get(3, 1)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no other normalisation are supported")
        if any(kind in (4, 5) for _, _, kind in pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.pieces = [p for p, _, _ in pieces]
        self.byte_ids = np.zeros(256, dtype=np.int64)
        self.size = len(pieces)
        self.raw_pieces, self.is_byte = [], np.zeros(self.size, dtype=bool)
        usable = {}
        for k, (p, score, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(p[3:5], 16)], self.is_byte[k] = k, True
                self.raw_pieces.append(bytes([int(p[3:5], 16)]))
            else:
                self.raw_pieces.append(b"" if kind == 3 else " \u2047 ".encode() if kind == 2 else p.replace(SPACE, " ").encode())
                if kind == 1:
                    usable[p] = (k, score)
        # Symbols: piece ids, then characters that are only part of pieces, then (per batch) others.
        self.symbol = {p: k for p, (k, _) in usable.items()}
        for p in usable:
            for c in p:
                self.symbol.setdefault(c, self.size + len(self.symbol))
        self.first_free = self.size + 2 * len(self.symbol)
        order = {s: r for r, s in enumerate(sorted({s for _, s in usable.values()}, reverse=True))}
        pairs = []
        for p, (k, score) in usable.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs.append(((a << 32) | b, order[score], k))
        pairs.sort()
        self.pair_keys = np.array([p[0] for p in pairs] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.pair_ranks = np.array([p[1] for p in pairs] + [0], dtype=np.int64)
        self.pair_ids = np.array([p[2] for p in pairs] + [0], dtype=np.int64)
        self.splits_at_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in usable)
        self.word = re.compile(f"{SPACE}*[^{SPACE}]*") if self.splits_at_space else re.compile(".+", re.S)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 32) | right
        at = np.searchsorted(self.pair_keys, key)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], _FAR), self.pair_ids[at]

    def _alone(self, symbols: list[int]) -> list[int]:
        """One word by a heap of pairs: best rank first, then leftmost."""
        n, nxt, prev = len(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        sym, heap = list(symbols), []

        def offer(a: int) -> None:
            b = nxt[a]
            if a >= 0 and b < n:
                rank, to = self.look_up(np.array([sym[a]]), np.array([sym[b]]))
                if rank[0] < _FAR:
                    heapq.heappush(heap, (int(rank[0]), a, b, sym[a], sym[b], int(to[0])))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, b, sa, sb, to = heapq.heappop(heap)
            if sym[a] != sa or sym[b] != sb or nxt[a] != b:
                continue
            sym[a], sym[b], nxt[a] = to, -1, nxt[b]
            if nxt[a] < n:
                prev[nxt[a]] = a
            offer(a)
            if prev[a] >= 0:
                offer(prev[a])
        return [s for s in sym if s >= 0]

    def merge_words(self, words: list[str]) -> list[np.ndarray]:
        """Piece ids of each word."""
        others: dict[str, int] = {}
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        kinds, inverse = np.unique(chars, return_inverse=True)
        named = [self.symbol.get(chr(c)) for c in kinds]
        table = np.array([self.first_free + k if s is None else s for k, s in enumerate(named)], dtype=np.int64)
        others = {self.first_free + k: chr(c) for k, (c, s) in enumerate(zip(kinds, named, strict=True)) if s is None}
        others |= {s: c for c, s in self.symbol.items() if s >= self.size}
        symbols, of = (table[inverse] if len(kinds) else np.zeros(0, np.int64)), np.repeat(np.arange(len(words)), lengths)
        done_of, done_symbols = [of[:0]], [symbols[:0]]
        floor = np.full(len(words), -1, dtype=np.int64)
        before = None
        while len(symbols):
            rank = np.full(len(symbols), _FAR)
            to = np.zeros(len(symbols), dtype=np.int64)
            rank[:-1], to[:-1] = self.look_up(symbols[:-1], symbols[1:])
            rank[:-1][of[:-1] != of[1:]] = _FAR
            heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            live = of[heads]
            # Several merges at once went ahead of a pair that they made and that ranks before them.
            late = live[(best < floor[live])]
            if len(late):
                again = np.isin(of, late)
                for w in late:
                    ids = np.array(self._alone(before[1][before[0] == w].tolist()), dtype=np.int64)
                    done_of.append(np.full(len(ids), w))
                    done_symbols.append(ids)
                symbols, of = symbols[~again], of[~again]
                floor[late] = -1
                continue
            spread = np.repeat(best, np.diff(np.append(heads, len(symbols))))
            ended = spread == _FAR
            done_of.append(of[ended])
            done_symbols.append(symbols[ended])
            hit = (rank == spread) & ~ended
            # In a run of overlapping pairs every other one counts, from the left.
            at = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), at, 0))
            take = hit & ((at - run_start) % 2 == 0)
            many = np.bincount(of[take], minlength=len(words)) > 1
            floor = np.full(len(words), -1, dtype=np.int64)
            floor[live] = np.where(many[live], best, -1)
            before = (of, symbols) if many.any() else before
            merged = np.where(take, to, symbols)
            stay = ~ended & ~np.concatenate([[False], take[:-1]])
            symbols, of = merged[stay], of[stay]
        symbols, of = np.concatenate(done_symbols), np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        symbols, of = symbols[order], of[order]
        ends = np.searchsorted(of, np.arange(len(words) + 1))
        out = [symbols[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for w in np.unique(of[symbols >= self.size]):
            out[w] = np.array([i for s in out[w].tolist() for i in ([s] if s < self.size else self.byte_ids[list(others[s].encode())].tolist())], dtype=np.int64)
        return out

    def words_of(self, text: str) -> list[str]:
        """The units that no piece crosses: runs of spaces with what follows."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if self.splits_at_space and SPACE + SPACE not in text:
            return [SPACE + w for w in text[1:].split(SPACE)]
        return [w for w in self.word.findall(text) if w]

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of rows of ids; the dummy prefix goes, bytes that are no UTF-8 become U+FFFD."""
        if not hasattr(self, "_lengths"):
            self._lengths = np.array([len(p) for p in self.raw_pieces], dtype=np.int64)
            self._starts = np.concatenate([[0], np.cumsum(self._lengths)])
            self._joined = np.frombuffer(b"".join(self.raw_pieces), dtype=np.uint8)
        size = self._lengths[ids]
        ends = np.cumsum(size)
        where = np.repeat(self._starts[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        raw = self._joined[where].tobytes()
        cut = np.concatenate([[0], ends])[offsets]
        out = []
        for k in range(len(offsets) - 1):
            text = raw[cut[k] : cut[k + 1]]
            a = offsets[k]
            if offsets[k + 1] > a and text[:1] == b" " and not self.is_byte[ids[a]]:
                text = text[1:]
            out.append(text.decode(errors="replace"))
        return out


def read_model(path: str) -> PieceModel:
    """Reads a model file that lies on the driver; its tables travel to the executors by broadcast."""
    with open(path, "rb") as f:
        return PieceModel(f.read())


class WordCache:
    """Ids of words met before, found by 128-bit hashes in sorted arrays; emptied beyond `most` words."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.h1, self.h2 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slots, -1 for words that are not here."""
        if not len(self.h1):
            return np.full(len(h1), -1)
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        return np.where((self.h1[at] == h1) & (self.h2[at] == h2), at, -1)

    def add(self, h1: np.ndarray, h2: np.ndarray, ids: list[np.ndarray]) -> None:
        if len(self.h1) + len(h1) > self.most:
            self.clear()
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        start = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, *ids]).astype(np.int32)
        order = np.argsort(h1)
        at = np.searchsorted(self.h1, h1[order])
        for name, new in (("h1", h1), ("h2", h2), ("start", start), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), at, new[order]))


#: Kept by a Python worker from task to task.
_CACHES: dict[str, WordCache] = {}


def _ids_of_words(model: PieceModel, cache: WordCache, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words (without their leading space) and the number of each."""
    h1 = span_hashes(buf, starts, ends)
    h2 = span_hashes(buf ^ np.uint8(0x55), starts, ends)
    _, first, which = np.unique(h1 + mix64(h2), return_index=True, return_inverse=True)
    slots = cache.find(h1[first], h2[first])
    new = first[slots < 0]
    if len(new):
        raw = buf.tobytes()
        ids = model.merge_words([SPACE + raw[a:b].decode() for a, b in zip(starts[new], ends[new], strict=True)])
        before = len(cache.h1)
        cache.add(h1[new], h2[new], ids)
        if len(cache.h1) < before + len(new):  # it was emptied: all words anew
            cache.clear()
            cache.add(h1[first], h2[first], model.merge_words([SPACE + raw[a:b].decode() for a, b in zip(starts[first], ends[first], strict=True)]))
        slots = cache.find(h1[first], h2[first])
    slots = slots[which]
    size, start = cache.size[slots], cache.start[slots]
    ends_of = np.cumsum(size)
    return cache.flat[np.repeat(start - (ends_of - size), size) + np.arange(int(ends_of[-1]) if len(ends_of) else 0)], size


def encode_batch(model: PieceModel, cache: WordCache, col: pa.Array) -> pa.ListArray:
    """Ids of each text. Texts with runs of spaces, spaces at an end or U+2581 go word by word."""
    buf, offsets = flat(col)
    n = len(col)
    space = buf == 32
    odd = np.zeros(n, dtype=bool)
    inside = np.repeat(np.arange(n), np.diff(offsets))
    if len(buf):
        double = np.flatnonzero(space[:-1] & space[1:])
        odd[inside[double]] = True
        mark = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81))
        odd[inside[mark]] = True
        full = np.flatnonzero(np.diff(offsets) > 0)
        odd[full] |= space[offsets[full]] | space[offsets[full + 1] - 1]
    odd |= not model.splits_at_space
    # A word starts at a row's start or after a space, and ends at a space or the row's end.
    plain = ~odd & (np.diff(offsets) > 0)
    gaps = np.flatnonzero(space)
    gaps = gaps[plain[inside[gaps]]] if len(gaps) else gaps
    starts, ends = np.sort(np.concatenate([offsets[:-1][plain], gaps + 1])), np.sort(np.concatenate([offsets[1:][plain], gaps]))
    flat_ids, size = _ids_of_words(model, cache, buf, starts, ends)
    of = inside[starts] if len(starts) else starts
    count = np.bincount(of, weights=size, minlength=n).astype(np.int64)
    if odd.any():
        parts, cut = [], np.cumsum(count) - count
        for k in range(n):
            if odd[k]:
                words = model.words_of(buf[offsets[k] : offsets[k + 1]].tobytes().decode())
                ids = np.concatenate([np.zeros(0, np.int64), *model.merge_words(words)])
                parts.append(ids)
            else:
                parts.append(flat_ids[cut[k] : cut[k] + count[k]])
        count = np.array([len(p) for p in parts])
        flat_ids = np.concatenate(parts)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), flat_ids.astype(np.int32))


def encode(docs: DataFrame, model: PieceModel, text: str = "text", ids: str = "ids", cache_words: int = 400_000) -> DataFrame:
    """All rows and columns of docs with the piece ids of each whole text (null or empty: none)."""
    rest = [c for c in docs.columns if c != ids]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = _CACHES.setdefault(model.mark, WordCache(cache_words))
        for whole in batches:
            for batch in slices(whole, text):
                coded = encode_batch(model, cache, batch.column(batch.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays([*batch.columns, coded], names=[*batch.schema.names, ids])
        tidy()

    return docs.select(*rest).mapInArrow(run, StructType([*docs.select(*rest).schema, StructField(ids, ArrayType(IntegerType()))]))


def decode(rows: DataFrame, model: PieceModel, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All rows and columns with the text of each list of ids (null or empty: '')."""
    rest = [c for c in rows.columns if c != decoded]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                col = batch.column(batch.schema.get_field_index(ids))
                sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
                values = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = model.decode_flat(values, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, decoded])

    return rows.select(*rest).mapInArrow(run, StructType([*rows.select(*rest).schema, StructField(decoded, StringType())]))


def transcode(docs: DataFrame, model: PieceModel, text: str = "text", ids: str = "ids", decoded: str = "decoded", cache_words: int = 400_000) -> DataFrame:
    """encode() and decode() in one pass: all columns of docs but the text, its ids and their text."""
    rest = [c for c in docs.columns if c not in (text, ids, decoded)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = _CACHES.setdefault(model.mark, WordCache(cache_words))
        for whole in batches:
            for batch in slices(whole, text):
                coded = encode_batch(model, cache, batch.column(len(rest)))
                texts = model.decode_flat(coded.values.to_numpy().astype(np.int64), coded.offsets.to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], coded, pa.array(texts, pa.string())], names=[*rest, ids, decoded])
        tidy()

    kept = docs.select(*rest, text)
    return kept.mapInArrow(run, StructType([*kept.schema.fields[:-1], StructField(ids, ArrayType(IntegerType())), StructField(decoded, StringType())]))
