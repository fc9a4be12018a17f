"""SentencePiece encoding and decoding for merge-type vocabularies, by an agenda of adjacent symbol pairs."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.readers import wire_fields
from .common import SLICE, _give_back, small_batches

#: The mark that stands for a blank, and the library's numbers of its model and piece kinds.
MARK = "▁"
BPE, NORMAL, UNKNOWN, CONTROL, BYTE = 2, 1, 2, 3, 6
#: Chunks whose ids a worker remembers (two generations of at most so many, about 250 bytes each).
HOLD = 300_000
#: Symbols of a chunk up to which it's encoded beside others of its batch; longer ones get an agenda of their own.
SHORT = 24
#: Chunks that the library checks in one text.
CHECKED = 4096
#: Steps of the widths that short chunks are laid out in.
WIDTH = 4
NONE = np.iinfo(np.int32).max


class PieceModel:
    """A merge-type vocabulary: which pairs of symbols join, in what order of score, and the ids of what is left.

    Only what needs no guess is accepted: byte-pair vocabularies with byte fallback whose normaliser does nothing but put
    marks for blanks and one before the text, without user-defined or unused pieces, and no piece with a mark after another
    character. So nothing can join across the start of a run of marks, nor with a character that no piece holds: texts fall
    into chunks there, and the ids of a text are those of its chunks.
    """

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces, scores, kinds, trainer, normaliser = [], [], [], {}, {}
        for field, _, value in wire_fields(self.library.serialized_model_proto()):
            if field == 1:
                said = {f: v for f, _, v in wire_fields(value)}
                pieces.append(bytes(said.get(1, b"")).decode())
                scores.append(_float(said.get(2, 0)))
                kinds.append(said.get(3, NORMAL))
            elif field in (2, 3):
                (trainer if field == 2 else normaliser).update((f, v) for f, _, v in wire_fields(value))
        plain = not normaliser.get(2) and normaliser.get(3, 1) and not normaliser.get(4, 1) and normaliser.get(5, 1) and not trainer.get(24, 0)
        if trainer.get(3, 1) != BPE or not trainer.get(35, 0) or not plain or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only byte-pair vocabularies with byte fallback and a plain normaliser are supported")
        own = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        if MARK not in own or any(MARK in p.lstrip(MARK) for p in own):
            raise ValueError("a piece holds a mark after another character")
        self.bytes = [0] * 256
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.size = len(pieces)
        # symbols: pieces by their ids, then characters that only occur inside pieces
        self.symbols = dict(own)
        for p in own:
            for c in p:
                self.symbols.setdefault(c, self.size + len(self.symbols))
        order = {s: r for r, s in enumerate(sorted({scores[i] for p, i in own.items() if len(p) > 1}, reverse=True))}
        self.joins: dict[tuple[int, int], tuple[int, int]] = {}
        for p, i in own.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    self.joins[a, b] = (order[scores[i]], i)
        self.width = max(self.symbols.values()) + 1
        keys = np.array([a * self.width + b for a, b in self.joins], dtype=np.int64)
        at = np.argsort(keys)
        self.keys = keys[at]
        self.ranks = np.array([r for r, _ in self.joins.values()], dtype=np.int32)[at]
        self.made = np.array([m for _, m in self.joins.values()], dtype=np.int32)[at]
        self.characters = np.full(0x110000, -1, dtype=np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1 and i < self.size:
                self.characters[ord(c)] = i
        inside = "".join(map(re.escape, sorted({c for p in own for c in p} - {MARK})))
        self.chunks = re.compile(f"{MARK}+[{inside}]*|[{inside}]+|.", re.DOTALL).findall
        self.apart = next(chr(i) for i in range(1, 0x110000) if chr(i) not in self.symbols)  # joins with nothing
        self.apart_ids = [self.bytes[x] for x in self.apart.encode()]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def agenda(self, chunk: str) -> list[int]:
        """Ids of one chunk: pairs wait in a heap by score, then place; a pair whose ends have changed since is passed over."""
        symbols = [self.symbols.get(c, -1) for c in chunk]
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(*found, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (found := self.joins.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(waiting)
        while waiting:
            _, made, i, a, b = heapq.heappop(waiting)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = made, -2
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q < n and (found := self.joins.get((symbols[p], symbols[q]))):
                    heapq.heappush(waiting, (*found, p, symbols[p], symbols[q]))
        out = []
        for c, s in zip(chunk, symbols, strict=True):
            if 0 <= s < self.size:
                out.append(s)
            elif s != -2:  # a character that is no piece: its bytes
                out += [self.bytes[x] for x in c.encode()]
        return out

    def agendas(self, chunks: list[str]) -> list[bytes]:
        """Ids of many short chunks at once, as little-endian 32-bit integers.

        Each chunk is a row of symbols beside a row of its pairs' ranks, its agenda. In every step each row gives up its best
        pair, the leftmost of equals, until it has none. Chunks with characters that are no pieces go to ``agenda``.
        """
        width = max(map(len, chunks))
        symbols = self.characters[np.array(chunks, dtype=f"U{width}").view(np.uint32).reshape(len(chunks), width)]
        lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        inside = np.arange(width) < lengths[:, None]
        odd = ((symbols < 0) & inside).any(axis=1)
        symbols[~inside] = -1
        rows = np.flatnonzero(~odd & (lengths > 1))
        now = symbols[rows]
        rank, place = self._found(now[:, :-1], now[:, 1:])
        columns = np.arange(width)
        while len(rows):
            best = rank.argmin(axis=1)
            line = np.arange(len(rows))
            going = rank[line, best] != NONE
            if not going.all():
                symbols[rows[~going]] = now[~going]
                rows, now, rank, place, best = rows[going], now[going], rank[going], place[going], best[going]
                line = line[: len(rows)]
                if not len(rows):
                    break
            now[line, best] = self.made[place[line, best]]
            after = columns[1:-1] > best[:, None]
            now[:, 1:-1] = np.where(after, now[:, 2:], now[:, 1:-1])
            now[:, -1] = -1
            for table, nothing in ((rank, NONE), (place, 0)):
                table[:, :-1] = np.where(columns[: width - 2] >= best[:, None], table[:, 1:], table[:, :-1])
                table[:, -1] = nothing
            for at in (best - 1, best):
                ok = np.flatnonzero((at >= 0) & (at < width - 1))
                rank[ok, at[ok]], place[ok, at[ok]] = self._found(now[ok, at[ok]], now[ok, at[ok] + 1])
            lengths[rows] -= 1
        flat = symbols[np.arange(width) < lengths[:, None]].astype("<u4").tobytes()
        ends = (4 * np.cumsum(lengths)).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = _packed(self.agenda(chunks[i]))
        return out

    def _found(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs of symbols (NONE: they don't join), and their places in the table."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.width + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE).astype(np.int32), at

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Remember the ids of all ``chunks``; the new ones are encoded and checked with the library, many in one text.

        Returns those on which the library differs, with the agenda's ids; the library's are kept.
        """
        if len(self.recent) > HOLD:
            self.older, self.recent = self.recent, {}
        recent, older = self.recent, self.older
        by_width: dict[int, list[str]] = {}
        made: list[str] = []
        ids: list[bytes] = []
        for c in chunks:
            if c in recent:
                continue
            known = older.get(c)
            if known is not None:
                recent[c] = known
            elif 1 < len(c) <= SHORT:
                by_width.setdefault(-(-len(c) // WIDTH), []).append(c)
            else:
                made.append(c)
                ids.append(_packed(self.agenda(c)))
        for group in by_width.values():
            made += group
            ids += self.agendas(group)
        recent.update(zip(made, ids, strict=True))
        differ = {}
        for low in range(0, len(made), CHECKED):
            for c in self._differing(made[low : low + CHECKED], ids[low : low + CHECKED]):
                differ[c], recent[c] = recent[c], self._library([c])
        return differ

    def _library(self, chunks: list[str]) -> bytes:
        """The library's ids of ``chunks`` as one text. It puts a mark first; so a chunk on its own that has none comes after a
        character that joins with nothing, and the ids of both are left out again."""
        if len(chunks) == 1 and chunks[0][0] != MARK:
            return _packed(self.library.encode(self.apart + chunks[0])[1 + len(self.apart_ids) :])
        text = "".join(chunks)
        return _packed(self.library.encode(text[1:].replace(MARK, " ")) if len(text) > 1 else [self.symbols[MARK]])  # the library gives an empty text no mark

    def _differing(self, chunks: list[str], ids: list[bytes]) -> list[str]:
        """The chunks whose ids aren't the library's: all in one text first, each on its own only if that differs."""
        apart = _packed(self.apart_ids)
        said = self._library([MARK, *(self.apart + c for c in chunks)])
        if said == b"".join([_packed([self.symbols[MARK]]), *(apart + i for i in ids)]):
            return []
        return [c for c, i in zip(chunks, ids, strict=True) if self._library([c]) != i]

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, as the library decodes them."""
        return self.library.decode(np.frombuffer(ids, dtype="<u4").tolist())


def _float(bits: int | bytes) -> float:
    return struct.unpack("<f", bits if isinstance(bits, bytes) else struct.pack("<I", bits))[0]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_READY: dict[str, PieceModel] = {}


def _ready(model_path: str) -> PieceModel:
    """A worker's model, kept for its later tasks."""
    return _READY.get(model_path) or _READY.setdefault(model_path, PieceModel(model_path))


def piece_codec(docs: DataFrame, model_path: str, begin: bool = True, end: bool = True) -> DataFrame:
    """``doc_id, ids, decoded, n_differ``: every whole text's ids (little-endian unsigned 32-bit integers) and what they decode to.

    Texts are cut into chunks (``PieceModel``); each distinct chunk that a worker hasn't met lately is
    encoded by the agenda and checked with the library in the Arrow batch that brings it. ``n_differ`` counts a text's chunks
    on which the library differs, whose ids are then the library's: 0, unless the library changes. Memory is a batch's texts
    and the remembered chunks, a bounded table. One pass over the texts, no shuffle.

    Edge cases: null is an empty text, which has the begin and end ids alone and decodes to an empty text; a chunk of any
    length has an agenda of its own; repeated rows and null ids stay separate rows; no rows give no rows; other columns are
    ignored, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _ready(model_path)
        first, last = _packed([model.begin] * begin), _packed([model.end] * end)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                chunks = [model.chunks(MARK + t.replace(" ", MARK)) if t else [] for t in part.column("text").to_pylist()]
                differ = model.learn(set().union(*chunks))
                ids = [first + b"".join(map(model.recent.__getitem__, c)) + last for c in chunks]
                wrong = [sum(c in differ for c in cs) if differ else 0 for cs in chunks]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(map(model.decode, ids), pa.string()), pa.array(wrong, pa.int64())],
                    names=["doc_id", "ids", "decoded", "n_differ"],
                )
                del chunks, ids
        _give_back()

    return docs.mapInArrow(run, "doc_id long, ids binary, decoded string, n_differ long")
