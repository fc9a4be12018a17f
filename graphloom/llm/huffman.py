"""Canonical length-limited Huffman codes over integer ids, vectorised with numpy."""

from __future__ import annotations

import numpy as np


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; 0 for ids that don't occur.

    Ties go to the smaller id. One id that occurs gets length 1, none gives zeros.
    """
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    merged, is_leaf = leaves, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        is_leaf.append(rank < n)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        leaf = int(flags[:take].sum())
        lengths[order[:leaf]] += 1
        take = 2 * (take - leaf)
    return lengths


class Code:
    """Encoder and decoder tables of the canonical code with the given lengths."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = np.asarray(lengths, dtype=np.uint8)
        self.bits = int(self.lengths.max(initial=0)) or 1
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        lens = self.lengths[order].astype(np.int64)
        span = np.left_shift(1, self.bits - lens)
        start = np.concatenate([[0], np.cumsum(span)]).astype(np.int64)
        if start[-1] > 1 << self.bits:
            raise ValueError("these lengths are no prefix code")
        self.codes = np.zeros(len(self.lengths), dtype=np.uint64)
        self.codes[order] = (start[:-1] >> (self.bits - lens)).astype(np.uint64)
        self.symbol = np.zeros(1 << self.bits, dtype=np.uint32)
        self.width = np.ones(1 << self.bits, dtype=np.uint8)
        self.symbol[: start[-1]] = np.repeat(order.astype(np.uint32), span)
        self.width[: start[-1]] = np.repeat(self.lengths[order], span)

    def encode(self, ids: np.ndarray, block: int) -> tuple[bytes, np.ndarray]:
        """The bits of ``ids``, first bit highest, and the bit offset of every ``block``-th id."""
        if not len(ids):
            return b"", np.zeros(0, dtype=np.uint64)
        width = self.lengths[ids].astype(np.int64)
        if not width.all():
            raise ValueError("an id has no code")
        end = np.cumsum(width)
        at = end - width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        left = self.codes[ids] << (np.uint64(64) - width.astype(np.uint64))
        out = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(left >> shift, first)
        over = np.flatnonzero(((at & 63) + width) > 64)
        out[word[over] + 1] |= left[over] << (np.uint64(64) - shift[over])
        return out.byteswap().tobytes()[: (int(end[-1]) + 7) // 8], at[::block].astype(np.uint64)

    def decode(self, payload: bytes, n: int, offsets: np.ndarray, block: int) -> np.ndarray:
        """The ``n`` ids: all blocks advance together, each from its own checkpoint, by table lookups."""
        if not n:
            return np.zeros(0, dtype=np.uint32)
        raw = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = offsets.astype(np.int64)
        out = np.zeros((len(at), block), dtype=np.uint32)
        mask, down = np.int64((1 << self.bits) - 1), 32 - self.bits
        last = n - (len(at) - 1) * block
        for i in range(block):
            if i == last:
                at = at[:-1]
                if not len(at):
                    break
            peek = (window[at >> 3].astype(np.int64) >> (down - (at & 7))) & mask
            out[: len(at), i] = self.symbol[peek]
            at = at + self.width[peek]
        return out.reshape(-1)[:n]
