"""Anchors as numbers: windows of many reads at a time, and an index of them by differences.

A base is a few bits, the first one highest, below a leading 1, so that anchors of different lengths are different numbers. The
letters are coded in order, so numbers of one length sort as their texts do.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np

ALPHABET = "ACGT"


class Coder:
    """Numbers of anchors over an alphabet. An anchor of other letters, or outside of its read, is -1."""

    def __init__(self, alphabet: str = ALPHABET):
        self.letters = sorted(set(alphabet))
        self.bits = max(1, (len(self.letters) - 1).bit_length())
        self.digits = np.full(0x110000 if max(map(ord, self.letters)) > 255 else 256, 255, np.uint8)
        for k, x in enumerate(self.letters):
            self.digits[ord(x)] = k

    def check(self, depth: int) -> None:
        if self.bits * depth > 62:
            raise ValueError(f"anchors of {depth} bases are too long for numbers; {62 // self.bits} are possible")

    def text(self, anchor: str) -> int:
        out = 1
        for x in anchor:
            k = self.digits[ord(x)] if ord(x) < len(self.digits) else 255
            if k == 255:
                return -1
            out = out << self.bits | int(k)
        return out

    def flat(self, seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The digits of all reads on end, and where each begins."""
        codes = np.frombuffer("".join(seqs).encode("utf-32-le"), np.uint32)
        known = codes < len(self.digits)
        out = np.full(len(codes), 255, np.uint8)
        out[known] = self.digits[codes[known]]
        return out, np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)

    def windows(self, flat: np.ndarray, at: np.ndarray, begin: np.ndarray, depth: int) -> np.ndarray:
        """The number of the window of each read that begins at a place of it."""
        self.check(depth)
        ok = (begin >= 0) & (begin + depth <= np.diff(at))
        found = np.full(len(begin), -1, np.int64)
        if ok.any():
            d = flat[(at[:-1] + begin)[ok][:, None] + np.arange(depth)]
            shifts = self.bits * np.arange(depth - 1, -1, -1, dtype=np.int64)
            codes = (d.astype(np.int64) << shifts).sum(axis=1) | (1 << (self.bits * depth))
            found[ok] = np.where((d == 255).any(axis=1), -1, codes)
        return found


def spread_low(bits: int, depth: int) -> int:
    """The lowest bit of each base."""
    return sum(1 << (bits * i) for i in range(depth))


def differing(x: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Of codes combined by exclusive or: one bit for each base that differs."""
    out = x
    for k in range(1, bits):
        out = out | (x >> k)
    return out & spread_low(bits, depth)


def spaced(off: np.ndarray, bits: int) -> np.ndarray:
    """Whether each base that differs is followed by two equal ones, as far as there are any."""
    return (off & (off >> bits) == 0) & (off & (off >> (2 * bits)) == 0)


def parts_of(depth: int, near: int, bits: int) -> tuple[tuple[int, int], ...]:
    """A number and a mask for each of `near` parts of an anchor; the leading 1 is in all."""
    n = max(1, min(near, depth))
    cuts = [depth * i // n for i in range(n + 1)]
    part = lambda a, b: ((1 << (bits * (b - a))) - 1) << (bits * (depth - b))
    return tuple((i, part(a, b) | 1 << (bits * depth)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))


class AnchorIndex:
    """Anchors of one slot, with exact lookup, deletion, and the nearest anchor under a number of differences.

    An anchor with fewer than `near` differences shares one of `near` equal parts with what is looked up.
    """

    def __init__(self, near: int = 3, coder: Coder | None = None):
        self.near, self.coder = near, coder or Coder()
        self.exact: dict[int, object] = {}
        self.parts: defaultdict[tuple[int, int], list[int]] = defaultdict(list)
        self._masks = cache(self._masks)

    def _masks(self, length: int) -> tuple[tuple[tuple[int, int], ...], int]:
        """The parts, and the lowest bits of the bases."""
        return parts_of(length, self.near, self.coder.bits), spread_low(self.coder.bits, length)

    def _of(self, code: int) -> tuple[tuple[tuple[int, int], ...], int]:
        return self._masks((code.bit_length() - 1) // self.coder.bits)

    def insert(self, anchor: str | int, cluster: object) -> None:
        """A later cluster with the same anchor takes it over."""
        code = self.coder.text(anchor) if isinstance(anchor, str) else anchor
        if code not in self.exact:
            for i, mask in self._of(code)[0]:
                self.parts[i, code & mask].append(code)
        self.exact[code] = cluster

    def delete(self, anchor: str | int) -> None:
        code = self.coder.text(anchor) if isinstance(anchor, str) else anchor
        if self.exact.pop(code, None) is not None:
            for i, mask in self._of(code)[0]:
                self.parts[i, code & mask].remove(code)

    def get(self, anchor: str | int) -> object | None:
        return self.exact.get(self.coder.text(anchor) if isinstance(anchor, str) else anchor)

    def best(self, code: int) -> tuple[int, int]:
        """(differences, anchor) of the closest anchor with fewer than `near` differences, ties to the least anchor; else (near, 0)."""
        if code < 0 or not self.near:
            return self.near, 0
        if code in self.exact:
            return 0, code
        masks, low = self._of(code)
        bits, best = self.coder.bits, (self.near, 0)
        for i, mask in masks:
            for other in self.parts.get((i, code & mask), ()):
                x = off = other ^ code
                for k in range(1, bits):
                    off |= x >> k
                n = (off & low).bit_count()
                if n <= best[0] and (n, other) < best:
                    best = (n, other)
        return best

    def nearest(self, anchor: str | int) -> tuple[object | None, int]:
        """(cluster, differences) of what best() finds; else (None, near)."""
        off, found = self.best(self.coder.text(anchor) if isinstance(anchor, str) else anchor)
        return (self.exact[found], off) if off < self.near else (None, self.near)


class AnchorTable:
    """Anchors of one depth in order under each of their parts, for lookups of many anchors at a time. Anchors of -1 are left out.

    places: of the anchors in the array that was given.
    """

    def __init__(self, codes: np.ndarray, near: int, depth: int, coder: Coder):
        self.near, self.depth, self.bits = near, depth, coder.bits
        self.places = np.flatnonzero(codes >= 0)
        self.codes = codes[self.places]
        self.parts = []
        for _, mask in parts_of(depth, near, coder.bits):
            keys = self.codes & mask
            order = np.argsort(keys, kind="stable")
            self.parts.append((mask, keys[order], order))

    def pairs(self, asked: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What is asked, where in codes, and the differences, if fewer than `near`; about `most` are compared at a time. A pair may come again."""
        if not len(self.codes) or not self.near:
            return
        real = np.flatnonzero(asked >= 0)
        for mask, keys, order in self.parts:
            low = np.searchsorted(keys, asked[real] & mask)
            n = np.searchsorted(keys, asked[real] & mask, "right") - low
            rows, low, n = real[n > 0], low[n > 0], n[n > 0]
            ends, a = np.cumsum(n), 0
            while a < len(rows):
                b = max(a + 1, int(np.searchsorted(ends, most + (ends[a - 1] if a else 0), "right")))
                size = n[a:b]
                at = order[np.arange(size.sum()) + np.repeat(low[a:b] - (np.cumsum(size) - size), size)]
                row = np.repeat(rows[a:b], size)
                off = np.bitwise_count(differing(self.codes[at] ^ asked[row], self.bits, self.depth))
                near = off < self.near
                yield row[near], at[near], off[near].astype(np.int64)
                a = b

    def nearest(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in codes the closest anchor of each is, ties to the first, and the differences: `near` where none has fewer."""
        n = max(1, len(self.codes))
        best = np.full(len(asked), self.near * n, np.int64)
        for row, at, off in self.pairs(asked):
            np.minimum.at(best, row, off * n + at)
        return best % n, best // n
