"""A compact n-gram trie: Elias-Fano levels with quantised probabilities in one memory-mapped file."""

from __future__ import annotations

import json
import mmap

import numpy as np

_POP = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)
#: Place of the r-th set bit (from the lowest) of a byte.
_SELECT = np.zeros((256, 8), dtype=np.uint8)
for _b in range(256):
    for _r, _at in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _r] = _at


class EliasFano:
    """A nondecreasing sequence: low bits packed, high bits in unary, with a count of ones for every 64 bits."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        if width:
            bits = np.empty((n, width), dtype=np.uint8)
            for k in range(width):
                bits[:, k] = (v >> np.uint64(k)).astype(np.uint8) & 1
            packed = np.packbits(bits.ravel(), bitorder="little")
        else:
            packed = np.zeros(0, dtype=np.uint8)
        low = np.zeros(len(packed) // 8 + 2, dtype=np.uint64)
        low.view(np.uint8)[: len(packed)] = packed
        unary = np.zeros(-(-(n + (top >> width) + 2) // 64) * 64, dtype=np.uint8)
        unary[(v >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_POP[high].reshape(-1, 8).sum(axis=1, dtype=np.uint32))[:-1]]).astype(np.uint32)
        return EliasFano(n, width, low, high, ones)

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th (from 0) one or zero of the high bits."""
        before = self.ones.astype(np.int64) if bit else np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(before, k, side="right") - 1
        rest = (k - before[word]).astype(np.int64)
        octets = self.high.reshape(-1, 8)[word]
        if not bit:
            octets = ~octets
        upto = np.cumsum(_POP[octets], axis=1, dtype=np.int64)
        at = (upto <= rest[:, None]).sum(axis=1)
        row = np.arange(len(k))
        skipped = np.where(at > 0, upto[row, np.maximum(at - 1, 0)], 0)
        return word * 64 + at * 8 + _SELECT[octets[row, at], rest - skipped]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.width)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        right = self.low[word] >> off
        left = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (right | left) & np.uint64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.int64)
        if not len(i):
            return np.zeros(0, dtype=np.uint64)
        return ((self._select(i, 1) - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def successor(self, v: np.ndarray) -> np.ndarray:
        """For each value the first place that holds it or more; n where none does."""
        v = np.asarray(v, dtype=np.uint64)
        if not self.n or not len(v):
            return np.zeros(len(v), dtype=np.int64)
        h = (v >> np.uint64(self.width)).astype(np.int64)
        zeros = len(self.high) * 8 - self.n
        past = h >= zeros
        h = np.minimum(h, zeros - 1)
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), 0) - np.maximum(h - 1, 0), 0)
        hi = self._select(h, 0) - h
        want = v & np.uint64((1 << self.width) - 1)
        while True:  # binary search among the elements with these high bits
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return np.where(past, self.n, np.minimum(lo, self.n))


#: Probabilities are quantised in equal steps of their logarithm, from 1 down to 10 ** -SPAN.
SPAN, STEPS = 12.0, 65535


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.rint(-np.log10(p) * (STEPS / SPAN)), 0, STEPS).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (-code.astype(np.float64) * (SPAN / STEPS))


class Level:
    """The nodes of one depth: where each parent's children begin, their ids, and their probability codes.

    Children of one parent are sorted by id. To make the whole level monotone each run of children is
    raised by the last value of the run before; ids are therefore read relative to their context.
    """

    def __init__(self, starts: EliasFano, ids: EliasFano, codes: np.ndarray):
        self.starts, self.ids, self.codes = starts, ids, codes

    @staticmethod
    def build(parents: int, parent: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> Level:
        counts = np.bincount(parent, minlength=parents)
        starts = np.concatenate([[0], np.cumsum(counts)])
        ids = np.asarray(ids, dtype=np.uint64)
        last = np.zeros(parents, dtype=np.uint64)
        some = counts > 0
        last[some] = ids[starts[1:][some] - 1] + np.uint64(1)
        base = np.concatenate([[np.uint64(0)], np.cumsum(last)[:-1]]).astype(np.uint64)
        return Level(EliasFano.build(starts), EliasFano.build(ids + base[parent]), codes)

    def find(self, parent: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The node of each (parent, id), -1 where there is none."""
        lo, hi = self.starts.get(parent).astype(np.int64), self.starts.get(parent + 1).astype(np.int64)
        base = np.where(lo > 0, self.ids.get(np.maximum(lo - 1, 0)) + np.uint64(1), np.uint64(0)) if self.ids.n else np.zeros(len(lo), dtype=np.uint64)
        target = base + np.asarray(ids, dtype=np.uint64)
        at = self.ids.successor(target)
        inside = np.flatnonzero((at >= lo) & (at < hi))
        out = np.full(len(at), -1, dtype=np.int64)
        hit = inside[self.ids.get(at[inside]) == target[inside]]
        out[hit] = at[hit]
        return out


class Trie:
    """Levels from the first word on. lookup() walks a path of ids down from the root."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @staticmethod
    def build(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Trie:
        """Each level: (parent, id, probability code), ordered by parent and id; the first has parent 0."""
        out, parents = [], 1
        for parent, ids, codes in levels:
            out.append(Level.build(parents, parent, ids, codes))
            parents = len(ids)
        return Trie(out)

    def lookup(self, *path: np.ndarray) -> np.ndarray:
        """The node of each path at its depth, -1 where the trie doesn't hold it."""
        node = np.zeros(len(path[0]), dtype=np.int64)
        for level, ids in zip(self.levels, path, strict=False):
            alive = np.flatnonzero(node >= 0)
            found = level.find(node[alive], ids[alive])
            node[alive] = found
        return node

    def arrays(self) -> list[tuple[dict, list[np.ndarray]]]:
        return [({"n": ef.n, "width": ef.width}, [ef.low, ef.high, ef.ones]) for lv in self.levels for ef in (lv.starts, lv.ids)] + [({}, [lv.codes]) for lv in self.levels]

    def layout(self) -> tuple[bytes, list[tuple[int, np.ndarray]], int]:
        """The directory of the arrays, their places (multiples of 64 bytes) and the length of all."""
        head, at, parts = [], 0, []
        for info, arrays in self.arrays():
            places = []
            for a in arrays:
                places.append((at, len(a), a.dtype.str))
                parts.append((at, a))
                at += -(-a.nbytes // 64) * 64
            head.append((info, places))
        top = json.dumps(head).encode()
        offset = -(-(len(top) + 16) // 64) * 64
        return len(top).to_bytes(8, "little") + offset.to_bytes(8, "little") + top, [(offset + place, a) for place, a in parts], offset + at

    def write(self, out, whole: tuple) -> None:
        top, parts, _ = whole
        out.seek(0)
        out.write(top)
        for place, a in parts:
            out.seek(place)
            out.write(a.tobytes())

    def save(self, path: str) -> None:
        """All arrays in one file, after a directory of them."""
        whole = self.layout()
        with open(path, "wb") as f:
            self.write(f, whole)
            f.truncate(whole[2])

    def mapped(self) -> Trie:
        """The same trie over a memory map of its own, without a file."""
        whole = self.layout()
        out = mmap.mmap(-1, max(1, whole[2]))
        self.write(out, whole)
        return Trie.over(np.frombuffer(out, dtype=np.uint8))

    @staticmethod
    def open(path: str) -> Trie:
        """The trie over a memory map of the file."""
        return Trie.over(np.memmap(path, dtype=np.uint8, mode="r"))

    @staticmethod
    def over(data: np.ndarray) -> Trie:
        """The trie in the bytes that write() has laid out."""
        size, offset = (int.from_bytes(data[k : k + 8].tobytes(), "little") for k in (0, 8))
        head = json.loads(data[16 : 16 + size].tobytes())

        def part(place: int, count: int, kind: str) -> np.ndarray:
            t = np.dtype(kind)
            return data[offset + place : offset + place + count * t.itemsize].view(t)

        depth = len(head) // 3
        efs = [EliasFano(info["n"], info["width"], *[part(*p) for p in places]) for info, places in head[: 2 * depth]]
        return Trie([Level(efs[2 * k], efs[2 * k + 1], part(*head[2 * depth + k][1][0])) for k in range(depth)])
