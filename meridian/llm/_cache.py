"""Hash tables over whole arrays: a fixed lookup, and a bounded cache of token-id lists, one in each Python worker."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np

from meridian.llm import _text as T

_FREE = 0xFFFFFFFFFFFFFFFF


class Lookup:
    """Values by 64-bit key with open addressing, built and read by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing):
        bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.shift, self.missing = T.U64(64 - bits), values.dtype.type(missing)
        self.slots = np.full(1 << bits, _FREE, np.uint64)
        self.values = np.full(1 << bits, missing, values.dtype)
        left, v, slot = keys, values, self._slot(keys)
        while len(left):
            free = self.slots[slot] == T.U64(_FREE)
            self.slots[slot[free]] = left[free]
            won = self.slots[slot] == left
            self.values[slot[won]] = v[won]
            left, v, slot = left[~won], v[~won], (slot[~won] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (T.mix(keys) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.missing)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            seen = self.slots[slot]
            hit = seen == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (seen != T.U64(_FREE))
            left, slot = left[go], (slot[go] + 1) & (len(self.slots) - 1)
        return out


class IdCache:
    """Token ids by the bytes of a word. When it is full it starts anew, so its memory is bounded."""

    def __init__(self, most: int = 1 << 20, dtype=np.uint16, most_bytes: int = 1 << 25):
        self.most, self.dtype, self.most_bytes = most, dtype, most_bytes
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.bytes = 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, self.dtype), 0

    def slots(self, words: list[bytes], make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The slots of distinct words. make(indexes of new words) gives their flat ids and the number for each."""
        if len(self.slot) > self.most or self.bytes > self.most_bytes:
            self.forget()
        slot = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slot < 0)
        if len(new):
            ids, n = make(new)
            had = len(self.slot)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
            while had + len(new) > len(self.start):
                self.start, self.size = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.size, np.zeros_like(self.size)]
            self.ids[self.used : self.used + len(ids)] = ids
            self.start[had : had + len(new)] = self.used + np.cumsum(n) - n
            self.size[had : had + len(new)] = n
            self.used += len(ids)
            slot[new] = np.arange(had, had + len(new))
            fresh = [words[i] for i in new]
            self.bytes += sum(map(len, fresh))
            self.slot.update(zip(fresh, slot[new].tolist(), strict=True))
        return slot

    def join(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slots one after another, and the offset of each."""
        n = self.size[slot]
        to = np.r_[0, np.cumsum(n)]
        return self.ids[np.arange(to[-1]) + np.repeat(self.start[slot] - to[:-1], n)], to
