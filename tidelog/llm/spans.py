"""Hashes of many stretches of bytes at once, and a cache of token ids by such hashes."""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 5


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a known finaliser)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of the hash's base and of its inverse, as far as they are needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = n + (n >> 3)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                factors = np.full(size, np.uint64(base))
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))


POWERS = Powers()
WHITE = np.zeros(256, bool)
WHITE[[*range(9, 14), 32]] = True
LETTER, MARK = np.zeros((2, 256), bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Not the apostrophe, which contractions hold, nor what special tokens hold.
MARK[list(b"!\"#$%&()*+,-./:;=?@[\\]^`{}~")] = True
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each stretch, the same in every process.

    Polynomial in the bytes' values: one running sum serves all stretches, whose shift the inverse powers undo."""
    POWERS.reach(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * POWERS.up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * POWERS.down[starts] + (ends - starts).astype(np.uint64))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lengths[0] places, then from starts[1], and so on."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(int(lengths.sum()))


def mark_cuts(raw: np.ndarray) -> np.ndarray:
    """Places of ASCII marks right after an ASCII letter: the pre-tokenizers' patterns always begin a piece there."""
    return np.flatnonzero(LETTER[raw[:-1]] & MARK[raw[1:]]) + 1


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the stretches without ASCII white space."""
    inside = np.r_[False, ~WHITE[raw], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


class IdCache:
    """Token ids by the hash of what they encode: sorted keys, and recent ones that are sorted in once they are many.

    Emptied when it holds more than `limit` ids; about 16 bytes a key and 4 an id."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = [np.empty(0, np.uint64)] * 2, [np.empty(0, np.int32)] * 2
        self.ids, self.starts, self.lengths = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32)
        self.n_ids = self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where the ids of sorted keys are; -1 if they aren't here."""
        out = np.full(len(keys), -1, np.int32)
        for known, at in zip(self.keys, self.at, strict=True):
            if len(known):
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out = np.where(known[place] == keys, at[place], out)
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Adds new sorted keys; where their ids are."""
        for name, used, more in (("ids", self.n_ids, len(ids)), ("starts", self.n, len(keys)), ("lengths", self.n, len(keys))):
            if used + more > len(old := getattr(self, name)):
                setattr(self, name, np.resize(old, max(2 * len(old), used + more)))
        at = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.starts[at], self.lengths[at] = self.n_ids + np.cumsum(lengths) - lengths, lengths
        self.n_ids, self.n = self.n_ids + len(ids), self.n + len(keys)
        self._sort_in(1, keys, at)
        if len(self.keys[1]) > max(1 << 16, len(self.keys[0]) // 4):
            self._sort_in(0, self.keys[1], self.at[1])
            self.keys[1], self.at[1] = np.empty(0, np.uint64), np.empty(0, np.int32)
        return at

    def _sort_in(self, k: int, keys: np.ndarray, at: np.ndarray) -> None:
        place = np.searchsorted(self.keys[k], keys)
        self.keys[k], self.at[k] = np.insert(self.keys[k], place, keys), np.insert(self.at[k], place, at)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids at these places, and the number of ids of each."""
        lengths = self.lengths[at].astype(np.int64)
        return self.ids[ranges(self.starts[at].astype(np.int64), lengths)], lengths

    def places(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> np.ndarray:
        """Where the ids of each stretch are; encode gets the starts and ends of distinct new ones and returns flat ids and lengths."""
        if self.n_ids > self.limit:
            self.clear()
        keys, first, inverse = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        at = self.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self.add(keys[new], *encode(starts[first[new]], ends[first[new]]))
        return at[inverse]
