"""Short pieces of texts as integers: a table of their ids, and byte-pair merging of many words at once.

The key of a piece is two integers: its first eight bytes, and its next seven with its size in the top byte.  They are the
whole of a piece of up to ``SHORT`` bytes, so no two pieces have the same key, and nothing rests on a hash alone.
"""

from __future__ import annotations

import numpy as np

SHORT = 15
"""Bytes of a piece that its key holds."""
WORDS = 16_384
"""Words that are merged side by side."""
_NO_RANK, _NEVER, _32 = 1 << 26, 1 << 30, np.uint64(32)
_MASKS = [np.array([(1 << 8 * min(max(n - k, 0), 8 - (k > 0))) - 1 for n in range(17)], np.uint64) for k in (0, 8)]


def keys_of(raw: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key of each piece, and its size, at most one more than ``SHORT``."""
    n = np.minimum(ends - begins, SHORT + 1)
    eights = np.ndarray(len(raw) + 9, "<u8", raw + bytes(16), strides=(1,))
    return eights[begins] & _MASKS[0][n], eights[begins + 8] & _MASKS[1][n] | n.astype(np.uint64) << np.uint64(56), n


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = first * np.uint64(0x9E3779B97F4A7C15)
    h ^= (second ^ h >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each key, and for each place the number of its key."""
    _, of, which = np.unique(_mixed(first, second), return_index=True, return_inverse=True)
    if (first[of[which]] == first).all() and (second[of[which]] == second).all():
        return of, which
    return np.arange(len(first)), np.arange(len(first))  # two keys share a hash


class Short:
    """Where the ids of short pieces stand in the pool, by their keys; a newer one takes the slot of an older one."""

    def __init__(self, slots: int, most: int):
        self.slots, self.most = slots, most
        self.first, self.second = np.zeros(1 << slots, np.uint64), np.zeros(1 << slots, np.uint64)
        self.starts, self.sizes = np.zeros(1 << slots, np.int32), np.zeros(1 << slots, np.int8)
        self.pool, self.used = np.empty(2 * most, "<u4"), 0

    def find(self, first: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each piece begin, how many there are, or -1, and its slot."""
        if self.used > self.most:
            self.__init__(self.slots, self.most)
        slots = (_mixed(first, second) >> np.uint64(64 - self.slots)).astype(np.int64)
        there = (self.first[slots] == first) & (self.second[slots] == second) & (n <= SHORT)  # an empty slot has the key of no size
        return self.starts[slots].astype(np.int64), np.where(there, self.sizes[slots], np.int64(-1)), slots

    def keep(self, flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put ids of some pieces into the pool; starts and sizes by the numbers of the pieces."""
        starts = self.used + np.cumsum(sizes) - sizes
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], flat])
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return starts[which], sizes[which]

    def point(self, first: np.ndarray, second: np.ndarray, slots: np.ndarray, at: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Of the pieces ``at``, the first one with a slot takes it."""
        own, k = np.unique(slots[at], return_index=True)
        at = at[k]
        self.first[own], self.second[own], self.starts[own], self.sizes[own] = first[at], second[at], starts[at], sizes[at]


_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PLAIN]
_BYTES = [chr(b if b in _PLAIN else 256 + _OTHERS.index(b)) for b in range(256)]
"""The characters that stand for the bytes in the vocabulary."""


def pairs_of(file: dict) -> Pairs | None:
    """Merging of words, if the tokenizer reads a word, with or without a space before it, as one pre-token."""
    model, cut = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    whole = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not file["normalizer"]
    if not (plain and whole and all(t["special"] for t in file["added_tokens"])):
        return None
    vocab = model["vocab"]
    if max(vocab.values()) >= 1 << 16 or not vocab.keys() >= set(_BYTES):
        return None
    return Pairs(vocab, [m.split(" ") if isinstance(m, str) else m for m in model["merges"]])


class Pairs:
    """Byte-pair merging of many words at once, one merge of each word in a step: the pair of least rank, the first of equals."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.of_byte = np.array([vocab[c] for c in _BYTES], np.uint32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.uint32)
        keys, ranks = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.uint32), np.arange(len(merges), dtype=np.uint64)
        self.tables: list[tuple[np.uint32, np.uint32, np.ndarray]] = []
        while len(keys):  # what finds its slot taken goes to the next table
            bits, by = len(keys).bit_length() + 2, np.uint32((0x9E3779B1 + 0x3D4D51C2 * len(self.tables)) % 2**32)
            slots = keys * by >> np.uint32(32 - bits)
            own, k, there = np.unique(slots, return_index=True, return_counts=True)
            table = np.full(1 << bits, _NO_RANK, np.uint64)
            table[own] = keys[k].astype(np.uint64) << _32 | (there > 1).astype(np.uint64) << np.uint64(31) | ranks[k]
            self.tables.append((by, np.uint32(32 - bits), table))
            keys, ranks = np.delete(keys, k), np.delete(ranks, k)
        both = self.of_byte[np.arange(256)]
        self.of_bytes = self.ranks(np.repeat(both, 256), np.tile(both, 256))

    def ranks(self, a: np.ndarray, b: np.ndarray, table: int = 0) -> np.ndarray:
        keys = a << np.uint32(16) | b
        by, shift, entries = self.tables[table]
        found = entries[keys * by >> shift]
        hit = found >> _32 == keys
        out = np.where(hit, found & np.uint64(2**31 - 1), np.uint64(_NO_RANK)).astype(np.int32)
        more = np.flatnonzero(~hit & (found >> np.uint64(31) & np.uint64(1)).astype(bool))
        if len(more):
            out[more] = self.ranks(a[more], b[more], table + 1)
        return out

    def merge(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words with these keys one after another, and how many each has."""
        parts = [self._merge(first[at : at + WORDS], second[at : at + WORDS]) for at in range(0, len(first), WORDS)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _merge(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, n = len(first), (second >> np.uint64(56)).astype(np.int64)
        grid = np.ascontiguousarray(np.stack([first, second], axis=1).astype("<u8").view(np.uint8).reshape(m, 16).T)
        place = np.arange(16)[:, None]
        there = place < n
        ids = self.of_byte[grid].ravel()  # of the symbol that begins at each place
        best = np.full((16, m), _NEVER, np.int32)  # rank << 4 | place, of the pair that begins there
        best[:-1] = np.where(there[1:], self.of_bytes[grid[:-1].astype(np.uint16) << 8 | grid[1:]], _NO_RANK) << 4 | place[:-1]
        rows, best, there = best, best.ravel(), there.ravel()
        after = np.arange(m, 17 * m)
        before, end = after - 2 * m, n * m + np.arange(m)
        while True:
            least = rows.min(axis=0)
            j = np.flatnonzero(least < _NEVER)
            if not len(j):
                break
            least = least[j]
            at = (least & 15) * m + j
            gone = after[at]
            made = self.made[least >> 4]
            behind = after[gone]
            ids[at], after[at], there[gone], best[gone], best[at] = made, behind, False, _NEVER, _NEVER
            more = np.flatnonzero(behind < end[j])
            p, q = at[more], behind[more]
            before[q] = p
            best[p] = self.ranks(made[more], ids[q]) << 4 | least[more] & 15
            o = before[at]
            more = np.flatnonzero(o >= 0)
            o = o[more]
            best[o] = self.ranks(ids[o], made[more]) << 4 | o // m
        there = there.reshape(16, m)
        return ids.reshape(16, m).T[there.T].astype("<u4"), there.sum(axis=0)
