"""Byte-pair merges of many words at once, from a tokenizer's file: always the pair of lowest rank, the leftmost of equals."""

from __future__ import annotations

import json

import numpy as np

NONE = np.int32(2**31 - 1)
_K = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary: itself if it prints, else the next free one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(0x100 + rest.index(b)) for b in range(256)]


class Merges:
    """Ids of words given as bytes; suffix is what the last letter of a word carries."""

    LONGEST = 512  # symbols; longer words are merged one by one

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = len(pairs)
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.ranks = keys[order], np.arange(len(pairs), dtype=np.int32)[order]
        self.first = np.searchsorted(slot[order], np.arange((1 << 18) + 1))
        self.deep = int(np.diff(self.first).max())

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * _K) >> np.uint64(46)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE if a pair doesn't merge. Negative ids never do."""
        out = np.full(len(a), NONE, np.int32)
        of = np.flatnonzero((a >= 0) & (b >= 0))
        keys = (a[of].astype(np.uint64) << np.uint64(20)) | b[of].astype(np.uint64)
        slot = self._slot(keys)
        at, end = self.first[slot], self.first[slot + 1]
        for _ in range(self.deep):
            on = at < end
            of, keys, at, end = of[on], keys[on], at[on], end[on]
            if not len(of):
                break
            hit = self.keys[at] == keys
            out[of[hit]] = self.ranks[at[hit]]
            of, keys, at, end = of[~hit], keys[~hit], at[~hit] + 1, end[~hit]
        return out

    def _matrix(self, ids: np.ndarray) -> np.ndarray:
        """ids: a row of symbols for each word, -1 after its end; merged until nothing merges."""
        n, width = ids.shape
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        of = np.arange(n)
        done = ids
        place = np.arange(width)
        while len(of):
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(of)), at]
            on = low != NONE
            if not on.all():
                done[of[~on]] = ids[~on] if ids is not done else done[of[~on]]
                of, ids, ranks, at, low = of[on], ids[on], ranks[on], at[on], low[on]
                if not len(of):
                    break
            row = np.arange(len(of))
            take = np.minimum(place + (place > at[:, None]), width)
            ids = np.take_along_axis(np.column_stack([ids, np.full(len(of), -1, np.int32)]), take, 1)
            ranks = np.take_along_axis(np.column_stack([ranks, np.full(len(of), NONE)]), take, 1)
            ids[row, at] = self.merged[low]
            after = np.where(at + 1 < width, ids[row, np.minimum(at + 1, width - 1)], -1)
            ranks[row, at] = self.rank(ids[row, at], after)
            has = at > 0
            ranks[row[has], at[has] - 1] = self.rank(ids[row[has], at[has] - 1], ids[row[has], at[has]])
        return done

    def _one(self, symbols: list[int]) -> list[int]:
        """The same for one long word: a heap of pairs over a linked list."""
        import heapq

        n = len(symbols)
        after, before, live = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            r = int(self.rank(np.array([symbols[i]]), np.array([symbols[j]]))[0])
            if r != NONE:
                heapq.heappush(heap, (r, i, symbols[i], symbols[j]))

        first = self.rank(np.array(symbols[:-1]), np.array(symbols[1:]))
        heap = [(int(first[i]), i, symbols[i], symbols[i + 1]) for i in np.flatnonzero(first != NONE).tolist()]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], live[j], after[i] = int(self.merged[r]), False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return [s for s, on in zip(symbols, live, strict=True) if on]

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (none empty) as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        for at in range(0, len(words), 4096):
            own = order[at : at + 4096]
            short = own[size[own] <= self.LONGEST]
            for i in own[len(short) :].tolist():
                raw = np.frombuffer(words[i], np.uint8)
                out[i] = np.array(self._one([*self.inner[raw[:-1]].tolist(), int(self.last[raw[-1]])]), "<u4").tobytes()
            if not len(short):
                continue
            n, width = size[short], int(size[short].max())
            raw = np.frombuffer(b"".join([words[i] for i in short.tolist()]), np.uint8)
            mask = np.arange(width) < n[:, None]
            ids = np.full(mask.shape, -1, np.int32)
            ids[mask] = self.inner[raw]
            ids[np.arange(len(short)), n - 1] = self.last[raw[np.cumsum(n) - 1]]
            ids = self._matrix(ids)
            kept = ids >= 0
            data, ends = ids[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
            for i, a, b in zip(short.tolist(), [0, *ends], ends):
                out[i] = data[a:b]
        return out
