"""A run-length index of passages: the run-compressed Burrows-Wheeler transform of
their concatenation, with the suffix array kept only at both ends of each run.

Each passage ends with the byte END, which no UTF-8 text holds; suffixes compare up to
it, then by the passages' order. `statistics` streams texts through the index from
right to left, all of them in step: a text's state is a row of the transform, its place
in the passages and the length of the longest match there. A byte that is the row's own
extends the match through the LF mapping. Another one moves to the nearest run of that
byte before or after the row, whichever shares more with the match; a run's sampled end
says where that is in the passages, so what is shared is read off there. Lengths are
exact up to MOST; longer ones count as MOST.

`first` has the least document of each string of WINDOW bytes, by its rows' interval."""

from __future__ import annotations

import numpy as np

WINDOW = 50
END = 0xFF
#: Lengths of matches are told apart up to so many bytes.
MOST = 56


def joined(passages: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All passages, each closed by END, and where each begins."""
    size = np.array([len(x) + 1 for x in passages], np.int64)
    return np.frombuffer(bytes([END]).join([*passages, b""]), np.uint8), np.cumsum(size) - size


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    key = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        key = (key[:-step] << np.uint64(8 * step)) | key[step:]
    return key


def suffix_order(key: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, by sorted prefixes of 8, 16, 32, ... bytes of those that are still equal; and each suffix's rank
    by its first 32 bytes. key: their first eight bytes; rest: bytes before the next END."""
    n, key = len(key), key.copy()
    short = rest < 8
    key[short] &= ~np.uint64(0) << (np.uint64(8) * (7 - rest[short]).astype(np.uint64))
    order = np.argsort(key)
    ordered = key[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, np.diff(start, append=n))
    early, tied, depth = None, np.arange(n), 8
    while True:
        if depth == 32:
            early = rank.copy()
        group = rank[order[tied]]
        alike = group[1:] == group[:-1]
        tied = tied[np.concatenate([[False], alike]) | np.concatenate([alike, [False]])] if len(group) else tied
        if not len(tied):
            return order, rank if early is None else early
        at = order[tied]
        # a suffix that has ended by now is told apart by its place
        after = np.where(rest[at] < depth, at, rank[np.minimum(at + depth, n - 1)])
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rank[at] = np.repeat(tied[first], np.diff(first, append=len(at)))
        depth *= 2


class Marks:
    """Marked places among n, as bits with sums of the words before: how many are at or before a place."""

    def __init__(self, places: np.ndarray, n: int):
        bits = np.zeros(-(-n // 64) * 64, np.uint8)
        bits[places] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def upto(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = ~np.uint64(0) >> (np.uint64(63) - (at & 63).astype(np.uint64))
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class RunIndex:
    def __init__(self, passages: list[bytes], docs: np.ndarray):
        """docs: the least document that holds each passage."""
        self.data, begin = joined(passages)
        n = len(self.data)
        if not n:
            self.first = np.zeros(0, np.int64)
            return
        passage = np.repeat(np.arange(len(passages)), np.diff(begin, append=n))
        end = np.append(begin[1:], n) - 1
        rest = end[passage] - np.arange(n)
        self.eight = eights(self.data)
        order, rank = suffix_order(self.eight, rest)
        self.view = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.data, np.full(MOST, END, np.uint8)]), MOST)

        last = self.data[order - 1]  # the byte before each suffix
        self.start = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        self.starts = Marks(self.start, n)
        stop = np.append(self.start[1:], n)
        self.head = last[self.start]
        self.first_place, self.last_place, self.last_row = order[self.start], order[stop - 1], stop - 1
        # LF moves all rows of a run alike; the first goes to: bytes that are less, and equal ones in runs before
        by = np.argsort(self.head, kind="stable")
        size = (stop - self.start)[by]
        self.move = np.empty(len(by), np.int64)
        self.move[by] = np.cumsum(size) - size
        self.move -= self.start
        self.run_of_byte, self.of_byte = by, self.head[by].astype(np.int64) * len(by) + by

        whole = np.flatnonzero(rest[order] >= WINDOW)
        at = order[whole]
        far = rank[np.minimum(at + WINDOW - 32, n - 1)]  # both halves equal: all WINDOW bytes are
        new = np.flatnonzero(np.concatenate([[True], (rank[at[1:]] != rank[at[:-1]]) | (far[1:] != far[:-1])])) if len(at) else at
        self.interval = Marks(whole[new], n)
        self.first = np.minimum.reduceat(docs[passage[at]], new) if len(at) else np.zeros(0, np.int64)

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal bytes from places a and b on, up to MOST."""
        differ = self.eight[a] ^ self.eight[b]
        out = np.zeros(len(a), np.int64)
        for bits in range(8, 72, 8):
            out += differ < np.uint64(1 << 64 - bits) if bits < 64 else differ == 0
        long = np.flatnonzero(out == 8)
        other = self.view[a[long]] != self.view[b[long]]
        out[long] = np.where(other.any(axis=1), other.argmax(axis=1), MOST)
        return out

    def statistics(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of the texts, one after the other: length of the longest match from there on, and its row."""
        size = np.array([len(t) for t in texts], np.int64)
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size)
        lengths, rows = np.zeros(len(data), np.int8), np.zeros(len(data), np.int64)
        by = np.argsort(-size, kind="stable")
        less, ends = -size[by], ends[by]
        row, place, length = (np.zeros(len(by), np.int64) for _ in range(3))
        place[:] = self.first_place[0]
        runs = len(self.start)
        for step in range(1, int(size.max(initial=0)) + 1):
            active = int(np.searchsorted(less, -step, side="right"))
            row, place, length = row[:active], place[:active], length[:active]
            at = ends[:active] - step
            byte = data[at]
            run = self.starts.upto(row) - 1
            length += 1
            other = np.flatnonzero(self.head[run] != byte)
            lost = other[:0]
            if len(other):
                theirs = byte[other]
                after = np.searchsorted(self.of_byte, theirs.astype(np.int64) * runs + run[other])
                best, new_run, new_row, new_place = (np.full(len(other), -1, np.int64) for _ in range(4))
                for side, where, places in ((after, self.start, self.first_place), (after - 1, self.last_row, self.last_place)):
                    have = np.flatnonzero((side >= 0) & (side < runs))
                    found = self.run_of_byte[side[have]]
                    same = self.head[found] == theirs[have]
                    have, found = have[same], found[same]
                    shared = np.minimum(self._shared(place[other[have]], places[found]), length[other[have]] - 1)
                    better = shared > best[have]
                    mine, found = have[better], found[better]
                    best[mine], new_run[mine], new_row[mine], new_place[mine] = shared[better], found, where[found], places[found]
                met = best >= 0
                length[other] = best + 1  # 0 where the byte is nowhere
                moved, lost = other[met], other[~met]
                run[moved], row[moved], place[moved] = new_run[met], new_row[met], new_place[met]
            np.minimum(length, MOST, out=length)
            held = row[lost], place[lost]
            row += self.move[run]
            place -= 1
            row[lost], place[lost] = held
            lengths[at], rows[at] = length, row
        return lengths, rows

    def least_document(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each place of the texts where a string of WINDOW bytes begins that is in the index: the place, and the least
        document that holds the string."""
        if not len(self.data) or not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths, rows = self.statistics(texts)
        hit = np.flatnonzero(lengths >= WINDOW)
        return hit, self.first[self.interval.upto(rows[hit]) - 1]
