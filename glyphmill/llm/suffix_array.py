"""Suffix arrays of a shard by induced sorting, and where its long strings come again."""

from __future__ import annotations

import heapq

import numpy as np


class Induced:
    """Induced sorting of a byte string that ends with its only 0.

    Positions of one bucket that are known at a time are handled together: each
    wave of them induces the positions before them, dealt out to their buckets
    in order, so a scan costs one pass of array operations over the string.
    """

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        edge = np.flatnonzero(text[1:] != text[:-1])
        lengths = np.diff(np.concatenate(([-1], edge, [n - 1])))
        rising = np.append(text[edge] < text[edge + 1], True)  # the type of each run of equal bytes
        self.smaller = np.repeat(rising, lengths)
        self.lms = np.flatnonzero(self.smaller[1:] & ~self.smaller[:-1]).astype(np.int32) + 1
        size = np.bincount(text, minlength=256)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.used = np.flatnonzero(size).tolist()

    def _before(self, block: np.ndarray, smaller: bool):
        """The positions before a block's that are of the wanted type, dealt by their bytes, in order."""
        j = block[block > 0] - 1
        j = j[self.smaller[j] == smaller]
        if not len(j):
            return None
        c = self.text[j]
        order = np.argsort(c, kind="stable")
        c = c[order]
        size = np.bincount(c, minlength=256)
        return j[order], c, np.arange(len(c)) - (np.cumsum(size) - size)[c], size

    def sort(self, lms: np.ndarray) -> np.ndarray:
        """All positions in order, given the leftmost-smaller ones in an order."""
        array = np.zeros(len(self.text), np.int32)
        c = self.text[lms]
        order = np.argsort(c, kind="stable")
        size = np.bincount(c, minlength=256)
        first = self.ends - size
        array[first[c[order]] + np.arange(len(c)) - (np.cumsum(size) - size)[c[order]]] = lms[order]
        head = self.starts.copy()

        def larger(block):
            if (found := self._before(block, False)) is not None:
                j, c, rank, size = found
                array[head[c] + rank] = j
                head[:] += size

        for b in self.used:
            at = self.starts[b]
            while at < head[b]:
                at, block = head[b], array[at : head[b]]
                larger(block)
            if first[b] < self.ends[b]:
                larger(array[first[b] : self.ends[b]])
        tail = self.ends.copy()

        def smaller(block):
            if (found := self._before(block[::-1], True)) is not None:
                j, c, rank, size = found
                array[tail[c] - 1 - rank] = j
                tail[:] -= size

        for b in reversed(self.used):
            at = self.ends[b]
            while at > tail[b]:
                at, block = tail[b], array[tail[b] : at].copy()
                smaller(block)
            if self.starts[b] < head[b]:
                smaller(array[self.starts[b] : head[b]])
        array[0] = len(self.text) - 1
        return array


class Numbered:
    """The same for a string of numbers that ends with its only 0, whose buckets are many and small.

    Neighbouring buckets are handled together.  The few positions that one of
    them induces in the same group come first, one by one in the order of what
    induces them; then the group induces all others at once.
    """

    #: Groups of buckets, of about as many positions each.
    GROUPS = 64

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        edge = np.flatnonzero(text[1:] != text[:-1])
        lengths = np.diff(np.concatenate(([-1], edge, [n - 1])))
        self.smaller = np.repeat(np.append(text[edge] < text[edge + 1], True), lengths)
        self.lms = np.flatnonzero(self.smaller[1:] & ~self.smaller[:-1]).astype(np.int32) + 1
        size = np.bincount(text)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        step = max(1, n // self.GROUPS)
        cuts = np.unique(np.append(np.searchsorted(self.ends, np.arange(step, n, step)) + 1, len(size)))
        self.groups = list(zip([0, *cuts[:-1].tolist()], cuts.tolist()))

    def _before(self, array: np.ndarray, group: tuple[int, int], smaller: bool):
        """Where a group's buckets hold a position whose predecessor is of the wanted type, that predecessor, and its number."""
        lo, hi = self.starts[group[0]], self.ends[group[1] - 1]
        at = lo + np.flatnonzero(array[lo:hi] > 0)
        j = array[at] - 1
        wanted = self.smaller[j] == smaller
        return at[wanted], j[wanted], self.text[j[wanted]]

    def _induce(self, array: np.ndarray, edge: np.ndarray, smaller: bool) -> None:
        text, is_smaller, sign = self.text, self.smaller, -1 if smaller else 1
        for group in reversed(self.groups) if smaller else self.groups:
            at, j, c = self._before(array, group, smaller)
            inside = (c >= group[0]) & (c < group[1])
            if inside.any():
                waiting, more = list(zip((at[inside] * sign).tolist(), j[inside].tolist())), []
                heapq.heapify(waiting)
                while waiting:
                    _, p = heapq.heappop(waiting)
                    k = text[p]
                    to = int(edge[k]) - smaller
                    array[to] = p
                    edge[k] += sign
                    if p and is_smaller[p - 1] == smaller:
                        if group[0] <= text[p - 1] < group[1]:
                            heapq.heappush(waiting, (to * sign, p - 1))
                        else:
                            more.append((to, p - 1))
                at, j = at[~inside], j[~inside]
                if more:
                    at, j = (np.concatenate(x) for x in zip((at, j), np.array(more).T))
                    order = np.argsort(at)
                    j = j[order]
                c = text[j]
            if smaller:
                j, c = j[::-1], c[::-1]
            if len(c):
                order = np.argsort(c, kind="stable")
                c = c[order]
                new = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                size = np.diff(np.append(new, len(c)))
                rank = np.arange(len(c)) - np.repeat(new, size)
                array[edge[c] - 1 - rank if smaller else edge[c] + rank] = j[order]
                edge[c[new]] += sign * size

    def sort(self, lms: np.ndarray) -> np.ndarray:
        array = np.full(len(self.text), -1, np.int32)
        c = self.text[lms]
        order = np.argsort(c, kind="stable")
        size = np.bincount(c, minlength=len(self.ends))
        array[(self.ends - size)[c[order]] + np.arange(len(c)) - (np.cumsum(size) - size)[c[order]]] = lms[order]
        self._induce(array, self.starts.copy(), False)
        array[self.smaller[array] & (array >= 0)] = -1  # to be induced in their turn
        self._induce(array, self.ends.copy(), True)
        array[0] = len(array) - 1
        return array


def _names(text: np.ndarray, lms: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    """A number per leftmost-smaller substring (in text order), equal ones alike and in the substrings' order."""
    words, step = (_words(text), 8) if text.dtype == np.uint8 else (text, 1)
    place = np.zeros(len(text), np.int32)
    place[lms] = np.arange(len(lms))
    size = np.append(np.diff(lms) + 1, 1)[place[sorted_lms]]  # the next one's first letter included
    same = np.append(False, size[1:] == size[:-1])
    at, live = 0, np.flatnonzero(same)
    while len(live):
        left = size[live] - at
        differ = words[sorted_lms[live] + at] ^ words[sorted_lms[live - 1] + at]
        if step == 8:
            differ &= np.where(left >= 8, np.uint64(2**64 - 1), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
        differ = differ != 0
        same[live[differ]] = False
        at += step
        live = live[~differ & (left > step)]
    names = np.zeros(len(lms), np.int64)
    names[place[sorted_lms]] = np.cumsum(~same) - 1
    return names


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a string of bytes or numbers that ends with its only 0, in order.

    Suffixes are classified; leftmost-smaller substrings are sorted by induction
    from any order and named; where names repeat, the string of names, at most
    half as long, is sorted in the same way; and the order of the
    leftmost-smaller suffixes induces that of all.
    """
    induced = Induced(text) if text.dtype == np.uint8 else Numbered(text)
    lms = induced.lms
    first = induced.sort(lms)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    first = first[is_lms[first]]
    names = _names(text, lms, first)
    return induced.sort(first if names.max() == len(lms) - 1 else lms[suffix_array(names)])


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number (zeros after the end)."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    return np.lib.stride_tricks.as_strided(padded, (len(text), 8), (1, 1)).copy().view("<u8").ravel()


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its ``length``-byte windows start anywhere else in ``texts`` too.

    Texts may hold any byte but 0xFE and 0xFF.  A window comes again if and only
    if the common prefix with a neighbour in the suffix array is as long.  These
    prefixes are computed in text order (permuted), where each is at least its
    left neighbour's less one: every 16th exactly, the rest where those leave
    them open.
    """
    step = 16
    sizes = np.array([len(t) + 1 for t in texts])
    joined = np.frombuffer(b"\xff".join(texts) + b"\xff\xfe", np.uint8) + np.uint8(2)  # separators become 1, the end 0
    joined.setflags(write=True)
    n = len(joined)
    array = suffix_array(joined)
    words = _words(joined)
    before = np.empty(n, np.int32)
    before[array[1:]] = array[:-1]
    before[array[0]] = array[0]
    ends = np.cumsum(sizes) - 1  # of each text, where its separator stands
    left = np.repeat(ends, sizes) - np.arange(n - 1)
    left = np.append(left, 0)

    def common(at: np.ndarray, most: int) -> np.ndarray:
        """Bytes that positions share with their predecessors in the array, up to ``most``."""
        out = np.zeros(len(at), np.int64)
        other, live = before[at], np.arange(len(at))
        for k in range(0, most, 8):
            inside = (at[live] + k < n) & (other[live] + k < n)
            live = live[inside]
            x = words[at[live] + k] ^ words[other[live] + k]
            low = x & (~x + np.uint64(1))
            same = x == 0
            bits = np.zeros(len(x), np.int64)
            bits[~same] = np.log2(low[~same].astype(np.float64)).astype(np.int64) // 8
            out[live] = k + np.where(same, 8, bits)
            live = live[same]
            if not len(live):
                break
        return np.minimum(out, most)

    sampled = np.arange(0, n, step)
    exact = common(sampled, length + step)
    offset = np.arange(n) % step
    low = np.repeat(exact, step)[:n] - offset
    following = np.append(exact[1:], length + step)
    high = np.repeat(following, step)[:n] + step - offset
    long = low >= length
    open_ = np.flatnonzero(~long & (high >= length) & (left >= length))
    long[open_] = common(open_, length) >= length
    long &= left >= length
    again = long.copy()
    again[before[np.flatnonzero(long)]] = True
    starts = ends + 1 - sizes
    return [again[s : s + max(0, z - length)] for s, z in zip(starts.tolist(), sizes.tolist())]
