"""A compressed full-text index over many short strings, and matching statistics by backward search.

The index holds the Burrows-Wheeler transform of the strings in a wavelet
matrix of packed bits. A pattern is read from right to left; where it can't be
extended any more, the match gives up characters at its right end by going to
the parent interval of the LCP tree (Ohlebusch, Gog and Kügel 2010). All
patterns take their steps together, as vectors.
"""

from __future__ import annotations

import numpy as np


def suffix_ranks(codes: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling up to ``most`` characters at least, and per power of two a labelling of the suffixes that is equal where as many characters are.

    The first sort takes four characters in one key. After that only suffixes
    that still have an equal are sorted again; a suffix's rank is the place where
    its group begins, so those of the others stay.
    """
    n = len(codes)
    sigma = int(codes.max(initial=0)) + 2
    wide = np.zeros(n + 4, np.int64)
    wide[:n] = codes + 1
    pair = wide[:-1] * sigma + wide[1:]
    labels = [wide[:n].astype(np.int32), pair[:n]]
    if sigma < 1 << 15:
        key, depth = pair[:n] * (sigma * sigma) + pair[2 : n + 2], 4
    else:
        key, depth = pair[:n], 2
        labels.pop()
    order = np.argsort(key)
    s = key[order]
    starts = np.ones(n + 1, bool)
    starts[1:n] = s[1:] != s[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts[:n], np.arange(n), 0))
    labels.append(rank.astype(np.int32))
    while depth < most:
        slots = np.flatnonzero(~(starts[:n] & starts[1:]))
        if not len(slots):
            break
        i = order[slots]
        second = np.where(i + depth < n, rank[np.minimum(i + depth, n - 1)] + 1, 0)
        key = (rank[i] << 32) | second
        o = np.argsort(key)
        i, k = i[o], key[o]
        order[slots] = i
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        starts[slots] = new
        rank[i] = slots[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
        labels.append(rank.astype(np.int32))
        depth *= 2
    return order.astype(np.int32), labels


def lcp_of_neighbours(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in order (up to the depth of ``ranks``); -1 at both ends."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(n + 1, np.int32)
    out[0] = out[n] = -1
    inner = out[1:n]
    # What lies behind the end equals nothing.
    ends = np.full(1 << len(ranks), 0, np.int32)
    for level in range(len(ranks) - 1, -1, -1):
        r = np.concatenate([ranks[level], ends])
        at_a = r[a]
        same = at_a == r[b]
        same &= (a < n) & (b < n)
        step = same.astype(np.int32) << level
        inner += step
        a += step
        b += step
    return out


def smaller_before(v: np.ndarray) -> np.ndarray:
    """For each place, the last one before it with a smaller value (-1 if none): pointers jump until they find it."""
    at = np.arange(-1, len(v) - 1, dtype=np.int32)
    todo = np.flatnonzero((at >= 0) & (v[at] >= v))
    while len(todo):
        at[todo] = at[at[todo]]
        p = at[todo]
        todo = todo[(p >= 0) & (v[p] >= v[todo])]
    return at


class Wavelet:
    """Rank of a symbol before a place, from one row of packed bits per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        n = len(symbols)
        words = (n >> 6) + 1
        self.words, self.before, self.zeros = [], [], []
        s = symbols
        for level in range(self.bits - 1, -1, -1):
            b = ((s >> level) & 1).astype(np.uint8)
            padded = np.zeros(words << 6, np.uint8)
            padded[:n] = b
            w = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(w)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(w), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(n - b.sum()))
            s = np.concatenate([s[b == 0], s[b == 1]])
        #: Where a symbol's run begins after the last level, to be taken off.
        self.base = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        for k in range(self.bits):
            w = at >> 6
            mask = (one << (at & 63).astype(np.uint64)) - one
            ones = self.before[k][w] + np.bitwise_count(self.words[k][w] & mask)
            bit = (symbol >> (self.bits - 1 - k)) & 1
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.base[symbol]


class FMIndex:
    """Index over strings that have owners: a string owned by one record (its number), or by several (below 0).

    What is kept per character is the wavelet matrix (bits of a symbol), the
    tree of LCP intervals (three integers of 32 bits) and the owners.
    """

    def __init__(self, strings: list[str], owners: np.ndarray) -> None:
        self.owners = owners.astype(np.int32)
        joined = "\0".join(strings) + "\0"
        data = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.alphabet, codes = np.unique(data, return_inverse=True)
        self.codes = codes.astype(np.uint16 if len(self.alphabet) <= 1 << 16 else np.int32)
        n = len(codes)
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]])
        order, ranks = suffix_ranks(codes, int(self.lengths.max(initial=0)) + 1)  # no string is longer, so no match is
        self.lcp = lcp_of_neighbours(order, ranks)
        del ranks
        self.smaller_left = smaller_before(self.lcp)
        self.smaller_right = len(self.lcp) - 1 - smaller_before(self.lcp[::-1])[::-1]
        self.wavelet = Wavelet(self.codes[order - 1], len(self.alphabet))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.alphabet)))[:-1]])
        self.owner = np.repeat(self.owners, self.lengths + 1)[order]
        # Where the run of one owner that begins at a place ends.
        edges = np.concatenate([[0], np.flatnonzero(self.owner[1:] != self.owner[:-1]) + 1, [n]])
        self.run_end = np.repeat(edges[1:].astype(np.int32), np.diff(edges))
        self.n = n

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the interval of the pattern with the symbol before it."""
        r = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.concatenate([self.first[symbol]] * 2)
        return r[: len(lo)], r[len(lo) :]

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval of the longest prefix of a match that occurs more often, and its length."""
        a, z = self.lcp[lo], self.lcp[hi]
        q = np.maximum(a, z)
        new_lo = np.where(a == q, self.smaller_left[lo], lo)
        new_hi = np.where(z == q, self.smaller_right[hi], hi)
        root = q <= 0
        return np.where(root, 0, new_lo), np.where(root, self.n, new_hi), np.maximum(q, 0)

    def shared(self, which: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches of at least ``least`` characters of the strings ``which`` that other records have, too: string, start, end.

        Matching statistics for each place of a string, from its last to its
        first; a string is done as soon as its match ends before ``least``,
        as no match that begins further left can be long enough. A match counts
        while some place of its interval belongs to another record; a string
        that several records own meets itself as the string of another.
        """
        own = np.where(self.owners[which] < 0, np.iinfo(np.int32).min, self.owners[which])
        at = self.lengths[which] - 1
        begin = self.starts[which]
        lo, hi, length = np.zeros(len(which), np.int64), np.full(len(which), self.n), np.zeros(len(which), np.int64)
        live = np.flatnonzero(at >= least - 1)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            place = at[live]
            c = self.codes[begin[live] + place].astype(np.int64)
            a, z = self.extend(c, lo[live], hi[live])
            first = np.minimum(a, self.n - 1)
            some = (z > a) & ((self.owner[first] != own[live]) | (self.run_end[first] < z))
            up, down = live[some], live[~some]
            lo[up], hi[up] = a[some], z[some]
            grown = length[up] + 1
            length[up] = grown
            long = grown >= least
            if long.any():
                i, p = up[long], place[some][long]
                out.append((which[i], p, p + grown[long]))
            at[up] -= 1
            if len(down):
                empty = length[down] == 0
                at[down[empty]] -= 1
                rest = down[~empty]
                lo[rest], hi[rest], length[rest] = self.parent(lo[rest], hi[rest])
            left = at[live]
            live = live[(left >= 0) & (left + 1 + length[live] >= least)]
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))
