"""An FM-index over the texts of a shard, in numpy: Burrows-Wheeler transform in a wavelet tree, backward search in
batches, and the passages of each text that also stand in another one."""

from __future__ import annotations

import numpy as np

#: Bits of a symbol in one level of the tree.
_DIGIT = 4
#: Bits below each place of a word.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletTree:
    """A sequence of small numbers as levels of digits, highest first, each level sorted stably by the digits above.

    A level has a vector of bits for each digit, in packed words, and the place in the next level of the digit's first
    occurrence from each word on; so a rank takes constant time a level.
    """

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        n = len(seq)
        self.words = n // 64 + 1
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        every = np.arange(symbols)
        for h in range(_DIGIT * ((max(1, int(symbols - 1).bit_length()) - 1) // _DIGIT), -1, -_DIGIT):
            digit = ((seq >> h) & ((1 << _DIGIT) - 1)).astype(np.uint8)
            bits = np.zeros((1 << _DIGIT, self.words * 64), bool)
            for d in range(1 << _DIGIT):
                np.equal(digit, d, out=bits[d, :n])
            packed = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
            before = np.zeros(len(packed), np.int64)  # digits one after the other: counts run on from the smaller ones
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            self.levels.append((packed, before, ((every >> h) & ((1 << _DIGIT) - 1)) * self.words))
            seq = np.concatenate([seq[b[:n]] for b in bits])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """For each pair: how often the symbol stands before position i, plus the symbol's first place in the last level.

        The offset is the same for every i, so differences of two calls are counts.
        """
        for packed, before, row in self.levels:
            k = row[symbol] + (i >> 6)
            i = before[k] + np.bitwise_count(packed[k] & _BELOW[i & 63])
        return i


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling, or tripling where three ranks fit in a number; only groups that are still equal are sorted again."""
    n = len(s)
    width = 1
    rank = s.astype(np.int64)
    base = int(rank.max()) + 2 if n else 2
    # the first eight or so symbols at once, as long as they fit in a number
    while base ** (2 * width) < 2**62 and width < 8:
        shifted = np.zeros(n, np.int64)
        shifted[: n - width] = rank[width:] + 1
        rank = rank * (base**width) + shifted
        width *= 2
    sa = np.argsort(rank)
    ordered = rank[sa]
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    parts = 3 if (n + 1) ** 3 < 2**63 else 2
    rank = np.zeros(n + 1, np.int64)  # from 1 on; 0 stands behind the end
    at = np.arange(n)
    while True:
        # the rank of a place is that of the first of its equals
        rank[sa[at]] = np.maximum.accumulate(np.where(new[at], at, 0)) + 1
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        at = at[~(new[at] & last[at])]
        if not len(at):
            return sa
        i = sa[at]
        key = rank[i]
        for k in range(1, parts):
            key = key * (n + 1) + rank[np.minimum(i + k * width, n)]
        order = np.argsort(key)
        sa[at] = i[order]
        key = key[order]
        new[at[1:]] |= key[1:] != key[:-1]
        width *= parts


class FMIndex:
    """Index over texts (arrays of code points). `owner` names the document of each text; texts of one document count
    as one place. `multi` marks texts that stand in several documents by themselves."""

    def __init__(self, texts: list[np.ndarray], owner: np.ndarray, multi: np.ndarray) -> None:
        self.lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(self.lengths + 1)
        self.firsts = ends - self.lengths - 1
        total = int(ends[-1]) if len(texts) else 0
        text = np.repeat(np.arange(len(texts)), self.lengths + 1)
        raw = np.zeros(total, np.int64)  # 0 ends each text
        inside = np.ones(total, bool)
        inside[ends - 1] = False
        if len(texts):
            raw[inside] = np.concatenate(texts)
        raw[inside] += 1
        used = np.zeros(int(raw.max()) + 1 if total else 1, bool)
        used[raw] = True
        self.alphabet = np.flatnonzero(used)
        self.s = (np.cumsum(used) - 1)[raw]
        sa = suffix_array(self.s)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.s, minlength=len(self.alphabet)))[:-1]])
        self.tree = WaveletTree(self.s[sa - 1], len(self.alphabet))
        every = np.arange(len(self.alphabet))
        self.shift = self.first - self.tree.rank(every, np.zeros_like(every))
        # the end of the run of one document from each place of the suffix array; a shared text ends its run at once
        d = np.where(inside, owner[text], -1)[sa] if total else raw
        change = np.flatnonzero(d[1:] != d[:-1]) + 1
        bounds = np.concatenate([[0], change, [total]])
        run_end = np.repeat(bounds[1:], np.diff(bounds))
        places = np.flatnonzero((inside & multi[text])[sa]) if total else change
        if len(places):
            nearest = np.repeat(np.append(places, total), np.diff(np.concatenate([[-1], places, [total - 1]])))
            run_end = np.minimum(run_end, nearest)
        self.run_end = np.append(run_end, total)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the interval of each pattern with one more symbol in front."""
        k = len(symbol)
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.shift[symbol]
        return base + both[:k], base + both[k:]

    def elsewhere(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the interval holds places of more than one document."""
        return (lo < hi) & (self.run_end[lo] < hi)

    def shared_passages(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of the stretches of each text covered by passages of `least` symbols that also stand in
        another document.

        Every text is one stream; all streams take one backward step at a time. A stream tests the passage that ends
        at x. If it fails after l symbols, no passage that contains those l + 1 can match, so x moves by least - l.
        If it matches, x moves on by `least` (the covered stretch stays whole) or to the end of the text. If that fails,
        the places between the last match and the first failure are searched, a quarter of them from the failure on, as
        failures mostly take few steps; only a failure right behind a match moves x on.
        """
        m = len(self.lengths)
        n = self.lengths
        x = np.full(m, least, np.int64)  # end of the passage under test, within the text
        kept = np.full(m, -1, np.int64)  # end of the last passage that matched and is the base of the next step
        bad = np.zeros(m, np.int64)  # end of the first passage behind it that failed, 0 if none did
        on = np.zeros(m, np.int64)  # no passage that ends from there on, but before this place, matches
        out_t: list[np.ndarray] = []
        out_e: list[np.ndarray] = []
        full = len(self.s)
        a = np.flatnonzero(n >= least)
        at = self.firsts[a] + (least - 1)
        depth = np.zeros(len(a), np.int64)
        lo = np.zeros(len(a), np.int64)
        hi = np.full(len(a), full, np.int64)
        while len(a):
            lo, hi = self.step(self.s[at], lo, hi)
            good = self.elsewhere(lo, hi)
            at -= 1
            depth += good
            done = np.flatnonzero(~good | (depth == least))
            if not len(done):
                continue
            d, hit = a[done], good[done]
            ih = d[hit]
            if len(ih):
                out_t.append(ih)
                out_e.append(x[ih])
                kept[ih] = x[ih]
            im = d[~hit]
            to = x[im] + least - depth[done[~hit]]
            # an earlier failure further on may reach further
            on[im] = np.where((bad[im] > 0) & (to >= bad[im]), np.maximum(to, on[im]), to)
            bad[im] = x[im]
            k, b = kept[d], bad[d]
            apart = (k < 0) | (b == k + 1)
            x[d] = np.where(apart, on[d], np.where(b > 0, k + np.maximum((b - k) * 3 // 4, 1), np.where(k < n[d], np.minimum(k + least, n[d]), n[d] + 1)))
            anew = d[apart]
            kept[anew] = -1
            bad[anew] = 0
            at[done] = self.firsts[d] + x[d] - 1
            depth[done] = 0
            lo[done] = 0
            hi[done] = full
            over = x[d] > n[d]
            if over.any():
                stay = np.ones(len(a), bool)
                stay[done[over]] = False
                a, at, depth, lo, hi = a[stay], at[stay], depth[stay], lo[stay], hi[stay]
        if not out_t:
            e = np.zeros(0, np.int64)
            return e, e, e
        t, e = np.concatenate(out_t), np.concatenate(out_e)
        order = np.lexsort((e, t))
        t, e = t[order], e[order]
        b = e - least
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (b[1:] > e[:-1])
        heads = np.flatnonzero(new)
        return t[heads], b[heads], e[np.append(heads[1:], len(t)) - 1]
