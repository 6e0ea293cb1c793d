"""Edit distance of one ASCII text to many, 64 cells a word (Myers' bit vectors in Hyyrö's blocks), for texts too long for ``levenshtein``.

The leader's characters are the bits, in blocks of 64; the others are read together, a character a step, block b one step behind
block b - 1. Only blocks are computed that an alignment within the bound can touch; outside them cells count as too large, so
a distance within its bound is exact and any other is above it.
"""

from __future__ import annotations

import numpy as np

WORD = 64
# Texts of one batch: so many words at work at once, and, beyond so few, lengths that differ by so much at most.
AT_WORK, FEW, SPREAD = 8192, 2048, 1.1
_ONE, _TOP, _FULL = np.uint64(1), np.uint64(63), np.uint64(0xFFFFFFFFFFFFFFFF)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), dtype=np.uint8)


class Leader:
    """A text that others are compared with, and where each of its characters stands."""

    def __init__(self, text: str):
        self.text, self.size, self.codes = text, len(text), codes(text)
        self.blocks = max(1, -(-self.size // WORD))
        self.bag = np.bincount(self.codes, minlength=128)
        bits = np.zeros((128, self.blocks * WORD), dtype=bool)
        bits[self.codes, np.arange(self.size)] = True
        words = np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)
        self.equal = np.ascontiguousarray(words.T).ravel()  # of block b and character c at b * 128 + c


def _batch(leader: Leader, texts: list[np.ndarray], most: int) -> np.ndarray:
    """Distances of texts in order of length, exact up to ``most``."""
    m, blocks, count = leader.size, leader.blocks, len(texts)
    lengths = np.array([len(t) for t in texts])
    n = int(lengths[-1])
    rows = np.zeros((n + 1, count), dtype=np.int64)  # row j has each text's character j, from 1; a 0 is no character of the leader
    for k, t in enumerate(texts):
        rows[1 : len(t) + 1, k] = t
    # A path that ends on diagonal d = length - m with at most ``most`` steps aside stays on diagonals from low to high.
    low, high = -((most - (int(lengths[0]) - m)) // 2) - 1, (most + (n - m)) // 2 + 1
    first = [max(1, b * WORD + 1 + low) for b in range(blocks)]  # columns in which block b is computed
    last = [min(n, (b + 1) * WORD + high) for b in range(blocks)]
    pv, mv = np.full((blocks, count), _FULL), np.zeros((blocks, count), dtype=np.uint64)
    up, down = np.zeros((blocks, count), dtype=np.uint64), np.zeros((blocks, count), dtype=np.uint64)  # what block b hands down
    score = np.zeros((blocks, count), dtype=np.int64)
    offsets = (np.arange(blocks, dtype=np.int64) * 128)[:, None]
    over = np.uint64((int(_FULL) << (m - (blocks - 1) * WORD)) & int(_FULL)) if m < blocks * WORD else np.uint64(0)
    out = np.full(count, np.iinfo(np.int64).max)
    done = 0
    while done < count and lengths[done] < first[-1]:  # ends before the last block may be entered: beyond the bound
        done += 1
    shape = (blocks, count)
    buffers = [np.empty(shape, dtype=np.uint64) for _ in range(6)]
    where = np.empty(shape, dtype=np.int64)
    b0 = b1 = 0  # blocks b0 to b1 - 1 are at work
    for s in range(1, n + blocks):
        while b1 < blocks and first[b1] + b1 <= s:
            if b1 == 0:
                score[0] = WORD + first[0] - 1
            else:  # from the block above, one column before
                score[b1] = score[b1 - 1] - up[b1 - 1].astype(np.int64) + down[b1 - 1].astype(np.int64) + WORD
            b1 += 1
        while b0 < b1 and last[b0] + b0 < s:
            b0 += 1
        if b0 == b1:
            continue
        if b0 and last[b0 - 1] + b0 < s:  # the row above is no longer known and counts as rising
            up[b0 - 1], down[b0 - 1] = _ONE, 0
        k = b1 - b0
        eq, xv, xh, ph, mh, t = (x[:k] for x in buffers)
        p, q = pv[b0:b1], mv[b0:b1]
        np.add(rows[s - b1 + 1 : s - b0 + 1][::-1], offsets[b0:b1], out=where[:k])
        np.take(leader.equal, where[:k], out=eq, mode="clip")
        hp, hm = np.empty((k, count), dtype=np.uint64), np.empty((k, count), dtype=np.uint64)
        hp[0], hm[0] = (up[b0 - 1], down[b0 - 1]) if b0 else (_ONE, 0)
        hp[1:], hm[1:] = up[b0 : b1 - 1], down[b0 : b1 - 1]
        np.bitwise_or(eq, q, out=xv)
        np.bitwise_or(eq, hm, out=eq)
        np.bitwise_and(eq, p, out=xh)
        np.add(xh, p, out=xh)
        np.bitwise_xor(xh, p, out=xh)
        np.bitwise_or(xh, eq, out=xh)
        np.bitwise_or(xh, p, out=t)
        np.invert(t, out=t)
        np.bitwise_or(q, t, out=ph)
        np.bitwise_and(p, xh, out=mh)
        u, d = up[b0:b1], down[b0:b1]
        np.right_shift(ph, _TOP, out=u)
        np.right_shift(mh, _TOP, out=d)
        part = score[b0:b1]
        np.add(part, u.view(np.int64), out=part)
        np.subtract(part, d.view(np.int64), out=part)
        np.left_shift(ph, _ONE, out=ph)
        np.bitwise_or(ph, hp, out=ph)
        np.left_shift(mh, _ONE, out=mh)
        np.bitwise_or(mh, hm, out=mh)
        np.bitwise_or(xv, ph, out=t)
        np.invert(t, out=t)
        np.bitwise_or(mh, t, out=p)
        np.bitwise_and(ph, xv, out=q)
        if b1 == blocks:
            j = s - blocks + 1  # the column that the last block has now
            while done < count and lengths[done] == j:
                rise = int(np.bitwise_count(pv[-1, done] & over)) - int(np.bitwise_count(mv[-1, done] & over))
                out[done] = score[-1, done] - rise
                done += 1
    return out


def near(leader: Leader, texts: list[np.ndarray], bags: np.ndarray, threshold: float) -> np.ndarray:
    """Which texts are within ``threshold`` of the leader, as a share of the longer one's length."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    longest = np.maximum(sizes, leader.size)
    most = np.floor(longest * threshold + 1e-9).astype(np.int64)
    differ = bags - leader.bag
    least = np.maximum(np.where(differ > 0, differ, 0).sum(axis=1), np.where(differ < 0, -differ, 0).sum(axis=1))
    out = (longest == 0) | ((least == longest) & (threshold >= 1))
    asked = np.flatnonzero((least <= most) & (least < longest))
    asked = asked[np.argsort(sizes[asked], kind="stable")]
    at = 0
    while at < len(asked):
        size = int(sizes[asked[at]])
        each = (int(most[asked[at]]) + 2 * WORD) / WORD  # words at work for a text, about
        alike = int(np.searchsorted(sizes[asked[at : at + max(int(AT_WORK / each), 1)]], max(size * SPREAD, size + 16), side="right"))
        end = min(len(asked), at + max(alike, int(FEW / each)))
        some = asked[at:end]
        distance = _batch(leader, [texts[i] for i in some], int(most[some].max()))
        out[some] = (distance <= most[some]) & (distance / longest[some] <= threshold)
        at = end
    return out


def first_near(leaders: list[Leader], texts: list[str], threshold: float) -> np.ndarray:
    """For each text the place of the first leader near enough, -1 if none is."""
    read = [codes(t) for t in texts]
    bags = np.zeros((len(read), 128), dtype=np.int64)
    for k, t in enumerate(read):
        bags[k] = np.bincount(t, minlength=128)
    out = np.full(len(read), -1, dtype=np.int32)
    left = np.arange(len(read))
    for place, leader in enumerate(leaders):
        if not len(left):
            break
        hit = near(leader, [read[i] for i in left], bags[left], threshold)
        out[left[hit]] = place
        left = left[~hit]
    return out
