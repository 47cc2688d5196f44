"""InDel similarity: 200 * LCS(a, b) / (len a + len b), 100 for two empty words.

Two forms: a column expression that folds the LCS table row by row, for few
and short pairs, and a bit-parallel one over Arrow batches, which keeps a row
of the table in machine words and serves joins.
"""

from __future__ import annotations

from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(lcs: Column, a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * lcs / total)


def indel_ratio_sql(a: Column, b: Column) -> Column:
    """The similarity as a fold over the characters of both words."""
    empty = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def next_row(row: Column, x: Column) -> Column:
        start = F.array(F.lit(0))

        def step(acc: Column, j: Column) -> Column:
            same = F.substring(b, j, F.lit(1)) == x
            best = F.when(same, F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(acc, -1), F.element_at(row, j + 1)))
            return F.concat(acc, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), start, step)

    letters = F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)))
    folded = F.element_at(F.aggregate(letters, empty, next_row), -1)
    return ratio(F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(folded), a, b)


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel LCS: a row of the table is one integer, of any size. What both words
    begin and end with is common anyway, so equal texts cost one comparison."""
    if a == b:
        return len(a)
    same = len(commonprefix((a, b)))
    a, b = a[same:], b[same:]
    ends = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    return same + ends + lcs_of_rest(a[: len(a) - ends], b[: len(b) - ends])


def lcs_of_rest(a: str, b: str) -> int:
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


WIDE = 63


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, longest) code points, 0-padded, and lengths."""
    length = np.array([len(w) for w in words], np.int64)
    width = max(1, int(length.max(initial=0)))
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width), length


#: Pairs that are looked at in one step; what a step holds stays in a core's cache.
AT_ONCE = 200_000


class Words:
    """Words prepared for comparison: code points, lengths, and how often they hold
    each of 32 kinds of characters, as numbers and, up to two, as bits."""

    def __init__(self, words: list[str]):
        self.words = words
        self.points, self.length = code_points(words)
        valid = self.points != 0 if "\0" not in "".join(words) else np.arange(self.points.shape[1]) < self.length[:, None]
        at = np.repeat(np.arange(len(words)) * 32, valid.sum(1)) + (self.points[valid] & 31)
        self.counts = np.bincount(at, minlength=32 * len(words)).reshape(len(words), 32)
        bit = np.uint64(1) << np.arange(32, dtype=np.uint64)
        self.bits = ((self.counts > 0) * bit).sum(1, dtype=np.uint64) | ((self.counts > 1) * bit).sum(1, dtype=np.uint64) << np.uint64(32)


def lcs_pairs(left: Words, right: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """LCS of words left[i] (up to 63 characters) and right[j], all pairs at once."""
    own, back = np.unique(i, return_inverse=True)
    other, j = np.unique(j, return_inverse=True)
    lengths = left.length[own]
    of_l, of_r = left.points[own, : int(lengths.max(initial=1))], right.points[other]
    # characters that no left word holds have no bits
    points, code = np.unique(of_l, return_inverse=True)
    code = code.reshape(of_l.shape)
    masks = np.zeros((len(own), len(points) + 1), np.uint64)
    for k in range(of_l.shape[1]):
        some = np.flatnonzero(lengths > k)
        masks[some, code[some, k]] |= np.uint64(1) << np.uint64(k)
    found = np.minimum(np.searchsorted(points, of_r), len(points) - 1)
    found = np.where(points[found] == of_r, found, len(points)).T.copy()
    # longer right words first, so that each step goes on with fewer pairs
    order = np.argsort(-right.length[other][j], kind="stable")
    j, base, steps = j[order], back[order] * (len(points) + 1), right.length[other][j[order]]
    full = (np.uint64(1) << lengths[back[order]].astype(np.uint64)) - np.uint64(1)
    row, flat = full.copy(), masks.ravel()
    left_over = np.searchsorted(-steps, -np.arange(int(steps.max(initial=0))), "left")
    for k, n in enumerate(left_over.tolist()):
        now = row[:n]
        hit = now & flat[base[:n] + found[k][j[:n]]]
        row[:n] = (now + hit | now - hit) & full[:n]
    out = np.empty(len(order), np.int64)
    out[order] = lengths[back[order]] - np.bitwise_count(row)
    return out


def word_ratios(left: list[str], right: list[str] | Words, cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, ratio) of all pairs of distinct words at or above the cutoff.

    Lengths bound the ratio from above, and so do characters that only one of two words
    holds, so most pairs are settled by them."""
    right = right if isinstance(right, Words) else Words(right)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if not left or not right.words:
        return out[0]
    own = Words(left)
    step = max(1, AT_ONCE // len(right.words))
    share = 1.0 - cutoff / 100.0
    # both in order of length, so that a step meets words of like lengths only
    order_l, order_r = np.argsort(own.length, kind="stable"), np.argsort(right.length, kind="stable")
    length_l, length_r, bits_l, bits_r = own.length[order_l], right.length[order_r], own.bits[order_l], right.bits[order_r]
    share_l, share_r = (n.astype(np.float32) * np.float32(share) for n in (length_l, length_r))
    share_r += np.float32(0.01)
    for first in range(0, len(left), step):
        last = min(len(left), first + step)
        low = np.searchsorted(length_r, length_l[first] * cutoff / (200.0 - cutoff) - 0.01)
        high = np.searchsorted(length_r, length_l[last - 1] * (200.0 - cutoff) / cutoff + 0.01, "right") if cutoff > 0 else len(length_r)
        # characters without a partner are at most this share of both words
        lone = np.bitwise_count(bits_l[first:last, None] ^ bits_r[None, low:high])
        a, b = np.nonzero(lone <= share_l[first:last, None] + share_r[low:high])
        a, b = order_l[first + a], order_r[low + b]
        la, lb = own.length[a], right.length[b]
        on = 200 * np.minimum(la, lb) >= cutoff * (la + lb)
        a, b, la, lb = a[on], b[on], la[on], lb[on]
        lcs = np.zeros(len(a), np.int64)
        short = la <= WIDE
        if short.any():
            lcs[short] = lcs_pairs(own, right, a[short], b[short])
        far = np.flatnonzero(~short)
        if len(far):
            lone = np.concatenate([np.abs(own.counts[a[k]] - right.counts[b[k]]).sum(1) for k in np.array_split(far, 1 + len(far) // 10_000)])
            for k in far[lone <= share * (la + lb)[far] + 0.01].tolist():
                lcs[k] = lcs_length(left[a[k]], right.words[b[k]])
        both = la + lb
        r = np.where(both == 0, 100.0, 200.0 * lcs / np.maximum(both, 1))
        on = r >= cutoff
        out.append((a[on], b[on], r[on]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@F.pandas_udf(T.DoubleType())
def indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """The similarity of two columns, batch by batch; null if either is null."""
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
