"""Periodic runs of words, found by block convolutions.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal) of at least ``max(LEAST, POWER * q)`` words that no neighbour extends.

At scale L = 1, 2, 4, ... the text is cut into blocks of L words, and each block
is looked for at the distances L to 2L - 1 behind it.  The sum of the squared
differences between the block and the words at distance d is

    sum block^2 + sum window^2 - 2 * correlation(block, window)[d],

the correlation by a number-theoretic transform modulo ``PRIME``, in integers.
It is zero wherever the words agree, and the few zeros that the modulus may add
are met by the comparison of words below.  A run of period q in [L, 2L) holds
at least ``(need - L + 1) // L`` blocks in a row that agree at distance q, need
being the pairs of words q apart in the shortest such run; shorter rows of
blocks are no seeds.  A seed is extended word by word, less than L words to
each side, since the next block disagrees.  A seed inside a run of a
smaller period (found at an earlier scale) is a multiple of that period and
gives nothing new.  So a text of n words costs O(n log^2 n), whatever it repeats.

Cases: a null, empty or blank text has no words, no runs and collapses to the
empty text; texts of any length are searched whole; equal rows get equal
results; an empty table gives an empty result; further columns pass through,
and one named like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskframe.llm.common import with_columns_from
from riskframe.llm.words import split_words

#: Least words and least repetitions of a run.
LEAST, POWER = 6, 4
#: 15 * 2^27 + 1 with the primitive root 31: transforms of up to 2^27 words.
PRIME, ROOT = 2_013_265_921, 31
#: Words searched together (one text may have more).
TOGETHER = 131_072

_P = np.uint64(PRIME)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def roots(n: int, inverse: bool) -> np.ndarray:
    """Powers 0 to n/2 - 1 of an n-th root of unity, as a column."""
    if (n, inverse) not in _POWERS:
        w = pow(ROOT, (PRIME - 1) // n, PRIME)
        w = pow(w, PRIME - 2, PRIME) if inverse else w
        out = np.ones(max(n // 2, 1), np.uint64)
        have = 1
        while have < len(out):                       # doubled: w^(have + i) = w^have * w^i
            out[have:2 * have] = out[:have] * np.uint64(pow(w, have, PRIME)) % _P
            have *= 2
        _POWERS[n, inverse] = out[:, None]
    return _POWERS[n, inverse]


def transform(x: np.ndarray, stride: int = 1, inverse: bool = False) -> np.ndarray:
    """Transform along the first axis, in natural order and unscaled.  With
    ``stride`` 2 the first of the halving steps has already been done."""
    size, batch = x.shape
    n, spare, tmp = size // stride, np.empty_like(x), np.empty((2, x.size // 2), np.uint64)
    while n > 1:
        half = n // 2
        a, b = x.reshape(2, half, -1)
        y, (t, u) = spare.reshape(half, 2, -1), tmp.reshape(2, half, -1)
        np.add(a, b, out=t)
        np.subtract(t, _P, out=u)                    # below zero it wraps to a huge number
        np.minimum(t, u, out=y[:, 0])
        np.add(a, _P, out=t)
        np.subtract(t, b, out=t)
        np.multiply(t, roots(n, inverse), out=t)
        np.remainder(t, _P, out=t)
        y[:, 1] = t
        x, spare, n = spare, x, half
    return x.reshape(size, batch)


def agreeing_blocks(y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distances (less ``size``) and numbers of the blocks of ``y`` that have no
    mismatch at that distance, in order of distance and block; the number of
    blocks."""
    blocks = -(-len(y) // size)
    padded = np.zeros((blocks + 2) * size, np.uint64)
    padded[:len(y)] = y
    spread = np.empty((size, 2, blocks + 2), np.uint64)    # first step: the second half is zero
    spread[:, 0] = padded.reshape(-1, size).T
    np.multiply(spread[:, 0], roots(2 * size, False), out=spread[:, 1])
    np.remainder(spread[:, 1], _P, out=spread[:, 1])
    own = transform(spread.reshape(2 * size, -1), stride=2)
    # the window behind a block is the next two blocks: their sum, the second one shifted by L
    window = own[:, 1:-1].copy()
    window[0::2] += own[0::2, 2:]
    window[1::2] += _P - own[1::2, 2:]
    window %= _P
    window *= np.roll(own[::-1, :-2], 1, axis=0)           # reversed: correlation
    window %= _P
    found = transform(window, inverse=True)[:size]         # 2L times the correlation
    squares = np.zeros(len(padded) + 1, np.uint64)
    np.cumsum(padded * padded % _P, out=squares[1:])
    sums = squares[size:] - squares[:-size]
    total = sums[size:size + blocks * size].reshape(blocks, size).T + sums[0:blocks * size:size]
    total %= _P
    total *= np.uint64(size)
    total %= _P
    at = np.flatnonzero(total == found)
    return at // blocks, at % blocks, blocks


class Covered:
    """Runs found so far, by start, with the greatest end up to each of them."""

    def __init__(self) -> None:
        self.runs = [np.zeros(0, np.int64)] * 3

    def add(self, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> None:
        joined = [np.concatenate(x) for x in zip(self.runs, (starts, ends, periods))]
        order = np.lexsort((joined[2], joined[0]))
        self.runs = [x[order] for x in joined]
        self.most = np.maximum.accumulate(self.runs[1])

    def holds(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether some run spans each of the stretches."""
        if not len(self.runs[0]):
            return np.zeros(len(starts), bool)
        at = np.searchsorted(self.runs[0], starts, "right") - 1
        return (at >= 0) & (self.most[np.maximum(at, 0)] >= ends)


def needed(period: np.ndarray) -> np.ndarray:
    """Pairs of words a period apart in the shortest run of that period."""
    return np.maximum(LEAST, POWER * period) - period


def find_runs(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs of texts put end to end, in order of
    start and period.  ``codes``: a number from 1 for each distinct word of each
    text (texts share none); ``sizes``: words per text."""
    known = Covered()
    y, texts = codes.astype(np.uint64), sizes.astype(np.int64)
    shift = np.zeros(len(texts), np.int64)           # of a text's place in codes against y
    size = 1
    while True:
        stay = texts >= max(LEAST, POWER * size)
        if not stay.all():
            starts = np.cumsum(texts) - texts
            y = y[np.repeat(stay, texts)]
            shift = (starts + shift)[stay] - (np.cumsum(texts[stay]) - texts[stay])
            texts = texts[stay]
        if not len(texts):
            return known.runs[0], known.runs[1], known.runs[2]
        lag, block, blocks = agreeing_blocks(y, size)
        if len(lag):
            extend(y, texts, shift, size, lag, block, blocks, known)
        size *= 2


def extend(y: np.ndarray, texts: np.ndarray, shift: np.ndarray, size: int, lag: np.ndarray,
           block: np.ndarray, blocks: int, known: Covered) -> None:
    """Add the runs that the agreeing blocks of one scale belong to."""
    flat = lag * blocks + block
    first = np.flatnonzero(np.r_[True, (np.diff(flat) != 1) | (block[1:] == 0)])
    count = np.diff(np.r_[first, len(flat)])
    period = lag[first] + size
    left = block[first] * size
    ends = np.cumsum(texts)
    text = np.minimum(np.searchsorted(ends, left, "right"), len(texts) - 1)
    right = left + count * size
    seed = count >= (needed(period) - size + 1) // size
    seed &= ~known.holds(left + shift[text], right + period + shift[text])
    period, left, right, text = period[seed], left[seed], right[seed], text[seed]
    low = np.maximum(left - size + 1, (ends - texts)[text])
    high = np.minimum(right + size - 1, ends[text] - period)
    n = np.maximum(high - low, 0)
    if not n.sum():
        return
    at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
    of = np.repeat(np.arange(len(n)), n)
    equal = y[at] == y[at + period[of]]
    border = np.r_[True, of[1:] != of[:-1]]
    begin = np.flatnonzero(equal & (border | ~np.r_[False, equal[:-1]]))
    end = np.flatnonzero(equal & (np.r_[border[1:], True] | ~np.r_[equal[1:], False]))
    q = period[of[begin]]
    start = at[begin] + shift[text[of[begin]]]
    stop = start + end - begin + 1 + q
    good = (end - begin + 1 >= needed(q)) & ~known.holds(start, stop)
    if good.any():
        known.add(start[good], stop[good], q[good])


def batch_runs(texts: list[str | None]) -> tuple[list[list[bytes]], list, np.ndarray]:
    """Words of each text, the runs of each (start, length, period; word numbers
    of its own), and for all words in a row whether they repeat a period."""
    words = [split_words(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    codes, have = [], 1
    for w in words:
        table: dict[bytes, int] = {}
        codes += [table.setdefault(x, have + len(table)) for x in w]
        have += len(table)
    start, stop, period = find_runs(np.array(codes, np.int64), sizes)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, stop, -1)
    of = np.searchsorted(ends, start, "right")
    own = start - (ends - sizes)[of] if len(of) else start
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    return words, [cuts, own, stop - start, period], np.cumsum(change[:-1]) > 0


def runs(docs: DataFrame, text: str = "text", found: str = "runs", collapsed: str = "collapsed",
         n_words: str = "n_words", keep: list[str] | None = None) -> DataFrame:
    """``docs`` plus the runs of ``text`` (array of start, length and period, in
    order of start and period), the words left when each run keeps its first
    period only (joined by spaces), and the number of words.  ``keep`` names the
    columns that pass through, by default all."""
    def start() -> Callable[[pa.Array], list[pa.Array]]:
        def work(column: pa.Array) -> list[pa.Array]:
            texts, out, left = column.to_pylist(), [], []
            counts: list[int] = []
            while texts:
                held, n = 0, 0
                while n < len(texts) and (not n or held < TOGETHER):
                    held += len(texts[n] or "") // 4
                    n += 1
                words, found_runs, drop = batch_runs(texts[:n])
                texts = texts[n:]
                out.append(found_runs)
                counts += map(len, words)
                at = 0
                for w in words:
                    gone = drop[at:at + len(w)]
                    if gone.any():
                        w = [x for x, g in zip(w, gone.tolist()) if not g]
                    at += len(gone)
                    left.append(b" ".join(w).decode())
            cuts, total = [np.zeros(1, np.int64)], 0
            for x in out:
                cuts.append(x[0][1:] + total)
                total += len(x[1])
            values = [pa.array(np.concatenate([x[k] for x in out]).astype(np.int64))
                      for k in (1, 2, 3)]
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(cuts).astype(np.int32)),
                pa.StructArray.from_arrays(values, ["start", "length", "period"]))
            return [lists, pa.array(left, pa.string()), pa.array(counts, pa.int64())]

        return work

    one = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    return with_columns_from(docs, text, [
        T.StructField(found, T.ArrayType(one)), T.StructField(collapsed, T.StringType()),
        T.StructField(n_words, T.LongType())], start, keep)
