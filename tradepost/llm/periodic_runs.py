"""Stretches of a text that repeat the same words with a fixed period.

A run is a longest possible stretch of words in which words one period apart are equal, the period being the smallest
one of that stretch, at least two periods and ``LEAST`` words long.

Runs are seeded from minimizers of several scales. The scale P looks for periods from P to below 2 P: every stretch of
P / 2 words has a hash, and every window of P / 2 such hashes names the place of its smallest. A window spans less than P
words, so a run of at least two periods holds some window together with its copy one period on, and both name places with
equal hashes. Pairs of places with equal hashes that are so far apart give (place, period), which is extended to both
sides as far as words stay equal. Periods below the first scale are too short for windows; they are found by comparing
the words with themselves shifted by every such lag.

Places of equal hashes whose stretches overlap by half lie in a stretch of a short period; there they are taken together
as one chain, and two chains are combined by their distinct distances only. So a text of one word over and over, or of two
such stretches beside each other, does not give all pairs of places.

Texts are handled many at a time as one long array of words; a separator of its own after each text ends all matches.
Words are compared by exact numbers, longer stretches by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import column

#: A run has at least this many words.
LEAST = 12
#: The smallest scale; periods below are found by lags. A power of two.
FIRST_SCALE = 8
#: Texts handled at a time have about this many bytes together, or are one text.
AT_ONCE = 1 << 21
#: Stretches of up to 2 ** _LEVELS words have hashes for extending; longer ones are passed over several at a time.
_LEVELS = 10
_ODD = np.uint64(0x9FB21C651E98DF25)
_STEP = np.uint64(0xD6E8FEB86659FD93)

SCHEMA = "id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def _doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Hashes of stretches of 2 x ``width`` words from those of ``width`` words; stretches past the end equal none."""
    out = _mix(np.arange(len(names), dtype=np.uint64) * _STEP + np.uint64(width))
    whole = max(0, len(names) - 2 * width + 1)
    out[:whole] = _mix(names[:whole] * _STEP + names[width : width + whole])
    return out


class _Extender:
    """How far words stay equal from two places on."""

    def __init__(self, words: np.ndarray):
        self.names = [_mix(words.astype(np.uint64) + np.uint64(1))]
        for k in range(_LEVELS):
            self.names.append(_doubled(self.names[-1], 1 << k))

    def _run(self, x: np.ndarray, y: np.ndarray, sign: int) -> np.ndarray:
        far, n = np.zeros(len(x), np.int64), len(self.names[0])

        def equal(k: int, some: np.ndarray) -> np.ndarray:
            shift = far[some] if sign > 0 else -far[some] - (1 << k)
            a, b = x[some] + shift, y[some] + shift
            ok = (a >= 0) & (b < n)
            ok[ok] = self.names[k][a[ok]] == self.names[k][b[ok]]
            return ok

        active = np.arange(len(x))
        while len(active):
            active = active[equal(_LEVELS, active)]
            far[active] += 1 << _LEVELS
        every = np.arange(len(x))
        for k in range(_LEVELS - 1, -1, -1):
            far[every[equal(k, every)]] += 1 << k
        return far

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._run(x, y, 1)

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal words before ``x`` and ``y``."""
        return self._run(x, y, -1)


def _minimizers(names: np.ndarray, windows: int) -> np.ndarray:
    """Places of the smallest (then leftmost) of every ``windows`` hashes in a row; ``windows`` is a power of two."""
    low, at, width = names, np.arange(len(names)), 1
    while width < windows:
        right = low[width:] < low[:-width]
        at = np.where(right, at[width:], at[:-width])
        low = np.minimum(low[width:], low[:-width])
        width *= 2
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def _seeds(names: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs with periods from ``scale`` to below twice that; ``names`` are hashes of scale / 2 words."""
    picked = _minimizers(names, scale // 2)
    order = np.argsort(names[picked], kind="stable")
    places, values = picked[order], names[picked[order]]
    same = values[1:] == values[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(values) else same
    places, values = places[shared], values[shared]
    if not len(places):
        return places, places
    gaps = np.diff(places)
    linked = (values[1:] == values[:-1]) & (gaps <= scale // 4)
    heads = np.flatnonzero(np.concatenate([[True], ~linked]))
    first, last, value = places[heads], places[np.concatenate([heads[1:], [len(places)]]) - 1], values[heads]
    step = np.gcd.reduceat(np.concatenate([np.where(linked, gaps, 0), [0]]), heads)  # 0 for a chain of one place
    found, chains, t = [], np.arange(len(heads)), 1
    while True:
        chains = chains[chains + t < len(heads)]
        chains = chains[value[chains + t] == value[chains]]
        chains = chains[first[chains + t] - last[chains] < 2 * scale]
        if not len(chains):
            break
        a, b = chains, chains + t
        near, far = first[b] - last[a], last[b] - first[a]
        by = np.maximum(np.gcd(step[a], step[b]), 1)
        low = near + -(-np.maximum(scale - near, 0) // by) * by
        many = np.maximum((np.minimum(far, 2 * scale - 1) - low) // by + 1, 0)
        which = np.repeat(np.arange(len(a)), many)
        lags = low[which] + by[which] * (np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many))
        found.append((np.maximum(first[a][which], first[b][which] - lags), lags))
        t += 1
    if not found:
        return places[:0], places[:0]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _by_lag(words: np.ndarray, lag: int) -> np.ndarray:
    """Rows (start, length, period) of stretches with period ``lag``."""
    equal = np.flatnonzero(words[:-lag] == words[lag:])
    if not len(equal):
        return np.empty((0, 3), np.int64)
    cuts = np.flatnonzero(np.diff(equal) != 1)
    starts = equal[np.concatenate([[0], cuts + 1])]
    lengths = equal[np.concatenate([cuts, [len(equal) - 1]])] - starts + 1 + lag
    long = lengths >= max(LEAST, 2 * lag)
    return np.stack([starts[long], lengths[long], np.full(long.sum(), lag)], axis=1)


@lru_cache(maxsize=4096)
def _prime_factors(n: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return (*out, n) if n > 1 else tuple(out)


def _smallest(runs: np.ndarray, extend: _Extender) -> np.ndarray:
    """The rows of ``runs`` whose period is their smallest. A stretch of two periods or more has a smaller period only if that
    divides the period, and then also one that is the period over a prime."""
    tests = [(i, q // p) for i, q in enumerate(runs[:, 2].tolist()) for p in _prime_factors(q)]
    if not tests:
        return runs
    which, shorter = np.array(tests, np.int64).T
    start, length = runs[which, 0], runs[which, 1]
    has = extend.forward(start, start + shorter) >= length - shorter
    bad = np.zeros(len(runs), bool)
    bad[which[has]] = True
    return runs[~bad]


def runs_of(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period. ``words`` holds a separator and then texts of ``sizes`` words,
    longest first, each followed by a separator; separators equal nothing else."""
    extend = _Extender(words)
    found = [_by_lag(words, lag) for lag in range(1, min(FIRST_SCALE, len(words)))]
    names, width, scale = extend.names[0], 1, FIRST_SCALE
    ends = 1 + np.cumsum(sizes + 1)
    while len(sizes) and 2 * scale <= sizes[0]:
        upto = ends[np.searchsorted(-sizes, -2 * scale, side="right") - 1]  # shorter texts have no such run
        names = names[:upto]
        while width < scale // 2:
            names, width = _doubled(names, width), width * 2
        x, lag = _seeds(names, scale)
        back, on = extend.backward(x, x + lag), extend.forward(x, x + lag)
        rows = np.stack([x - back, back + on + lag, lag], axis=1)
        found.append(np.unique(rows[rows[:, 1] >= np.maximum(LEAST, 2 * lag)], axis=0))
        scale *= 2
    runs = np.concatenate([np.empty((0, 3), np.int64), *found])
    runs = _smallest(runs[np.lexsort((runs[:, 2], runs[:, 0]))], extend)
    return runs


def _some(texts: list[bytes | None]) -> tuple[list[int], list[np.ndarray], list[str]]:
    """Number of words, runs and collapsed text of each text."""
    split = [(t or b"").split() for t in texts]  # bytes are split at the six ASCII blanks only
    order = sorted(range(len(texts)), key=lambda i: -len(split[i]))
    sizes = np.array([len(split[i]) for i in order], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    words = np.empty(int((sizes + 1).sum()) + 1, np.int64)
    numbers = _Numbers()
    words[0] = -1
    for k, i in enumerate(order):
        at = starts[k]
        words[at : at + sizes[k]] = np.fromiter(map(numbers.__getitem__, split[i]), np.int64, len(split[i]))
        words[at + sizes[k]] = -2 - k
    runs = runs_of(words, sizes)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(marks) == 0
    first = np.searchsorted(runs[:, 0], starts)
    last = np.searchsorted(runs[:, 0], starts + sizes)
    n, own, collapsed = [0] * len(texts), [runs[:0]] * len(texts), [""] * len(texts)
    for k, i in enumerate(order):
        n[i] = len(split[i])
        own[i] = runs[first[k] : last[k]] - np.array([starts[k], 0, 0])
        left = split[i]
        if len(own[i]):
            left = [left[j] for j in np.flatnonzero(kept[starts[k] : starts[k] + sizes[k]])]
        collapsed[i] = b" ".join(left).decode("utf-8", "replace")
    return n, own, collapsed


def _find():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").cast(pa.binary())
            sums = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(sums[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sums, before + AT_ONCE, side="right")))
                n, runs, collapsed = _some(texts.slice(at, to - at).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                flat = np.concatenate([np.empty((0, 3), np.int64), *runs])
                rows = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], fields=list(_RUN))
                arrays = [ids.slice(at, to - at), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), rows), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "runs", "collapsed"])
                at = to

    return run


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs (start, length and period in words, by start, then period) and collapsed, the
    words that no run holds after its first period, joined by one blank.

    Words are what stands between ASCII blanks. Missing, empty and blank texts have no words, no runs and an empty collapsed text.
    Missing ids stay missing, repeated rows give a row each, an empty table gives none. A text is handled whole, however long,
    in the task that reads it; nothing is shuffled. Other columns are not read, so their names don't matter.
    """
    slim = docs.select(column(docs, id_column).cast("bigint").alias("id"), column(docs, text).cast("string").alias("text"))
    return slim.mapInArrow(_find(), SCHEMA)


def longest(runs: str = "runs"):
    """The longest run (ties: smallest start, then period) of a column of runs, as (length, start, period) with the last two negative;
    missing without runs."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
