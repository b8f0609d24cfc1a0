"""Implausible spikes in measurements (problem 7): a hidden Markov model per series.

States: normal, spike, stuck, out of range. What the model sees of a reading: how far it stands from what level and daily
course explain, in units of the series' noise, whether it equals the reading before, and whether it passes the metric's
limits. The level is the median of the 25 readings around it. The daily course is the expected range of deviations in each
quarter of an hour: the median, over the other days within a week, of the deviation to either side that a quarter of the
readings there reach.

The model is each series' own. One Baum-Welch step starts from common priors: every day of a series gives its expected
transitions and the distribution of its normal deviations, and the days' sums give the series' noise, the spread and weight
of its tails (by EM on the distribution), how often it repeats a value, and how often spikes and stuck phases begin and end.
The posterior of the fitted chain decides. Hard bounds are the metric's limits, infinite values, at least LEAST_RUN equal
readings for stuck, at most LONGEST for a spike, and that the series goes on after it.

Work is done by series and day, whatever share of the rows a series has: a day has at most 86,400 readings, and from other
days it gets the HALO readings before and after it and the series' parameters. These come from summaries of days, which are
merged by series: of each day at most 2 * HALO readings, a histogram and 96 cells.

Defined results: null and NaN values and rows without path or Time have no flag. Equal to the reading before means equal
to the last finite one. Days without finite readings get only hard bounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from seriesmill.operators.messages import kept_rows

HALF = 12  # readings on either side for the local level
LEAST_RUN = 12  # equal readings that are stuck
LONGEST = 12  # readings of a spike
GATHER_ROWS = 1 << 18
NORMAL, SPIKE, STUCK, OUT = range(4)
NAMES = ("normal", "spike", "stuck", "out of range")
#: Rows of the matrix: so many readings, with so many before and after that only settle the chain.
ROW, SETTLE = 256, 20
#: Cells of the matrix that are worked on at once.
CELLS = 1 << 19
HALO = HALF + SETTLE
#: Seconds of a cell of the daily course, and days to either side that it is told from.
CELL_S, WEEK = 900, 7
#: The level that the daily course stands out from is told from each so-manieth reading, over so many times the span.
WIDER = 4
#: Cells of days that are compared with other days at once.
TARGETS = 1 << 17
#: Deviations below so many times the noise aren't kept as part of a daily course.
CANDIDATE = 4.0
#: Parameters of a series: noise; spread of normal deviations, weight and spread of their tails; P(a value is repeated);
#: P(a spike begins), P(it goes on), P(the sensor gets stuck), P(it gets loose).
NOISE, SPREAD, TAIL, TAIL_SPREAD, REPEAT, BEGIN, STAY, FREEZE, THAW = range(9)
PRIOR = np.array([1.0, 1.3, 0.03, 3.5, 0.05, 0.003, 0.7, 0.0001, 0.05])
#: Weight of the priors, in readings: of spreads, of the tails' spread, and of the rates.
SPREAD_WEIGHT, TAIL_WEIGHT, RATE_WEIGHT = 400.0, 40.0, 1000.0
EM_STEPS = 6
#: Bins of the distribution of normal deviations, by binary logarithm.
BINS, FIRST_BIN, PER_OCTAVE = 32, -2, 4
#: Bins of steps from reading to reading, by binary logarithm.
STEPS_PER_OCTAVE = 16
#: How far spikes stand: their density falls off below FAR and, as 1 / z^2, above WIDE.
FAR, STEEP, WIDE = 11.0, 8, 20.0
RARE = 1e-4
#: A series that repeats its value this often mostly keeps it, and no run of equal values is stuck.
MOSTLY = 0.5
#: The first state's probabilities.
FIRST = np.array([0.99, 0.008, 0.001, 0.001])


def spans(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size, begin) of each group of a sorted numbering from 0."""
    size = np.bincount(group)
    return size, np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)


def runs(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to the reading before, length of the run of equal readings it belongs to)"""
    same = np.zeros(len(value), bool)
    same[1:] = (value[1:] == value[:-1]) & (group[1:] == group[:-1])
    which = np.cumsum(~same) - 1
    return same, np.bincount(which, minlength=0)[which]


def local_level(value: np.ndarray, first: np.ndarray, last: np.ndarray, stride: int = 1) -> np.ndarray:
    """Median of HALF readings before, the reading and HALF after it, each stride-th, within first..last of each."""
    out = np.empty(len(value))
    span = np.arange(-HALF, HALF + 1) * stride
    for a in range(0, len(value), 1 << 16):
        at = np.arange(a, min(a + (1 << 16), len(value)))
        where = at[:, None] + span
        inside = (where >= first[at][:, None]) & (where <= last[at][:, None])
        w = np.where(inside, value[np.clip(where, 0, len(value) - 1)], np.inf)
        w.sort(axis=1)
        n = inside.sum(axis=1)
        rows = np.arange(len(at))
        out[at] = w[rows, (n - 1) // 2] / 2 + w[rows, n // 2] / 2
    return out


def median_of(group: np.ndarray, x: np.ndarray, groups: int) -> np.ndarray:
    """Median of x in each group; 0 for groups without."""
    order = np.lexsort((x, group))
    n = np.bincount(group, minlength=groups)
    start = np.concatenate(([0], np.cumsum(n)[:-1]))
    out = np.zeros(groups)
    held = n > 0
    s = x[order]
    out[held] = (s[start[held] + (n[held] - 1) // 2] + s[start[held] + n[held] // 2]) / 2
    return out


def noise(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """Standard deviation of the noise from the steps; where most steps are 0, the usual size of the others."""
    step = np.abs(np.diff(value))
    inner = group[1:] == group[:-1]
    g, step = group[1:][inner], step[inner]
    out = median_of(g, step, groups) / 0.9539
    moved = step > 0
    out = np.where(out > 0, out, median_of(g[moved], step[moved], groups))
    return np.maximum(out, 1e-12 * median_of(group, np.abs(value), groups) + 1e-300)


def in_units(off: np.ndarray, scale: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", over="ignore"):
        return np.nan_to_num(np.clip(off / scale, -1e6, 1e6))


def transitions(p: np.ndarray) -> np.ndarray:
    """P(next state | state) of each row of parameters."""
    a = np.full((len(p), 4, 4), RARE)
    a[:, NORMAL, SPIKE], a[:, NORMAL, STUCK] = p[:, BEGIN], p[:, FREEZE]
    a[:, SPIKE, SPIKE], a[:, STUCK, NORMAL] = p[:, STAY], p[:, THAW]
    a[:, OUT, NORMAL], a[:, OUT, SPIKE], a[:, OUT, OUT] = 0.6 - RARE, 0.2, 0.2
    a[:, NORMAL, NORMAL] = 1 - p[:, BEGIN] - p[:, FREEZE] - RARE
    a[:, SPIKE, NORMAL], a[:, STUCK, STUCK] = 1 - p[:, STAY] - 2 * RARE, 1 - p[:, THAW] - 2 * RARE
    return a


def _bell(z: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * np.minimum((z / s) ** 2, 1400)) / (s * 2.5066)


def emissions(z: np.ndarray, same: np.ndarray, out_of_range: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(what is seen | state), up to a factor for each reading. p: the parameters of each."""
    far = np.minimum(np.abs(z), 1e6)
    e = np.empty((len(z), 4))
    e[:, NORMAL] = (1 - p[:, TAIL]) * _bell(far, p[:, SPREAD]) + p[:, TAIL] * _bell(far, p[:, TAIL_SPREAD])
    wide = 1 / (np.pi * WIDE * (1 + (far / WIDE) ** 2))
    e[:, SPIKE] = wide / (1 + (FAR / np.maximum(far, 1e-3)) ** STEEP)
    e[:, STUCK] = 0.99 * e[:, NORMAL] + 0.001 * wide
    repeat = p[:, REPEAT]
    e[:, NORMAL] *= np.where(same, repeat, 1 - repeat)
    # where a sensor drops out, its value often repeats as well
    dropout = np.maximum(repeat, 0.3)
    e[:, SPIKE] *= np.where(same, dropout, 1 - dropout)
    e[:, STUCK] *= np.where(same, 0.999, 0.001) * (repeat < MOSTLY)
    e[:, OUT] = 0
    e[out_of_range] = (0, 0, 0, 1)
    e += 1e-280
    return e / e.max(axis=1, keepdims=True)


def forward_backward(e: np.ndarray, group: np.ndarray, own: np.ndarray, steps: np.ndarray, count: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each state for each reading, expected transitions of each group where asked for).

    Each group is a sorted run of readings, the middle of which is its own: only there the posterior is worked out. steps:
    P(next state | state) by group. The own readings are cut into rows of a matrix, each with readings before and after that
    settle it; rows of like length are worked on together.
    """
    size, begin = spans(group)
    mine = np.flatnonzero(own)
    own_size = np.bincount(group[mine], minlength=len(size))
    nth = np.arange(len(mine)) - np.repeat(np.cumsum(own_size) - own_size, own_size)
    starts = mine[nth % ROW == 0]
    g = group[starts]
    length = np.minimum(ROW, (own_size[group[mine]] - nth)[nth % ROW == 0])
    order = np.argsort(length, kind="stable")
    out, sums = np.zeros((len(e), 4)), np.zeros((len(size), 4, 4))
    done = 0
    while done < len(order):
        rows = order[done : done + CELLS // (2 * SETTLE + int(length[order[done]]))]
        rows = rows[length[rows] <= 2 * length[rows[0]] + SETTLE]
        done += len(rows)
        lo, hi = begin[g[rows]], begin[g[rows]] + size[g[rows]] - 1
        got = _chain(e, starts[rows], length[rows], lo, hi, steps[g[rows]], out, count)
        if count:
            np.add.at(sums, g[rows], got)
    return out, sums


def _chain(e: np.ndarray, starts: np.ndarray, length: np.ndarray, lo: np.ndarray, hi: np.ndarray, a_of: np.ndarray, out: np.ndarray, count: bool) -> np.ndarray:
    """Fills in `out` for the readings starts..starts + length - 1 of each row, within a run lo..hi; the expected transitions of each."""
    longest = int(length.max())
    at = starts[:, None] + np.arange(-SETTLE, longest + SETTLE)
    inside = (at >= lo[:, None]) & (at <= hi[:, None])
    asked = (at >= starts[:, None]) & (at < (starts + length)[:, None])
    at = np.clip(at, 0, len(e) - 1)
    m = e[at]
    m[~inside] = 1.0
    moves = inside.copy()
    moves[:, 1:] &= inside[:, :-1]
    moves[:, 0] = False
    alpha = np.empty_like(m)
    a = np.broadcast_to(FIRST, (len(starts), 4))
    width = at.shape[1]
    for k in range(width):
        moved = np.where(moves[:, k, None], np.matmul(a[:, None, :], a_of)[:, 0], a)
        a = moved * m[:, k]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[:, k] = a
    b = np.ones((len(starts), 4))
    sums = np.zeros((len(starts), 4, 4))
    for k in range(width - 1, -1, -1):
        rows = np.flatnonzero(asked[:, k])
        if len(rows):
            p = alpha[rows, k] * b[rows]
            out[at[rows, k]] = p / p.sum(axis=1, keepdims=True)
        seen = b * m[:, k]
        if count and len(rows := np.flatnonzero(asked[:, k] & moves[:, k])):
            x = alpha[rows, k - 1, :, None] * a_of[rows] * seen[rows, None, :]
            sums[rows] += x / x.sum(axis=(1, 2), keepdims=True)
        b = np.where(moves[:, k, None], np.matmul(a_of, seen[:, :, None])[:, :, 0], b)
        b = b / b.sum(axis=1, keepdims=True)
    return sums


def bins_of(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((np.log2(np.maximum(np.abs(z), 1e-9)) - FIRST_BIN) * PER_OCTAVE), 0, BINS - 1).astype(np.int64)


def fit_tails(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spread, weight of the tails, their spread) of each row of a distribution over BINS, by EM from the priors."""
    middle = 2.0 ** ((np.arange(BINS) + 0.5) / PER_OCTAVE + FIRST_BIN)
    middle[0] = 0.5 * 2.0**FIRST_BIN
    square = middle**2
    spread, tail, wide = (np.full(len(seen), PRIOR[i]) for i in (SPREAD, TAIL, TAIL_SPREAD))
    for _ in range(EM_STEPS):
        core, far = (1 - tail)[:, None] * _bell(middle[None], spread[:, None]), tail[:, None] * _bell(middle[None], wide[:, None])
        of_tail = seen * far / np.maximum(core + far, 1e-300)
        of_core = seen - of_tail
        n_core, n_tail = of_core.sum(axis=1), of_tail.sum(axis=1)
        spread = np.sqrt((SPREAD_WEIGHT * PRIOR[SPREAD] ** 2 + of_core @ square) / (SPREAD_WEIGHT + n_core))
        wide = np.sqrt((TAIL_WEIGHT * PRIOR[TAIL_SPREAD] ** 2 + of_tail @ square) / (TAIL_WEIGHT + n_tail))
        tail = (SPREAD_WEIGHT * PRIOR[TAIL] + n_tail) / (SPREAD_WEIGHT + n_core + n_tail)
    return spread, tail, wide


def fit(counts: np.ndarray, seen: np.ndarray, scale: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """Parameters of each series. counts: its expected transitions, seen: the distribution of its normal deviations."""
    p = np.tile(PRIOR, (len(counts), 1))
    p[:, NOISE], p[:, REPEAT] = scale, repeat
    p[:, SPREAD], p[:, TAIL], p[:, TAIL_SPREAD] = fit_tails(seen)
    rate = lambda i, a, b, weight: (weight * PRIOR[i] + counts[:, a, b]) / (weight + counts[:, a].sum(axis=1))
    p[:, BEGIN] = rate(BEGIN, NORMAL, SPIKE, RATE_WEIGHT)
    p[:, FREEZE] = rate(FREEZE, NORMAL, STUCK, RATE_WEIGHT)
    p[:, STAY] = np.clip(rate(STAY, SPIKE, SPIKE, 20.0), 0.05, 0.95)
    p[:, THAW] = np.clip(rate(THAW, STUCK, NORMAL, 100.0), 0.001, 0.5)
    return p


def _lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _ends(n: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(n)))


def _slices(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, places) of the concatenated ranges lo..hi - 1."""
    n = np.maximum(hi - lo, 0)
    ends = _ends(n)
    return ends, np.arange(ends[-1]) - np.repeat(ends[:-1] - lo, n)


#: What is kept of a day of a series. Times are seconds of the day.
SUMMARY = (
    "path string, day int, equal bigint, steps bigint, longest bigint, counts array<double>, seen array<double>, step array<int>, step_n array<bigint>, "
    "head_time array<int>, head array<double>, tail_time array<int>, tail array<double>, cells array<int>, peak_cell array<int>, low array<double>, high array<double>, mid array<double>"
)


def summarise(group: np.ndarray, clock: np.ndarray, value: np.ndarray) -> list[np.ndarray | pa.Array]:
    """The columns of SUMMARY after path and day. Rows sorted by group (numbered from 0) and clock, all of them finite."""
    size, begin = spans(group)
    groups, n = len(size), len(value)
    first, last = begin[group], (begin + size - 1)[group]
    scale = noise(group, value, groups)
    z = in_units(value - local_level(value, first, last), scale[group])
    same, run = runs(group, value)
    longest = np.zeros(groups, np.int64)
    np.maximum.at(longest, group, run)
    equal = np.bincount(group, same, groups).astype(np.int64)
    p = np.tile(PRIOR, (groups, 1))
    p[:, REPEAT] = repeat_rate(equal, size - 1, longest)
    posterior, counts = forward_backward(emissions(z, same, np.zeros(n, bool), p[group]), group, np.ones(n, bool), transitions(p), count=True)
    seen = np.bincount(group * BINS + bins_of(z), posterior[:, NORMAL], groups * BINS).reshape(groups, BINS)
    told = size >= 8  # a few readings don't tell their own noise
    counts[~told], seen[~told] = 0, 0
    # steps
    step = np.abs(np.diff(value))
    at = np.flatnonzero((group[1:] == group[:-1]) & (step > 0))
    key, times = np.unique(group[at + 1] * 65536 + step_bin(step[at]) + 20000, return_counts=True)
    step_ends = _ends(np.bincount(key // 65536, minlength=groups))
    # first and last readings
    head_ends, head = _slices(begin, begin + np.minimum(size, HALO))
    tail_ends, tail = _slices(begin + size - np.minimum(size, HALO), begin + size)
    # cells; a wider level, so that peaks of the daily course stand out that would be a level of their own
    wide = value - local_level(value, first, last, WIDER)
    cell = group * 128 + clock // CELL_S
    held, cell_at = np.unique(cell, return_index=True)
    cell_size = np.diff(np.append(cell_at, n))
    sorted_in_cell = wide[np.lexsort((wide, cell))]
    quarter = 3 * cell_size // 4
    low, high = sorted_in_cell[cell_at + cell_size - 1 - quarter], sorted_in_cell[cell_at + quarter]
    mid = sorted_in_cell[cell_at + (cell_size - 1) // 2] / 2 + sorted_in_cell[cell_at + cell_size // 2] / 2
    edge = CANDIDATE * scale[held // 128]
    peak = np.flatnonzero((low < -edge) | (high > edge))
    low, high, mid = (np.where(np.abs(x) > edge, x, 0)[peak] for x in (low, high, mid))
    cells_ends, peak_ends = _ends(np.bincount(held // 128, minlength=groups)), _ends(np.bincount(held[peak] // 128, minlength=groups))
    matrix = lambda x: _lists(np.arange(groups + 1) * (x.size // max(1, groups)), x.reshape(-1), pa.float64())
    return [
        equal, size - 1, longest, matrix(counts), matrix(seen), _lists(step_ends, key % 65536 - 20000, pa.int32()), _lists(step_ends, times, pa.int64()),
        _lists(head_ends, clock[head], pa.int32()), _lists(head_ends, value[head], pa.float64()), _lists(tail_ends, clock[tail], pa.int32()), _lists(tail_ends, value[tail], pa.float64()),
        _lists(cells_ends, held % 128, pa.int32()), _lists(peak_ends, held[peak] % 128, pa.int32()), *(_lists(peak_ends, x, pa.float64()) for x in (low, high, mid)),
    ]


def repeat_rate(equal: np.ndarray, steps: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """How often a series repeats a value outside its longest run."""
    left, again = steps - (longest - 1), equal - (longest - 1)
    out = np.clip((again + 0.2) / np.maximum(left + 0.4, 0.4), 0.002, 0.998)
    return np.where(left < 2, 0.998, out)


def daily_course(path: np.ndarray, day: np.ndarray, cells: pa.ListArray, peak_cell: pa.ListArray, sides: Sequence[pa.ListArray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, low, high): the range of deviations that is usual in the cell, for each cell near a candidate of the row's day.

    Of the other days within a week that hold readings in the cell the (lower) median of the days' deviation to a side, the
    largest of the cell and its neighbours. With one other day it is that of the cells' medians, since two spikes may meet by chance.
    """
    rows = np.arange(len(path))
    held_row = np.repeat(rows, np.diff(cells.offsets.to_numpy()))
    base = (path.astype(np.int64) << 40) + (day.astype(np.int64) + (1 << 20) << 8)
    held = np.sort(base[held_row] + cells.values.to_numpy())
    row = np.repeat(rows, np.diff(peak_cell.offsets.to_numpy()))
    cell = peak_cell.values.to_numpy().astype(np.int64)
    low, high, mid = (x.values.to_numpy() for x in sides)
    # each candidate cell also speaks for its neighbours
    three = lambda x: np.concatenate((x, x, x))
    key = three(base[row]) + np.concatenate((cell - 1, cell, cell + 1))
    ok = (key & 255) < 96
    columns = [three(x)[ok] for x in (low, high, np.minimum(mid, 0), np.maximum(mid, 0))]
    key, of = np.unique(key[ok], return_inverse=True)
    best = [np.zeros(len(key)) for _ in columns]
    for k, x in enumerate(columns):
        (np.minimum if k % 2 == 0 else np.maximum).at(best[k], of, x)
    row_of = three(row)[ok]
    target_row = np.zeros(len(key), np.int64)
    target_row[of] = row_of
    if not len(key):
        return target_row, key, best[0], best[1]
    usual = [np.zeros(len(key)) for _ in best]
    one = np.zeros(len(key), bool)
    for a in range(0, len(key), TARGETS):
        part = slice(a, a + TARGETS)
        got, one[part] = _usual(key[part], key, best, held)
        for x, y in zip(usual, got, strict=True):
            x[part] = y
    return target_row, key & 255, np.where(one, usual[2], usual[0]), np.where(one, usual[3], usual[1])


def _usual(targets: np.ndarray, key: np.ndarray, best: Sequence[np.ndarray], held: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each of `best`, low and high in turn, its lower median over the other days of each target, whether there is one such day
    at most). Days without readings in the cell don't count."""
    others = [k for k in range(-WEEK, WEEK + 1) if k]
    found = [np.full((len(targets), len(others)), np.nan) for _ in best]
    for i, k in enumerate(others):
        other = targets + (k << 8)
        near = np.minimum(np.searchsorted(held, other), len(held) - 1)
        here = held[near] == other
        at = np.minimum(np.searchsorted(key, other), len(key) - 1)
        hit = key[at] == other
        for x, b in zip(found, best, strict=True):
            x[:, i] = np.where(here, np.where(hit, b[at], 0.0), np.nan)
    n = (~np.isnan(found[0])).sum(axis=1)
    where = np.arange(len(targets)), np.maximum(n - 1, 0) // 2
    out = []
    for k, x in enumerate(found):
        x = np.sort(-x if k % 2 == 0 else x, axis=1)[where]  # nan last
        out.append(np.where(n > 0, -x if k % 2 == 0 else x, 0.0))
    return out, n < 2


#: What a day of a series needs to be worked on, in 64-bit words, so that it is one column: the numbers of readings before and
#: after and of cells; the parameters; times (epoch seconds) and values before, the same after; cells (from the epoch), low, high.
COURSE = "path string, day int, words array<bigint>"
COUNTS = 3


def _from_zero(x: pa.ListArray) -> pa.ListArray:
    """The same lists, with values that begin at the first of them."""
    ends = x.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), x.flatten())


def _sums(lists: pa.ListArray, path: np.ndarray, paths: int) -> np.ndarray:
    """Sum by path of lists of equal length."""
    each = lists.values.to_numpy().reshape(len(path), -1)
    out = np.zeros((paths, each.shape[1]))
    np.add.at(out, path, each)
    return out


def step_bin(step: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log2(step) * STEPS_PER_OCTAVE), -20000, 20000).astype(np.int64)


def _noise_of(path: np.ndarray, step: np.ndarray, step_n: np.ndarray, zeros: np.ndarray, level: np.ndarray) -> np.ndarray:
    """noise() by path from its bins of steps and their numbers, and its number of steps of size 0."""
    paths = len(level)
    key, at = np.unique(path * 65536 + step + 20000, return_inverse=True)
    n = np.bincount(at, step_n, len(key))
    who, size = key // 65536, 2.0 ** ((key % 65536 - 20000 + 0.5) / STEPS_PER_OCTAVE)
    total = np.bincount(who, n, paths)
    upto = np.cumsum(n) - (np.cumsum(total) - total)[who]

    def median(skip: np.ndarray) -> np.ndarray:
        """Size of the step in the middle, where so many of size 0 come first; 0 if the middle is among these."""
        want = (total + skip) / 2 - skip
        hit = np.flatnonzero((upto >= want[who]) & (want[who] > 0))
        out = np.zeros(paths)
        seen, first = np.unique(who[hit], return_index=True)
        out[seen] = size[hit[first]]
        return out

    usual = median(zeros) / 0.9539
    return np.maximum(np.where(usual > 0, usual, median(np.zeros(paths))), 1e-12 * level + 1e-300)


def courses(t: pa.Table) -> pa.RecordBatch:
    """The rows of COURSE for the days of whole series, sorted by path and day."""
    day = t["day"].to_numpy().astype(np.int64)
    path = np.cumsum(_new(t, ("path",))) - 1
    paths = int(path[-1]) + 1
    size, begin = spans(path)
    lists = {f.name: _from_zero(_column(t, f.name)) for f in t.schema if pa.types.is_list(f.type)}
    longest = np.zeros(paths, np.int64)
    np.maximum.at(longest, path, t["longest"].to_numpy())
    equal, steps = (np.bincount(path, t[c].to_numpy(), paths).astype(np.int64) for c in ("equal", "steps"))
    values, heads, tails = lists["head"].values.to_numpy(), lists["head"].offsets.to_numpy(), lists["tail"].offsets.to_numpy()
    level = median_of(np.repeat(path, np.diff(heads)), np.abs(values), paths)
    # steps from day to day
    inner = np.flatnonzero(path[1:] == path[:-1])
    over = np.abs(values[heads[inner + 1]] - lists["tail"].values.to_numpy()[tails[inner + 1] - 1])
    steps += np.bincount(path[inner], minlength=paths)
    equal += np.bincount(path[inner], over == 0, paths).astype(np.int64)
    of_steps = np.concatenate((np.repeat(path, np.diff(lists["step"].offsets.to_numpy())), path[inner][over > 0]))
    scale = _noise_of(of_steps, np.concatenate((lists["step"].values.to_numpy(), step_bin(over[over > 0]))), np.concatenate((lists["step_n"].values.to_numpy(), np.ones((over > 0).sum()))), equal, level)
    counts = _sums(lists["counts"], path, paths).reshape(paths, 4, 4)
    p = fit(counts, _sums(lists["seen"], path, paths), scale, repeat_rate(equal, steps, longest))
    counts_of: list[np.ndarray] = []
    blocks: list[tuple[np.ndarray, np.ndarray]] = []  # (numbers by day, values)
    blocks.append((np.full(len(day), p.shape[1]), p[path].reshape(-1).view(np.int64)))
    # readings before and after each day
    for name, before in (("tail", True), ("head", False)):
        ends = lists[name].offsets.to_numpy().astype(np.int64)
        of = np.repeat(np.arange(len(day)), np.diff(ends))
        time, value = lists[f"{name}_time"].values.to_numpy() + day[of] * 86400, lists[name].values.to_numpy()
        if before:
            at_ends, at = _slices(np.maximum(ends[begin][path], ends[:-1] - HALO), ends[:-1])
        else:
            at_ends, at = _slices(ends[1:], np.minimum(ends[begin + size][path], ends[1:] + HALO))
        counts_of.append(np.diff(at_ends))
        blocks += [(counts_of[-1], time[at].astype(np.int64)), (counts_of[-1], value[at].view(np.int64))]
    # the course of the day and of its neighbours, for the halo
    row, cell, low, high = daily_course(path, day, lists["cells"], lists["peak_cell"], [lists[c] for c in ("low", "high", "mid")])
    useful = (low < 0) | (high > 0)
    row, cell, low, high = row[useful], cell[useful], low[useful], high[useful]
    index = (path << 24) + day + (1 << 20)
    to, what = [], []
    for k in (-1, 0, 1):
        other = index[row] + k
        at = np.minimum(np.searchsorted(index, other), len(index) - 1)
        hit = np.flatnonzero(index[at] == other)
        to.append(at[hit])
        what.append(hit)
    to, what = np.concatenate(to), np.concatenate(what)
    order = np.lexsort((cell[what] + day[row[what]] * 96, to))
    to, what = to[order], what[order]
    counts_of.append(np.bincount(to, minlength=len(day)))
    blocks += [(counts_of[-1], cell[what] + day[row[what]] * 96), (counts_of[-1], low[what].view(np.int64)), (counts_of[-1], high[what].view(np.int64))]
    blocks.insert(0, (np.full(len(day), COUNTS), np.stack(counts_of, axis=1).reshape(-1)))
    ends = _ends(np.sum([n for n, _ in blocks], axis=0))
    words = np.empty(ends[-1], np.int64)
    start = ends[:-1].copy()
    for n, values in blocks:
        words[_slices(start, start + n)[1]] = values
        start += n
    return pa.RecordBatch.from_arrays([_column(t, "path"), _column(t, "day"), _lists(ends, words, pa.int64())], names=["path", "day", "words"])


class Told:
    """The words of COURSE of many days, taken apart. Days without are of the prior, with nothing before or after."""

    def __init__(self, words: pa.ListArray) -> None:
        flat = words.flatten().to_numpy()
        n = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
        start = np.cumsum(n) - n
        held = np.flatnonzero(n)
        counts = np.zeros((len(n), COUNTS), np.int64)
        counts[held] = flat[start[held, None] + np.arange(COUNTS)]
        self.parameters = np.tile(PRIOR, (len(n), 1))
        self.parameters[held] = flat[start[held, None] + COUNTS + np.arange(len(PRIOR))].view(np.float64)
        self.before, self.after, self.cells = counts.T
        start = start + COUNTS + len(PRIOR)

        def take(n: np.ndarray) -> np.ndarray:
            nonlocal start
            out = flat[_slices(start, start + n)[1]]
            start = start + n
            return out

        self.before_time, self.before_value = take(self.before), take(self.before).view(np.float64)
        self.after_time, self.after_value = take(self.after), take(self.after).view(np.float64)
        self.cell, self.low, self.high = take(self.cells), take(self.cells).view(np.float64), take(self.cells).view(np.float64)


def decide(
    group: np.ndarray, time: np.ndarray, value: np.ndarray, own: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, begins: np.ndarray, ends: np.ndarray,
    course: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray],
) -> np.ndarray:
    """State of each reading. Rows sorted by group and time; course: group, cell, low, high. By group: parameters, limits, and
    whether its first or last reading is the series' first or last."""
    n = len(value)
    if not n:
        return np.zeros(0, np.int8)
    size, begin = spans(group)
    first, last = begin[group], (begin + size - 1)[group]
    off = value - local_level(value, first, last)
    if len(course[0]):
        key = (course[0] << 32) + course[1]
        mine = (group << 32) + time // CELL_S
        at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
        hit = key[at] == mine
        off = np.where(hit, off - np.clip(off, course[2][at], course[3][at]), off)
    z = in_units(off, p[group, NOISE])
    same, run = runs(group, value)
    out_of_range = (value < low[group]) | (value > high[group])
    posterior, _ = forward_backward(emissions(z, same, out_of_range, p[group]), group, own, transitions(p))
    posterior[run < LEAST_RUN, STUCK] = 0
    state = posterior.argmax(axis=1).astype(np.int8)
    # a run is stuck as a whole
    head = np.flatnonzero(~same)
    which = np.cumsum(~same) - 1
    votes, voters = np.add.reduceat((state == STUCK).astype(np.int64), head), np.add.reduceat(own.astype(np.int64), head)
    stuck = (run >= LEAST_RUN) & (2 * votes >= np.maximum(voters, 1))[which]
    spike = (state == SPIKE) & ~stuck
    edge = np.ones(n, bool)
    edge[1:] = (spike[1:] != spike[:-1]) | (group[1:] != group[:-1])
    head = np.flatnonzero(edge)
    tail = np.append(head[1:], n) - 1
    # after it the series returns to what it was before
    inner = ~(begins[group[head]] & (head == first[head])) & ~(ends[group[head]] & (tail == last[head]))
    spike &= (inner & (tail - head < LONGEST))[np.cumsum(edge) - 1]
    return np.where(out_of_range, OUT, np.where(stuck, STUCK, np.where(spike, SPIKE, NORMAL))).astype(np.int8)


def limits_of(path: str, rules: list[tuple[str | None, float | None, float | None]]) -> tuple[float, float]:
    for pattern, lo, hi in rules:
        if not pattern or re.search(pattern, path):
            return (-np.inf if lo is None or lo != lo else lo), (np.inf if hi is None or hi != hi else hi)
    return -np.inf, np.inf


def whole(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = GATHER_ROWS) -> Iterator[pa.Table]:
    """Tables of whole groups of keys, of about so many rows; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        if n >= rows:
            last = held[-1].slice(held[-1].num_rows - 1)
            other = None
            for k in keys:
                x = pc.not_equal(b.column(k), last.column(k)[0])
                other = x if other is None else pc.or_(other, x)
            cut = pc.index(other, True).as_py()
            if cut >= 0:
                yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
                held, n, b = [], 0, b.slice(cut)
        held.append(b)
        n += b.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    x = t[name].combine_chunks()
    return x.chunk(0) if isinstance(x, pa.ChunkedArray) else x


def _new(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether a row begins a group of keys."""
    new = np.ones(t.num_rows, bool)
    if t.num_rows > 1:
        new[1:] = False
        for k in keys:
            x = _column(t, k)
            new[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    return new


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    for t in whole(batches, ("path", "day")):
        t = t.filter(pc.is_finite(t["value"]))
        if not t.num_rows:
            continue
        new = _new(t, ("path", "day"))
        head = pa.array(np.flatnonzero(new))
        day = t["day"].to_numpy()
        columns = summarise(np.cumsum(new) - 1, t["Time"].to_numpy() - day.astype(np.int64) * 86400, t["value"].to_numpy())
        yield pa.RecordBatch.from_arrays([_column(t, "path").take(head), _column(t, "day").take(head), *(pa.array(c) if isinstance(c, np.ndarray) else c for c in columns)], names=names)


def _flags(t: pa.Table, rules: list[tuple[str | None, float | None, float | None]]) -> pa.RecordBatch:
    """The implausible rows of whole days. What their series says stands in the first row of each."""
    new = _new(t, ("path", "day"))
    group = np.cumsum(new) - 1
    head = pa.array(np.flatnonzero(new))
    paths = _column(t, "path").take(head).dictionary_encode()
    limits = np.array([limits_of(p, rules) for p in paths.dictionary.to_pylist()], np.float64)[paths.indices.to_numpy()]
    day, time, value = t["day"].to_numpy(), t["Time"].to_numpy(), t["value"].to_numpy()
    told = Told(_column(t, "words").take(head))
    good = np.flatnonzero(np.isfinite(value))
    own_n = np.bincount(group[good], minlength=len(head))
    total = told.before + own_n + told.after
    base = np.cumsum(total) - total
    n = int(total.sum())
    at_time, at_value, own, back = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool), np.zeros(n, np.int64)

    def put(start: np.ndarray, count: np.ndarray, times: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = _slices(start, start + count)[1]
        at_time[at], at_value[at] = times, values
        return at

    put(base, told.before, told.before_time, told.before_value)
    at = put(base + told.before, own_n, time[good], value[good])
    own[at], back[at] = True, good
    put(base + told.before + own_n, told.after, told.after_time, told.after_value)
    # groups without a finite value have no reading, and so no number in a sorted numbering
    held = np.flatnonzero(total)
    number = np.cumsum(total > 0) - 1
    state = np.where(np.isinf(value), OUT, NORMAL).astype(np.int8)
    found = decide(
        np.repeat(number, total), at_time, at_value, own, told.parameters[held], limits[held, 0], limits[held, 1], (told.before == 0)[held], (told.after == 0)[held],
        (np.repeat(number, told.cells), told.cell, told.low, told.high),
    )
    state[back[own]] = found[own]
    hit = np.flatnonzero(state != NORMAL)
    part = t.take(pa.array(hit))
    return pa.RecordBatch.from_arrays([*(_column(part, c) for c in ("seq", "path", "Time", "value")), pa.array(np.array(NAMES, object)[state[hit]], pa.string())], names=["seq", "path", "Time", "value", "flag"])


def implausible(df: DataFrame, limits: Iterable[Row]) -> DataFrame:
    """seq, path, Time, value and flag (a name of NAMES but normal) of the kept rows that hold implausible values."""
    rules = [(r["regexp"], r["lo"], r["hi"]) for r in limits]
    rows = kept_rows(df, "Value", "seq").withColumnRenamed("Value", "value").where("value IS NOT NULL AND NOT isnan(value)")
    # both uses of rows take all their columns and filter nothing more, so that Spark shuffles them once
    days = rows.mapInArrow(_summaries, SUMMARY)
    placed = days.repartition("path").sortWithinPartitions("path", "day")
    course = placed.mapInArrow(lambda batches: (courses(t) for t in whole(batches, ("path",), 1 << 14)), COURSE)
    first = F.lag("Time").over(Window.partitionBy("path", "day").orderBy("Time")).isNull()
    told = rows.withColumn("_first", first).join(course, ["path", "day"], "left")
    once = told.select("seq", "path", "day", "Time", "value", F.when(F.col("_first"), F.col("words")).alias("words"))
    return once.mapInArrow(lambda batches: (_flags(t, rules) for t in whole(batches, ("path", "day"))), "seq bigint, path string, Time bigint, value double, flag string")
