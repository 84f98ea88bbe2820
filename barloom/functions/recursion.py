"""Kernels of the columns that need a series' rows in order, on one block of it at a time.

A block is some consecutive bars of one symbol after ``HALO`` bars before them.
What reaches back further comes as a carry: the recursive means' values, and the
last confirmed swings.  A recursive mean is an affine map of its value before
the block, so a block's maps and the carry before it give the carry after it;
the carries of a long series are composed block by block from such summaries,
without its bars.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd

#: Bars before a block that its windows see: 251 values of a 20-bar deviation of returns.
HALO = 280
BARS, BINS, AREA = 50, 20, 0.7
WINDOWS = 2048  # windows worked on at a time
NEAR = 0.005  # share of a swing's price that counts as a touch
SWING = 5  # bars to either side of a swing


class Mean(NamedTuple):
    """A recursive mean: what it is a mean of, its weight, and how many values it needs."""

    source: str
    alpha: float
    least: int


def _span(n: int) -> float:
    return 2 / (n + 1)


#: Means of the bars themselves, then means of what follows from those.
FIRST = {
    "ema12": Mean("close", _span(12), 12), "ema20": Mean("close", _span(20), 20), "ema26": Mean("close", _span(26), 26), "up14": Mean("up", 1 / 14, 14), "down14": Mean("down", 1 / 14, 14),
    **{f"atr_{n}": Mean("range", 1 / n, n) for n in (7, 14, 21)}, **{f"{side}{n}": Mean(side, 1 / n, n) for n in (7, 14, 21, 28) for side in ("gain", "loss")},
    "force_13": Mean("force", _span(13), 13), "seeded_atr": Mean("seeded", 1 / 14, 1),
}
SECOND = {"macd_signal": Mean("macd", _span(9), 9), "adx": Mean("dx", 1 / 14, 14)}
ALL = FIRST | SECOND
#: What a mean, and a column that follows from means, is made of.
MADE_OF = {
    "macd": ["ema12", "ema26"], "macd_signal": ["ema12", "ema26", "macd_signal"], "di_plus": ["up14", "atr_14"], "di_minus": ["down14", "atr_14"], "adx": ["up14", "down14", "atr_14", "adx"],
    **{f"rsi_{n}": [f"gain{n}", f"loss{n}"] for n in (7, 14, 21, 28)}, **{m: [m] for m in FIRST}, "gap_before": ["ema12", "ema26", "macd_signal"],
}


class Carry(NamedTuple):
    """A mean after some bars: its value, the bars since the last one with a value, and how many had one."""

    value: float = np.nan
    gap: int = 0
    seen: int = 0


class Summary(NamedTuple):
    """A block as a map of carries: bars before its first value, that value, the affine map from there on, bars after its last value, values, bars."""

    lead: int
    first: float
    slope: float
    shift: float
    tail: int
    seen: int
    size: int


def running(x: np.ndarray, mean: Mean, carry: Carry) -> np.ndarray:
    """The mean at each bar, NaN while fewer than ``least`` values were seen; a bar without a value keeps the mean, and its age lowers the mean's weight."""
    before = [carry.value, *[np.nan] * carry.gap] if carry.seen else []
    y = pd.Series(np.concatenate((before, x))).ewm(alpha=mean.alpha, adjust=False).mean().to_numpy()[len(before) :]
    return np.where(carry.seen + np.cumsum(~np.isnan(x)) >= mean.least, y, np.nan)


def summary(x: np.ndarray, mean: Mean) -> Summary:
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return Summary(len(x), np.nan, 1.0, 0.0, 0, 0, len(x))
    rest = x[at[0] :].copy()
    ends = []
    for start in (0.0, 1.0):
        rest[0] = start
        ends.append(running(rest, mean._replace(least=1), Carry())[-1])
    return Summary(int(at[0]), float(x[at[0]]), ends[1] - ends[0], ends[0], len(x) - 1 - int(at[-1]), len(at), len(x))


def after(carry: Carry, s: Summary, alpha: float) -> Carry:
    """The carry after a block, from that before it."""
    if not s.seen:
        return carry._replace(gap=carry.gap + s.size)
    start = s.first
    if carry.seen:
        w = (1 - alpha) ** (carry.gap + s.lead + 1)
        start = (w * carry.value + alpha * s.first) / (w + alpha)
    return Carry(s.slope * start + s.shift, s.tail, carry.seen + s.seen)


# ---------------------------------------------------------------- inputs


def _lag(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([np.nan], x[:-1]))


class Block:
    """The bars of a block and its halo, by column; ``start`` is the number of the first bar, ``own`` where the block's own bars begin."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("_rank")
        self.frame = pdf[pdf["_own"]].reset_index(drop=True)
        self.own, self.start = len(pdf) - len(self.frame), int(pdf["_rank"].iloc[0])
        self.pdf, self._made = pdf, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._made:
            with np.errstate(all="ignore"):
                self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> np.ndarray:
        if name in ("open", "high", "low", "close", "volume"):
            return self.pdf[name].to_numpy(dtype=float, na_value=np.nan)
        if name in ("gain", "loss", "force", "width", "vol"):
            return self._of_close(name, self["close"])
        h, lo = self["high"], self["low"]
        if name in ("up", "down"):
            up, down = h - _lag(h), _lag(lo) - lo
            return np.where((up > down) & (up > 0), up, 0.0) if name == "up" else np.where((down > up) & (down > 0), down, 0.0)
        c = self["close"]
        if name == "range":  # the greatest of those known; the first bar has only high - low
            return np.fmax(h - lo, np.fmax(np.abs(h - _lag(c)), np.abs(lo - _lag(c))))
        if name == "seeded":  # starts with the mean of the first 14 ranges
            x, rank = self["range"].copy(), self.start + np.arange(len(h))
            first = np.flatnonzero(rank == 13)
            x[rank < 13] = np.nan
            if len(first):
                early = self["range"][first[0] - 13 : first[0] + 1]
                x[first[0]] = early[~np.isnan(early)].mean() if (~np.isnan(early)).any() else np.nan
            return x
        if name == "typical":
            return (h + lo + c) / 3
        raise KeyError(name)

    def _of_close(self, name: str, c: np.ndarray) -> np.ndarray:
        step = c - _lag(c)
        if name in ("gain", "loss"):
            return np.where(np.isnan(step), np.nan, np.maximum(step if name == "gain" else -step, 0))
        if name == "force":
            return step * self["volume"]
        if name == "width":
            mean, std = _full(c, 20, np.mean), _deviation(c, 20)
            return np.where(mean == 0, np.nan, 4 * std / mean)
        x = _log(c)
        return _deviation(x - _lag(x), 20)


def _log(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.log(np.where(x > 0, x, 1.0)), np.nan)


def _views(x: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` values at each bar, as rows; NaN before the first bar."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(n - 1, np.nan), x)), n)


def _by_parts(x: np.ndarray, n: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``of`` the windows of ``n`` bars, some at a time."""
    w = _views(x, n)
    return np.concatenate([of(w[i : i + WINDOWS]) for i in range(0, len(w), WINDOWS)]) if len(w) else np.zeros(0)


def _full(x: np.ndarray, n: int, of) -> np.ndarray:
    return _by_parts(x, n, lambda w: of(w, axis=1))


def _deviation(x: np.ndarray, n: int) -> np.ndarray:
    return _by_parts(x, n, lambda w: np.where(w.max(1) == w.min(1), np.where(np.isnan(w).any(1), np.nan, 0.0), np.std(w, axis=1, ddof=1)))


def with_time(x: np.ndarray, n: int) -> np.ndarray:
    """Correlation of the last ``n`` values with their numbers; NaN if they are all the same."""
    t = np.arange(n) - (n - 1) / 2

    def of(w):
        own = w - w.mean(1, keepdims=True)
        return np.where(w.max(1) == w.min(1), np.nan, own @ t / np.sqrt((own * own).sum(1) * (t @ t)))

    return _by_parts(x, n, of)


# ---------------------------------------------------------------- order statistics of windows


def place_of(x: np.ndarray, n: int, top: bool) -> np.ndarray:
    """100 times the place (1 to n) of the first extreme among the last ``n`` bars, by n."""
    pick = np.argmax if top else np.argmin

    def of(w):
        full = ~np.isnan(w).any(1)
        return np.where(full, 100 * (pick(np.nan_to_num(w), 1) + 1) / n, np.nan)

    return _by_parts(x, n, of)


def mean_distance(x: np.ndarray, n: int) -> np.ndarray:
    """Mean distance of the last ``n`` values from their mean."""
    return _by_parts(x, n, lambda w: np.abs(w - w.mean(1, keepdims=True)).mean(1))


def against_past(x: np.ndarray, n: int, share: float | None) -> np.ndarray:
    """Whether a value is at most the ``share`` quantile of the ``n`` values before it; or, without ``share``, which part of those is below it.

    Null values before it do not count; 99 others are needed.
    """

    def of(w):
        past, now = np.sort(w[:, :-1], 1), w[:, -1]  # NaN comes last
        have = (~np.isnan(past)).sum(1)
        ok = (have >= 99) & ~np.isnan(now)
        if share is None:
            return np.where(ok, (past < now[:, None]).sum(1) / np.maximum(have, 1), np.nan)
        at = (np.maximum(have, 1) - 1) * share
        low, row = np.floor(at).astype(int), np.arange(len(past))
        a, z = past[row, low], past[row, np.minimum(low + 1, np.maximum(have, 1) - 1)]
        return np.where(ok, (now <= a + (at - low) * (z - a)).astype(float), np.nan)

    return _by_parts(x, n + 1, of)


def confirmed(x: np.ndarray, top: bool) -> np.ndarray:
    """The value of the bar ``SWING`` bars ago where it is the extreme of those around it."""
    pick = np.max if top else np.min
    back = np.concatenate((np.full(SWING, np.nan), x[:-SWING])) if len(x) > SWING else np.full(len(x), np.nan)
    return np.where(back == _full(x, 2 * SWING + 1, pick), back, np.nan)


def touches(x: np.ndarray, level: np.ndarray, n: int = 50) -> np.ndarray:
    """How many of the last ``n`` values lie near the level of the bar."""
    w = _views(x, n)
    parts = [(np.abs(w[i : i + WINDOWS] - level[i : i + WINDOWS, None]) / level[i : i + WINDOWS, None] <= NEAR).sum(1) for i in range(0, len(w), WINDOWS)]
    return np.where(level > 0, np.concatenate(parts) if parts else np.zeros(0), np.nan)


def stochastic(b: Block, n: int) -> np.ndarray:
    """100 times the place of the close in the range of the last ``n`` bars."""
    top, low = _full(b["high"], n, np.max), _full(b["low"], n, np.min)
    return 100 * (b["close"] - low) / np.where(top == low, np.nan, top - low)


# ---------------------------------------------------------------- volume


def against_mean(x: np.ndarray, n: int) -> np.ndarray:
    """Deviations of a value from the mean of the last ``n``; NaN if they are all the same."""
    std = _deviation(x, n)
    return (x - _full(x, n, np.mean)) / np.where(std == 0, np.nan, std)


def balance(b: Block) -> np.ndarray:
    """On-balance volume from the first bar that the block sees: the same as from the series' first bar, but for a constant."""
    step = b["close"] - _lag(b["close"])
    return np.cumsum(np.nan_to_num(np.sign(np.nan_to_num(step)) * b["volume"]))


def slope(x: np.ndarray, n: int) -> np.ndarray:
    """Slope of the last ``n`` values over their numbers."""
    t = np.arange(n) - (n - 1) / 2
    return _by_parts(x, n, lambda w: (w - w.mean(1, keepdims=True)) @ t / (t @ t))


def weighted(x: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``x`` over that of ``by``, of the last ``n`` bars."""
    under = _full(by, n, np.sum)
    return _full(x, n, np.sum) / np.where(under == 0, np.nan, under)


def money_flow(b: Block, n: int) -> np.ndarray:
    """100 - 100 / (1 + flow of the bars with a rising typical price over that of those with a falling one)."""
    tp = b["typical"]
    step, flow = tp - _lag(tp), np.nan_to_num(tp * b["volume"])
    down = _full(np.where(step < 0, flow, 0.0), n, np.sum)
    return 100 - 100 / (1 + _full(np.where(step > 0, flow, 0.0), n, np.sum) / np.where(down == 0, np.nan, down))


def place_in_range(b: Block) -> np.ndarray:
    """Volume by where the close lies between low (-1) and high (1)."""
    h, lo, c = b["high"], b["low"], b["close"]
    return ((c - lo) - (h - c)) / np.where(h == lo, np.nan, h - lo) * b["volume"]


# ---------------------------------------------------------------- volume profiles


def _volume_by_bin(low: np.ndarray, high: np.ndarray, volume: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, volume of each bin) of windows (rows): a bar's volume is spread evenly over the bins from that of its low to that of its high."""
    n, floor, top = len(low), low.min(1), high.max(1)
    edges = floor[:, None] + (top - floor)[:, None] * (np.arange(BINS + 1) / BINS)
    edges[:, -1] = top
    first = np.clip((edges[:, :, None] <= low[:, None, :]).sum(1) - 1, 0, BINS - 1)
    last = np.clip((edges[:, :, None] < high[:, None, :]).sum(1), 0, BINS - 1)
    each = np.where((high > low) & (volume > 0), volume, 0.0) / np.maximum(last - first + 1, 1)
    row = np.repeat(np.arange(n), low.shape[1]) * (BINS + 1)
    change = np.bincount(row + first.ravel(), each.ravel(), n * (BINS + 1)) - np.bincount(row + last.ravel() + 1, each.ravel(), n * (BINS + 1))
    return edges, np.round(np.cumsum(change.reshape(n, BINS + 1)[:, :BINS], 1), 9)


def _value_area(size: np.ndarray, peak: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) bin of the area that grows from the peak to the larger neighbour until it holds its share.

    Growing always to the larger neighbour takes the bins of each side in order
    of the smallest bin on the way to them; so one sort by that, lower side
    first on ties, gives the order, and running sums tell where to stop.
    """
    n, at = len(size), np.arange(BINS)
    away = at - peak[:, None]
    up = np.minimum.accumulate(np.where(away > 0, size, np.inf), 1)
    down = np.minimum.accumulate(np.where(away < 0, size, np.inf)[:, ::-1], 1)[:, ::-1]
    rank = np.where(away == 0, np.inf, np.where(away > 0, up, down))
    order = np.lexsort((np.abs(away), away > 0, -rank), axis=1)
    held = np.cumsum(np.take_along_axis(size, order, 1), 1)
    used = 1 + (held < AREA * size.sum(1, keepdims=True) - 1e-9).sum(1)
    taken = at[None, :] < used[:, None]
    return np.where(taken, order, BINS).min(1), np.where(taken, order, -1).max(1)


def volume_profile(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray) -> np.ndarray:
    """Three rows: distance of the close from the price bin with most volume of ``BARS`` bars, and from the two ends of the area around it."""
    found = np.full((3, len(close)), np.nan)
    for start in range(0, len(close) - BARS + 1, WINDOWS):
        span = slice(start, min(start + WINDOWS, len(close) - BARS + 1) + BARS - 1)
        lo, hi, vol = (np.lib.stride_tricks.sliding_window_view(x[span], BARS) for x in (low, high, volume))
        now = np.arange(start, start + len(lo)) + BARS - 1
        good = (hi.max(1) > lo.min(1)) & (close[now] > 0)
        if not good.any():
            continue
        edges, size = _volume_by_bin(lo[good], hi[good], vol[good])
        at, c, row = now[good], close[now[good]], np.arange(int(good.sum()))
        peak = size.argmax(1)
        bottom, top = _value_area(size, peak)
        some = size.sum(1) > 0
        found[0, at] = (c - (edges[row, peak] + edges[row, peak + 1]) / 2) / c
        found[1, at] = np.where(some, (c - edges[row, top + 1]) / c, np.nan)
        found[2, at] = np.where(some, (c - edges[row, bottom]) / c, np.nan)
    return found


# ---------------------------------------------------------------- columns

#: Column -> what it is made from, for columns of windows and swings.
WINDOWED: dict[str, Callable[[Block], np.ndarray]] = {
    "aroon_up": lambda b: place_of(b["high"], 25, True), "aroon_down": lambda b: place_of(b["low"], 25, False),
    "distance_14": lambda b: mean_distance(b["typical"], 14), "distance_20": lambda b: mean_distance(b["typical"], 20),
    **{f"mean_{n}": lambda b, n=n: _full(b["close"], n, np.mean) for n in (5, 20, 50, 200)}, "top_252": lambda b: _full(b["high"], 252, np.max),
    "trend_60": lambda b: with_time(b["close"], 60), "volume_trend_60": lambda b: with_time(_log(b["volume"]), 60),
    "dollar_z": lambda b: against_mean(b["close"] * b["volume"], 20), "balance_z": lambda b: against_mean(balance(b), 20), "balance_slope": lambda b: slope(balance(b), 20),
    "vwap": lambda b: weighted(b["close"] * b["volume"], b["volume"], 20), "money_flow": lambda b: money_flow(b, 14), "close_flow": lambda b: weighted(place_in_range(b), b["volume"], 20),
    "high_14": lambda b: _full(b["high"], 14, np.max), "low_14": lambda b: _full(b["low"], 14, np.min), "stoch_d": lambda b: _full(stochastic(b, 14), 3, np.mean), **{f"typical_{n}": lambda b, n=n: _full(b["typical"], n, np.mean) for n in (14, 20)},
    "squeeze": lambda b: against_past(b["width"], 251, 0.2), "vol_rank": lambda b: against_past(b["vol"], 251, None),
}
PROFILE = ["profile_peak", "profile_high", "profile_low"]
SWINGS = [f"swing_{side}{what}" for side in ("high", "low") for what in ("", "_age", "_touches")]
#: Swings carried over: value and number of the bar of each side.
NO_SWINGS = (np.nan, np.nan, np.nan, np.nan)
COLUMNS = [*MADE_OF, *WINDOWED, *PROFILE, *SWINGS]
#: The bars' columns that means and swings need, where it isn't high, low and close.
NEEDS = {
    **{n: ["close"] for n in ("ema12", "ema20", "ema26", "macd", "macd_signal", "gap_before", "rsi_7", "rsi_14", "rsi_21", "rsi_28")}, "force_13": ["close", "volume"], **{n: ["high", "low"] for n in SWINGS},
}


def means_of(names: list[str]) -> list[str]:
    """The recursive means that columns are made of."""
    want = {m for n in names for m in MADE_OF.get(n, [])}
    return [m for m in ALL if m in want]


def _levels(b: Block, means: list[str], carries: dict[str, Carry], second: bool = True) -> dict[str, np.ndarray]:
    """Each mean over the block's own bars; ``macd``, ``dx`` and what they need of the first level come with them, and ``gap_before``, the bar before's MACD less its signal, with the second."""
    out = {m: running(b[ALL[m].source][b.own :], ALL[m], carries.get(m, Carry())) for m in means if m in FIRST}
    with np.errstate(all="ignore"):
        if "ema12" in out and "ema26" in out:
            out["macd"] = out["ema12"] - out["ema26"]
        for side, x in (("di_plus", "up14"), ("di_minus", "down14")):
            if x in out and "atr_14" in out:
                out[side] = 100 * out[x] / out["atr_14"]
        if "di_plus" in out and "di_minus" in out:
            both = out["di_plus"] + out["di_minus"]
            out["dx"] = 100 * np.abs(out["di_plus"] - out["di_minus"]) / np.where(both == 0, np.nan, both)
    if second:
        out |= {m: running(out[ALL[m].source], ALL[m], carries.get(m, Carry())) for m in means if m in SECOND}
        if "macd_signal" in out:
            ema12, ema26, signal = (c.value if c.seen >= ALL[m].least else np.nan for m in ("ema12", "ema26", "macd_signal") for c in [carries.get(m, Carry())])
            out["gap_before"] = np.concatenate(([ema12 - ema26 - signal], (out["macd"] - out["macd_signal"])[:-1]))
    return out


def summaries(b: Block, means: list[str], carries: dict[str, Carry], second: bool) -> list[Summary]:
    """Of each mean of the second or the first level, in order; the second needs the first's carries."""
    if second:
        first = _levels(b, means, carries, False)
        return [summary(first[ALL[m].source], ALL[m]) for m in means if m in SECOND]
    return [summary(b[ALL[m].source][b.own :], ALL[m]) for m in means if m in FIRST]


def last_swings(b: Block) -> list[float]:
    """Value and bar of the last swing of each side that the block confirms, NaN if none."""
    out = []
    for x, top in ((b["high"], True), (b["low"], False)):
        c = confirmed(x, top)
        at = np.flatnonzero(~np.isnan(c[b.own :]))
        out += [c[b.own + at[-1]], b.start + b.own + at[-1] - SWING] if len(at) else [np.nan, np.nan]
    return out


def columns(b: Block, names: list[str], carries: dict[str, Carry], swings: tuple[float, ...] = NO_SWINGS) -> dict[str, np.ndarray]:
    """The named columns over the block's own bars, given what its means and swings were before it."""
    level = _levels(b, means_of(names), carries)
    out = {}
    with np.errstate(all="ignore"):
        for n in names:
            if n.startswith("rsi_"):
                k = n.removeprefix("rsi_")
                loss = level[f"loss{k}"]
                out[n] = 100 - 100 / (1 + level[f"gain{k}"] / np.where(loss == 0, np.nan, loss))
            elif n in level:
                out[n] = level[n]
            elif n in WINDOWED:
                out[n] = WINDOWED[n](b)[b.own :]
        if any(n in PROFILE for n in names):
            out |= dict(zip(PROFILE, volume_profile(b["high"], b["low"], b["close"], b["volume"])[:, b.own :], strict=True))
        for i, (side, x, top) in enumerate((("high", b["high"], True), ("low", b["low"], False)) if any(n in SWINGS for n in names) else ()):
            c, rank = confirmed(x, top), b.start + np.arange(len(x))
            value = pd.Series(np.concatenate(([swings[2 * i]], c[b.own :]))).ffill().to_numpy()[1:]
            bar = pd.Series(np.concatenate(([swings[2 * i + 1]], np.where(np.isnan(c), np.nan, rank - SWING)[b.own :]))).ffill().to_numpy()[1:]
            wide = np.concatenate((np.full(b.own, np.nan), value))
            out |= {f"swing_{side}": value, f"swing_{side}_age": rank[b.own :] - bar, f"swing_{side}_touches": touches(x, wide)[b.own :]}
    return {n: np.where(np.isfinite(out[n]), out[n], np.nan) for n in names}
